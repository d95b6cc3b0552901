"""Queries on formulas and on rendered pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions import formulas as M
from scholiast.functions import html as H
from scholiast.functions import text as T
from scholiast.operators.ordering import clean_blocks
from scholiast.plans.corpus import papers
from scholiast.plans.evidence import clean_evidence


def formula_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Each formula block with its LaTeX, its variables and its MathML."""

    @F.pandas_udf("latex string, variables array<string>, mathml string")
    def read(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            tex, names = M.latex(x), M.variables(x)
            rows.append((tex, names, M.mathml(tex, tuple(names))))
        return pd.DataFrame(rows, columns=["latex", "variables", "mathml"], dtype=object)

    b = clean_blocks(spark, sf).where("role = 'formula' and text is not null")
    return b.select("paper_id", "block_id", "page", read("text").alias("r")).select("paper_id", "block_id", "page", "r.*")


def definition_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence that defines each variable of a formula, on its page or the next ones, nearest first."""
    v = formula_symbols(spark, sf).select("paper_id", "block_id", F.col("page").alias("formula_page"), F.explode("variables").alias("symbol"))
    near = v.withColumn("page", F.explode(F.array(F.col("formula_page") - 1, F.col("formula_page"), F.col("formula_page") + 1)))
    e = clean_evidence(spark, sf).select("paper_id", "page", "evidence_id", "verbatim_text")

    @F.pandas_udf("boolean")
    def tells(symbols: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([M.defines(a, b) for a, b in zip(symbols, texts)])

    base = F.regexp_extract("symbol", r"^[^_]+", 0)
    j = near.join(e, ["paper_id", "page"]).where(F.contains("verbatim_text", base) & tells("symbol", "verbatim_text"))
    best = j.groupBy("paper_id", "block_id", "symbol").agg(F.min(F.struct(F.abs(F.col("page") - F.col("formula_page")).alias("away"), "evidence_id")).alias("b"))
    return best.select("paper_id", "block_id", "symbol", F.col("b.evidence_id").alias("evidence_id"))


def html_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A self-contained page per paper and page number: its evidence as cards with their registry."""
    e = clean_evidence(spark, sf).where("page is not null")
    items = e.groupBy("paper_id", "page").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("evidence_id").alias("id"), "page", F.col("verbatim_text").alias("text"))))).alias("items"))
    p = papers(spark, sf).groupBy("paper_id").agg(F.max("title").alias("title"), F.max(F.lower("language")).alias("language"))

    @F.pandas_udf("string")
    def page(title: pd.Series, lang: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([H.render(t, lang_, json.loads(i)) for t, lang_, i in zip(title, lang, items)])

    j = items.join(p, "paper_id", "left")
    return j.select("paper_id", "page", page(F.coalesce("title", F.lit("Untitled paper")), F.coalesce("language", F.lit("und")), "items").alias("html"), "items")


def html_audit(spark: SparkSession, sf: str) -> DataFrame:
    """The rules each rendered page breaks; none on sound pages."""

    @F.pandas_udf("array<string>")
    def broken(html: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([H.audit(h, {i["id"] for i in json.loads(x)}) for h, x in zip(html, items)])

    return html_pages(spark, sf).select("paper_id", "page", F.explode(broken("html", "items")).alias("rule"))


def visible_text(spark: SparkSession, sf: str) -> DataFrame:
    """The visible text of each rendered page, by digest and length."""

    @F.pandas_udf("string")
    def seen(html: pd.Series) -> pd.Series:
        return html.map(lambda h: H.tokens(h)[1])

    v = html_pages(spark, sf).select("paper_id", "page", seen("html").alias("v"))
    return v.select("paper_id", "page", F.length("v").alias("n_chars"), F.sha2("v", 256).alias("digest"))


def script_json(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence texts as JSON that may stand inside a script element."""
    e = clean_evidence(spark, sf)
    return e.select("paper_id", "evidence_id", T.script_safe(F.to_json(F.struct("verbatim_text"))).alias("json"))


QUERIES = {f.__name__: f for f in (formula_symbols, definition_lookup, html_audit, visible_text, script_json)}
SQL: dict[str, str] = {}
