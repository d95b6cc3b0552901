"""Queries on units of work, scores, run logs, tables and links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators.ordering import PAGE, clean_blocks, running_sum
from scholiast.plans.evidence import C, E, clean_claims, clean_evidence
from scholiast.plans.layout import B
from scholiast.runtime import table



def papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "papers").select("paper_id", "kind", "sha256", "page_count", "local_pdf", "original_url", "title", "year", "language").distinct()


PA = "pa AS (SELECT DISTINCT paper_id, kind, sha256, page_count, local_pdf, original_url, title, year, language FROM papers)"


def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return papers(spark, sf).select("paper_id", T.slug(F.col("title")).alias("slug"))


SLUG_SQL = f"WITH {PA} SELECT paper_id, coalesce(nullif(substring(regexp_replace(regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), ''), 'paper') AS slug FROM pa"


def source_links(spark: SparkSession, sf: str) -> DataFrame:
    """Deep links into each paper's pages, and its address with secrets masked."""
    p = papers(spark, sf).withColumn("url", F.concat(F.col("original_url"), F.lit("?token=abc&page=2#frag")))
    return p.select("paper_id", T.page_link(F.coalesce("original_url", "local_pdf"), F.lit(3)).alias("link"), T.safe_url(F.col("url")).alias("safe"))


LINK_SQL = f"WITH {PA} SELECT paper_id, coalesce(original_url, local_pdf, '') || '#page=3' AS link, original_url || '?token=REDACTED&page=2' AS safe FROM pa"


def presentation_units(spark: SparkSession, sf: str) -> DataFrame:
    """Slides of a paper in groups of four, in the order of their ids."""
    d = table(spark, sf, "documents").where("doc_kind = 'slide' and paper_id is not null").select("paper_id", "doc_id", "n_chars").distinct()
    # counted within spans of ids first, so that a paper with a third of all slides is no single task
    counted = running_sum(d.withColumn("page", F.floor(F.col("doc_id") / 10_000)), F.lit(1), "n", order="doc_id")
    units = counted.withColumn("unit", F.floor((F.col("n") - 1) / 4).cast("int")).groupBy("paper_id", "unit")
    return units.agg(F.count(F.lit(1)).alias("n_slides"), F.sum("n_chars").alias("n_chars"), F.min("doc_id").alias("first_doc"))


UNIT_SQL = """
WITH d AS (SELECT DISTINCT paper_id, doc_id, n_chars FROM documents WHERE doc_kind = 'slide' AND paper_id IS NOT NULL),
u AS (SELECT *, (row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) - 1) // 4 AS unit FROM d)
SELECT paper_id, unit, count(*) AS n_slides, sum(n_chars) AS n_chars, min(doc_id) AS first_doc FROM u GROUP BY ALL"""


def page_context(spark: SparkSession, sf: str, budget: int = 60_000) -> DataFrame:
    """The text of each page as tagged lines within the paper's budget, with a mark where it was cut."""
    b = clean_blocks(spark, sf).withColumn("s", T.squeeze(F.col("text"))).where("length(s) > 0")
    line = F.concat(F.lit("["), "block_id", F.lit(" role="), F.coalesce("role", F.lit("body")), F.lit("] "), "s")
    pages = b.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    n = b.groupBy("paper_id").agg(F.greatest(F.lit(1500), F.floor(F.lit(budget) / F.count_distinct("page"))).alias("most"))
    j = pages.join(n, "paper_id")
    cut = F.length("body") > F.col("most")
    text = F.when(cut, F.concat(F.rtrim(F.substring("body", F.lit(1), F.col("most").cast("int"))), F.lit("\n[PAGE_TRUNCATED]"))).otherwise(F.col("body"))
    return j.select(*PAGE, F.sha2(text, 256).alias("digest"), F.length(text).alias("n_chars"), cut.alias("truncated"))


CONTEXT_SQL = f"""
WITH {B}, s AS (SELECT *, trim(regexp_replace(text, '{T.WS}+', ' ', 'g')) AS s FROM b),
p AS (SELECT paper_id, page, string_agg('[' || block_id || ' role=' || coalesce(role, 'body') || '] ' || s, chr(10) ORDER BY ord, s) AS body FROM s WHERE length(s) > 0 GROUP BY ALL),
n AS (SELECT paper_id, greatest(1500, CAST(floor(60000 / count(DISTINCT page)) AS BIGINT)) AS most FROM s WHERE length(s) > 0 GROUP BY ALL),
t AS (SELECT paper_id, page, length(body) > most AS truncated, CASE WHEN length(body) > most THEN rtrim(substring(body, 1, most)) || chr(10) || '[PAGE_TRUNCATED]' ELSE body END AS t FROM p JOIN n USING (paper_id))
SELECT paper_id, page, sha256(t) AS digest, length(t) AS n_chars, truncated FROM t"""


def page_group_binfill(spark: SparkSession, sf: str, most: int = 2_000) -> DataFrame:
    """Pages of a paper filled into units in order, a unit closed when the next page would overflow it.

    Where a unit ends depends on all pages before, so the pages of a paper are folded in
    order; only their numbers and sizes take part.
    """
    b = clean_blocks(spark, sf).where("text is not null").groupBy(*PAGE).agg(F.sum(F.length("text")).cast("long").alias("n"))
    g = b.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("page", "n"))).alias("pages"))
    zero = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("unit"), F.array().cast("array<struct<page:int,unit:int>>").alias("done"))

    def step(a, x):
        close = (F.size(a["done"]) > 0) & (a["size"] + x["n"] > most)
        unit = a["unit"] + F.when(close, 1).otherwise(0)
        return F.struct(F.when(close, x["n"]).otherwise(a["size"] + x["n"]).alias("size"), unit.alias("unit"), F.concat(a["done"], F.array(F.struct(x["page"].alias("page"), unit.alias("unit")))).alias("done"))

    filled = g.select("paper_id", F.explode(F.aggregate("pages", zero, step, lambda a: a["done"])).alias("u"))
    return filled.groupBy("paper_id", F.col("u.unit").alias("unit")).agg(F.min("u.page").alias("first_page"), F.max("u.page").alias("last_page"))


def recall_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each paper's slides its sections and quoted evidence cover, as capped ratios."""
    d = table(spark, sf, "documents").where("paper_id is not null").select("paper_id", "doc_id", "doc_kind").distinct()
    n = d.groupBy("paper_id").agg(F.count_if(F.col("doc_kind").isin("slide", "poster")).alias("shown"), F.count_if(F.col("doc_kind") == "section").alias("written"))
    c = clean_claims(spark, sf).groupBy("paper_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.size("evidence_ids") > 0).alias("quoted"))
    capped = lambda a, b: F.bround(F.least(F.lit(1.0), a / F.greatest(b, F.lit(1))), 9)
    j = n.join(c, "paper_id")
    return j.select("paper_id", capped(F.col("written"), F.col("shown")).alias("section_recall"), capped(F.col("claims"), F.col("shown")).alias("overview_recall"), capped(F.col("quoted"), F.col("claims")).alias("evidence_rate"))


RECALL_SQL = f"""
WITH {C}, d AS (SELECT DISTINCT paper_id, doc_id, doc_kind FROM documents WHERE paper_id IS NOT NULL),
n AS (SELECT paper_id, count(*) FILTER (doc_kind IN ('slide', 'poster')) AS shown, count(*) FILTER (doc_kind = 'section') AS written FROM d GROUP BY ALL),
k AS (SELECT paper_id, count(*) AS claims, count(*) FILTER (len(evidence_ids) > 0) AS quoted FROM c GROUP BY ALL)
SELECT paper_id, round_even(least(1.0, written / greatest(shown, 1)), 9) AS section_recall, round_even(least(1.0, claims / greatest(shown, 1)), 9) AS overview_recall, round_even(least(1.0, quoted / greatest(claims, 1)), 9) AS evidence_rate FROM n JOIN k USING (paper_id)"""


def round_best(spark: SparkSession, sf: str) -> DataFrame:
    """Mean score of each round of a source, null scores as zero, and the earliest best round."""
    e = table(spark, sf, "events").select(F.pmod("user_id", F.lit(20)).alias("source"), F.pmod("event_id", F.lit(5)).alias("iteration"), F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    r = e.groupBy("source", "iteration").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.count(F.lit(1)).alias("n"))
    best = r.groupBy("source").agg(F.max(F.struct("mean", (-F.col("iteration")).alias("i"))).alias("b"), F.sum("n").alias("n_runs"))
    return best.select("source", (-F.col("b.i")).alias("iteration"), F.bround("b.mean", 6).alias("mean_score"), "n_runs")


ROUND_SQL = """
WITH r AS (SELECT user_id % 20 AS source, event_id % 5 AS iteration, avg(CASE WHEN event_type <> 'error' THEN value ELSE 0 END) AS mean, count(*) AS n FROM events GROUP BY ALL)
SELECT source, iteration, round_even(mean, 6) AS mean_score, sum(n) OVER (PARTITION BY source) AS n_runs FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY mean DESC, iteration) = 1"""


def judge_compact(spark: SparkSession, sf: str) -> DataFrame:
    """What a judge is shown of each paper: at most twelve claims, primary ones first."""
    c = clean_claims(spark, sf).where("summary is not null")
    rank = F.when(F.col("importance") == "primary", 0).when(F.col("importance") == "secondary", 1).otherwise(2)
    w = Window.partitionBy("paper_id").orderBy(rank, "claim_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 12").select("paper_id", "place", "claim_id")


JUDGE_SQL = f"WITH {C} SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY CASE importance WHEN 'primary' THEN 0 WHEN 'secondary' THEN 1 ELSE 2 END, claim_id) AS place, claim_id FROM c WHERE summary IS NOT NULL QUALIFY place <= 12"


def unit_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Claims gathered over the sections of a paper, the first of each fingerprint kept with the units that say it."""
    c = clean_claims(spark, sf).where("summary is not null").withColumn("fp", T.fingerprint(F.col("summary"))).where("fp <> ''")
    return c.groupBy("paper_id", "fp").agg(F.min("claim_id").alias("claim_id"), F.count(F.lit(1)).alias("n_units")).select("paper_id", "claim_id", "n_units")


AGGREGATE_SQL = f"""
WITH {C}, f AS (SELECT paper_id, claim_id, regexp_replace(replace(lower(trim(regexp_replace(summary, '{T.WS}+', ' ', 'g'))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g') AS fp FROM c WHERE summary IS NOT NULL)
SELECT paper_id, min(claim_id) AS claim_id, count(*) AS n_units FROM f WHERE fp <> '' GROUP BY paper_id, fp"""


def quote_match_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Claims found word for word within evidence of their paper they name, with the ratio of lengths."""
    c = clean_claims(spark, sf).select("paper_id", "claim_id", T.fingerprint(F.col("summary")).alias("qk"), F.explode(F.transform("evidence_ids", lambda x: F.lower(F.trim(x)))).alias("evidence_id")).where("length(qk) >= 10")
    e = clean_evidence(spark, sf).select("paper_id", "evidence_id", T.fingerprint(F.col("verbatim_text")).alias("tk"))
    lq, lt = F.length("qk"), F.length("tk")
    j = c.join(e, ["paper_id", "evidence_id"]).where(F.contains("tk", "qk") | ((lt >= 30) & F.contains("qk", "tk")))
    return j.select("paper_id", "claim_id", "evidence_id", F.bround(F.least(lq, lt) / F.greatest(lq, lt) + 1, 9).alias("score")).distinct()




def _fp_sql(column: str) -> str:
    return f"regexp_replace(replace(lower(trim(regexp_replace({column}, '{T.WS}+', ' ', 'g'))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g')"


QUOTE_SQL = f"""
WITH {C}, {E}, k AS (SELECT paper_id, claim_id, {_fp_sql("summary")} AS qk, lower(trim(unnest(evidence_ids))) AS evidence_id FROM c),
t AS (SELECT paper_id, evidence_id, {_fp_sql("verbatim_text")} AS tk FROM e)
SELECT DISTINCT k.paper_id, claim_id, k.evidence_id, round_even(least(length(qk), length(tk)) / greatest(length(qk), length(tk)) + 1, 9) AS score FROM k JOIN t ON t.paper_id = k.paper_id AND t.evidence_id = k.evidence_id
WHERE length(qk) >= 10 AND (contains(tk, qk) OR (length(tk) >= 30 AND contains(qk, tk)))"""


def admission_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Claims admitted: a complete sentence, evidence that matches, and no mere copy of it; the rest with the reason."""
    c = clean_claims(spark, sf).withColumn("sentence", T.complete_sentence(F.col("summary"))).withColumn("fp", T.fingerprint(F.col("summary")))
    m = quote_match_exact(spark, sf).groupBy("paper_id", "claim_id").agg(F.max("score").alias("score"))
    j = c.join(m, ["paper_id", "claim_id"], "left")
    verdict = F.when(F.col("sentence").isNull(), "incomplete").when(F.col("score").isNull(), "no evidence").when(F.col("score") == 2.0, "copy").otherwise("admitted")
    return j.select("paper_id", "claim_id", verdict.alias("verdict"))


ADMISSION_SQL = f"""
WITH x AS ({QUOTE_SQL}), g AS (SELECT paper_id, claim_id, max(score) AS score FROM x GROUP BY ALL), {C}, s AS (SELECT *, rtrim(substring(trim(summary), 1, 1200)) AS v FROM c)
SELECT s.paper_id, s.claim_id, CASE WHEN v IS NULL OR length(v) < 20 OR regexp_matches(v, '(…|\\.\\.\\.|-|—|:|;|,)$') THEN 'incomplete' WHEN score IS NULL THEN 'no evidence' WHEN score = 2 THEN 'copy' ELSE 'admitted' END AS verdict
FROM s LEFT JOIN g ON g.paper_id = s.paper_id AND g.claim_id = s.claim_id"""


def quote_match_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Claims not contained in their evidence but alike letter by letter."""
    c = clean_claims(spark, sf).select("paper_id", "claim_id", T.fingerprint(F.col("summary")).alias("qk"), F.explode(F.transform("evidence_ids", lambda x: F.lower(F.trim(x)))).alias("evidence_id")).where("length(qk) >= 10")
    e = clean_evidence(spark, sf).select("paper_id", "evidence_id", T.fingerprint(F.col("verbatim_text")).alias("tk"))
    lq, lt = F.length("qk"), F.length("tk")
    j = c.join(e, ["paper_id", "evidence_id"]).where(~F.contains("tk", "qk") & ~F.contains("qk", "tk") & (2 * F.least(lq, lt) >= 0.92 * (lq + lt)))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])

    return j.select("paper_id", "claim_id", "evidence_id", ratio("qk", "tk").alias("score")).where("score >= 0.92").distinct()


def stage_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's stages: how many attempts until the first success, and the waiting time back-off implies."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    first = e.where("event_type <> 'error'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    j = e.join(first, "user_id", "left").where("event_type = 'error'")
    before = F.col("f").isNull() | (F.struct("ts", "event_id") < F.col("f"))
    n = j.groupBy("user_id").agg(F.count_if(before).alias("failures"))
    wait = F.aggregate(F.sequence(F.lit(0), F.col("failures")), F.lit(0.0), lambda a, i: a + F.when(i > 0, F.least(F.lit(1.0), F.lit(0.1) * F.pow(F.lit(2.0), i - 1))).otherwise(0.0))
    return n.where("failures > 0").select("user_id", "failures", F.bround(wait, 6).alias("waited"))


ATTEMPT_SQL = """
WITH f AS (SELECT user_id, min(struct_pack(ts := ts, event_id := event_id)) AS f FROM events WHERE event_type <> 'error' GROUP BY ALL),
n AS (SELECT e.user_id, count(*) FILTER (f IS NULL OR struct_pack(ts := ts, event_id := event_id) < f) AS failures FROM events e LEFT JOIN f USING (user_id) WHERE event_type = 'error' GROUP BY ALL)
SELECT user_id, failures, round_even(list_sum(list_transform(generate_series(1, failures), lambda i: least(1.0, 0.1 * pow(2.0, i - 1)))), 6) AS waited FROM n WHERE failures > 0"""


def cache_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose stage key is not among those of an earlier run: only they are built again."""
    p = papers(spark, sf).where("sha256 is not null").select("paper_id", F.sha2(F.concat_ws("|", F.lit("parse"), F.lit("1"), "sha256"), 256).alias("key"))
    old = papers(spark, sf).where("year < 2010 and sha256 is not null").select(F.sha2(F.concat_ws("|", F.lit("parse"), F.lit("1"), "sha256"), 256).alias("key"))
    return p.join(old, "key", "left_anti").select("paper_id", "key").distinct()


CACHE_SQL = f"WITH {PA} SELECT DISTINCT paper_id, sha256('parse|1|' || sha256) AS key FROM pa WHERE sha256 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pa o WHERE o.year < 2010 AND o.sha256 = pa.sha256)"


def bar_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Heights and places of bars for the returns table, scaled to its largest value."""
    t = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.bround(F.sum("l_quantity"), 2).alias("v"))
    by = Window.partitionBy("l_returnflag")
    low = F.least(F.lit(0.0), F.min("v").over(by))
    i, n = F.row_number().over(by.orderBy("l_linestatus")) - 1, F.count(F.lit(1)).over(by)
    span = F.greatest(F.max("v").over(by) - low, F.lit(1e-9))
    return t.select("l_returnflag", "l_linestatus", F.bround(400 * F.abs("v") / span, 6).alias("height"), F.bround(100 + i * 820 / n, 6).alias("x"), F.bround(F.greatest(F.lit(20.0), 0.65 * 820 / n), 6).alias("width"))


BAR_SQL = """
WITH t AS (SELECT l_returnflag, l_linestatus, round_even(sum(l_quantity), 2) AS v FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round_even(400 * abs(v) / greatest(max(v) OVER w - least(0, min(v) OVER w), 1e-9), 6) AS height,
  round_even(100 + (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) - 1) * 820 / count(*) OVER w, 6) AS x, round_even(greatest(20, 0.65 * 820 / count(*) OVER w), 6) AS width
FROM t WINDOW w AS (PARTITION BY l_returnflag)"""


def table_rectangular(spark: SparkSession, sf: str) -> DataFrame:
    """Captions as table rows cut at commas: trailing blanks dropped, short rows padded, narrow ones left out."""
    b = clean_blocks(spark, sf).where("role = 'caption' and text is not null")
    cells = F.transform(F.split("text", ","), lambda x: F.substring(F.trim(x), 1, 1000))
    trimmed = F.when(F.try_element_at(cells, F.lit(-1)) == "", F.slice(cells, 1, F.size(cells) - 1)).otherwise(cells)
    rows = b.select(*PAGE, "ord", F.slice(trimmed, 1, 50).alias("row")).where(F.exists("row", lambda x: x != ""))
    width = rows.groupBy(*PAGE).agg(F.max(F.size("row")).alias("w")).where("w >= 2")
    j = rows.join(width, PAGE)
    return j.select(*PAGE, "ord", F.array_join(F.concat("row", F.array_repeat(F.lit(""), F.col("w") - F.size("row"))), "|").alias("cells"))


RECT_SQL = f"""
WITH {B}, c AS (SELECT paper_id, page, ord, list_transform(string_split(text, ','), lambda x: substring(trim(x), 1, 1000)) AS cells FROM b WHERE role = 'caption' AND text IS NOT NULL),
r AS (SELECT paper_id, page, ord, (CASE WHEN list_last(cells) = '' THEN cells[1:len(cells) - 1] ELSE cells END)[1:50] AS row FROM c),
k AS (SELECT * FROM r WHERE len(list_filter(row, lambda x: x <> '')) > 0), w AS (SELECT paper_id, page, max(len(row)) AS w FROM k GROUP BY ALL HAVING max(len(row)) >= 2)
SELECT paper_id, page, ord, array_to_string(list_resize(row, w, ''), '|') AS cells FROM k JOIN w USING (paper_id, page)"""


def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with e-mail addresses or credential literals."""
    b = clean_blocks(spark, sf).where("text is not null")
    mail = F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+")
    secret = F.col("text").rlike(r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*[^ ]{6,}")
    return b.where(mail | secret).select("paper_id", "block_id", mail.alias("has_mail"), secret.alias("has_secret"))


SECRET_SQL = f"""
WITH {B}, t AS (SELECT paper_id, block_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z.]+') AS has_mail, regexp_matches(text, '(?i)\\b(?:api[_-]?key|token|secret|password)\\s*[:=]\\s*[^ ]{{6,}}') AS has_secret FROM b WHERE text IS NOT NULL)
SELECT * FROM t WHERE has_mail OR has_secret"""


def event_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable value of each event's payload, whichever of its shapes it has."""
    e = table(spark, sf, "events")
    v = F.coalesce(*(F.get_json_object("props", p) for p in ("$.output_text", "$.result.text", "$.k")))
    return e.select("event_id", v.alias("picked")).where("picked is not null")


PICK_SQL = "SELECT event_id, coalesce(props ->> '$.output_text', props ->> '$.result.text', props ->> '$.k') AS picked FROM events WHERE coalesce(props ->> '$.output_text', props ->> '$.result.text', props ->> '$.k') IS NOT NULL"


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per day and kind of event: number, sum, longest gap to the user's event before."""
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.withColumn("gap", gap).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("value"), 2).alias("total"), F.max("gap").alias("longest_gap"))


SUMMARY_SQL = """
WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round_even(sum(value), 2) AS total, max(gap) AS longest_gap FROM g GROUP BY ALL"""


def asset_sharing(spark: SparkSession, sf: str) -> DataFrame:
    """PDF files that several papers name: such a file is shown for none of them."""
    p = papers(spark, sf).where("local_pdf is not null")
    return p.groupBy("local_pdf").agg(F.count_distinct("paper_id").alias("n_papers"), F.min("paper_id").alias("first_paper")).withColumn("shown", F.col("n_papers") == 1)


ASSET_SQL = f"WITH {PA} SELECT local_pdf, count(DISTINCT paper_id) AS n_papers, min(paper_id) AS first_paper, count(DISTINCT paper_id) = 1 AS shown FROM pa WHERE local_pdf IS NOT NULL GROUP BY ALL"


def paper_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with title, first heading as a substitute, and what is known of them, most recent first."""
    p = papers(spark, sf)
    h = clean_blocks(spark, sf).where("role = 'header' and page = 1").groupBy("paper_id").agg(F.min_by("text", "ord").alias("running_head"))
    j = p.join(h, "paper_id", "left")
    return j.select("paper_id", F.coalesce("title", "running_head", F.lit("Untitled paper")).alias("title"), F.coalesce(F.lower("language"), F.lit("und")).alias("language"), F.coalesce("year", F.lit(0)).alias("year"))


CATALOG_SQL = f"""
WITH {PA}, {B}, h AS (SELECT paper_id, arg_min(text, ord) AS running_head FROM b WHERE role = 'header' AND page = 1 GROUP BY ALL)
SELECT pa.paper_id, coalesce(title, running_head, 'Untitled paper') AS title, coalesce(lower(language), 'und') AS language, coalesce(year, 0) AS year FROM pa LEFT JOIN h ON h.paper_id = pa.paper_id"""

QUERIES = {f.__name__: f for f in (
    slugify, source_links, presentation_units, page_context, page_group_binfill, recall_scores, round_best, judge_compact, unit_aggregate, quote_match_exact, quote_match_fuzzy,
    admission_gate, stage_attempts, cache_probe, bar_scale, table_rectangular, secret_scan, event_pick, run_summary, asset_sharing, paper_catalog,
)}
SQL = {
    "slugify": SLUG_SQL, "source_links": LINK_SQL, "presentation_units": UNIT_SQL, "page_context": CONTEXT_SQL, "recall_scores": RECALL_SQL, "round_best": ROUND_SQL, "judge_compact": JUDGE_SQL,
    "unit_aggregate": AGGREGATE_SQL, "quote_match_exact": QUOTE_SQL, "admission_gate": ADMISSION_SQL, "stage_attempts": ATTEMPT_SQL, "cache_probe": CACHE_SQL, "bar_scale": BAR_SQL,
    "table_rectangular": RECT_SQL, "secret_scan": SECRET_SQL, "event_pick": PICK_SQL, "run_summary": SUMMARY_SQL, "asset_sharing": ASSET_SQL, "paper_catalog": CATALOG_SQL,
}
