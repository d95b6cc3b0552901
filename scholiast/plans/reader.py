"""Queries of the reader and of plans: titles, abstracts, outlines, briefs, overlays, contracts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import geometry as G
from scholiast.functions import text as T
from scholiast.operators.ordering import clean_blocks, running_sum
from scholiast.operators.reader_scans import consolidate, sentence_boxes
from scholiast.operators.reading import READING_SQL, REGION_SQL, region_order
from scholiast.plans.citations import EXPAND_SQL, FIELD_SQL, RELATION_SQL, citation_expand, citation_relation, clean_records, reference_fields
from scholiast.plans.corpus import PA, papers
from scholiast.plans.evidence import SECTION_ROUTER_SQL, C, E, clean_claims, clean_evidence, section_router
from scholiast.plans.graphs import GATE_SQL, P, VIOLATION_SQL, clean_provenance, gate_counts, violations
from scholiast.plans.layout import PAGE_SECTION_SQL, B, SECTION_CTE, SECTION_SQL, flat_blocks, headings, per_page, q, section_segments
from scholiast.runtime import table

_SQ = f"trim(regexp_replace(text, '{T.WS}+', ' ', 'g'))"
NOT_A_TITLE = r"(?i)\b(?:arxiv|abstract|copyright|all rights reserved|permission|attribution|preprint)\b"


def title_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The title of each paper: its own, else the largest, then earliest heading of page one, else its first line."""
    b = clean_blocks(spark, sf).where("page = 1 and text is not null and coalesce(role, 'body') not in ('header', 'footer')")
    line = F.try_element_at(F.filter(F.transform(F.split("text", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    c = b.withColumn("line", line).where(F.col("line").isNotNull() & ~F.col("line").rlike(NOT_A_TITLE))
    rank = F.struct((F.coalesce("role", F.lit("")) == "heading").alias("h"), F.when(F.col("role") == "heading", F.coalesce("font_size_median", F.lit(0.0))).otherwise(0.0).alias("size"), (-F.col("ord")).alias("o"), "line")
    best = c.groupBy("paper_id").agg(F.max(rank).alias("r")).select("paper_id", F.col("r.line").alias("found"))
    own = papers(spark, sf).groupBy("paper_id").agg(F.max("title").alias("own"))
    return own.join(best, "paper_id", "left").select("paper_id", F.coalesce("own", "found", F.lit("Untitled paper")).alias("title"), F.col("found").alias("heading"))


TITLE_SQL = f"""
WITH {B}, {PA}, c AS (SELECT *, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM b WHERE page = 1 AND text IS NOT NULL AND coalesce(role, 'body') NOT IN ('header', 'footer')),
r AS (SELECT paper_id, line AS found FROM c WHERE line IS NOT NULL AND NOT regexp_matches(line, {q(NOT_A_TITLE)})
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(role = 'heading', false) DESC, CASE WHEN role = 'heading' THEN coalesce(font_size_median, 0) ELSE 0 END DESC, ord, line DESC) = 1),
o AS (SELECT paper_id, max(title) AS own FROM pa GROUP BY ALL)
SELECT o.paper_id, coalesce(own, found, 'Untitled paper') AS title, found AS heading FROM o LEFT JOIN r ON r.paper_id = o.paper_id"""


def abstracts(spark: SparkSession, sf: str) -> DataFrame:
    """The opening text of each paper: the body of its first section called so or, without one, of its first section."""
    numbered = running_sum(headings(spark, sf), F.col("is_heading"), "section_no").where("section_no > 0")
    s = section_segments(spark, sf).select("paper_id", "section_no", F.col("title").rlike(r"(?i)abstract|introduc|einleitung|введение|introducción").alias("named"))
    pick = s.groupBy("paper_id").agg(F.min(F.struct((~F.col("named")).alias("n"), "section_no")).alias("k")).select("paper_id", F.col("k.section_no").alias("section_no"))
    body = numbered.where("role = 'body' and text is not null").join(pick, ["paper_id", "section_no"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "s"))), lambda x: x["s"]), " ")
    return body.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.sha2(text, 256).alias("digest"))


ABSTRACT_SQL = f"""
WITH {SECTION_CTE}, t AS (SELECT paper_id, section_no, max(s) FILTER (is_heading) AS title FROM n WHERE section_no > 0 GROUP BY ALL),
k AS (SELECT paper_id, section_no FROM t QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY NOT regexp_matches(title, '(?i)abstract|introduc|einleitung|введение|introducción'), section_no) = 1)
SELECT n.paper_id, count(*) AS n_blocks, sha256(string_agg(s, ' ' ORDER BY page, ord)) AS digest FROM n JOIN k ON k.paper_id = n.paper_id AND k.section_no = n.section_no WHERE role = 'body' AND text IS NOT NULL GROUP BY ALL"""


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """The first eighty headings of each paper, up to 150 characters long, with level and page: what a reader is shown."""
    s = section_segments(spark, sf).where("length(title) <= 150")
    w = Window.partitionBy("paper_id").orderBy("section_no")
    return s.withColumn("place", F.row_number().over(w)).where("place <= 80").select("paper_id", "place", "title", "level", "page_start")


OUTLINE_SQL = f"WITH s AS ({SECTION_SQL}) SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY section_no) AS place, title, level, page_start FROM s WHERE length(title) <= 150 QUALIFY place <= 80"


def equation_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that are equations by their signs, their words and their place on the page."""
    b = clean_blocks(spark, sf).where("text is not null and bbox is not null").withColumn("s", T.squeeze(F.col("text"))).where("length(s) between 1 and 260")
    box = F.col("bbox")
    signs = T.count_any(F.col("s"), tuple("=∑∏∫√∞≈≠≤≥±×÷∂∇∈∉⊂⊆∪∩→←↔∀∃λμσθβαγδφψω^_{}|"))
    words = F.regexp_count("s", F.lit("[A-Za-z]{3,}"))
    centred = (F.abs((G.side(box, 0) + G.side(box, 2)) / 2 - 300) < 72) & (G.side(box, 2) - G.side(box, 0) < 432)
    numbered = F.col("s").rlike(r"\( *[0-9]+[a-z]? *\) *$")
    dense = signs / F.greatest(F.length(F.regexp_replace("s", " ", "")), F.lit(1))
    return b.where((centred & (signs >= 1) & (dense >= 0.12) & (words <= 6)) | ((signs >= 2) & (dense >= 0.1) & (words <= 3)) | (numbered & (signs >= 1) & (words <= 6))).select("paper_id", "block_id", numbered.alias("numbered"))


_SIGNS = "length(s) - length(translate(s, '=∑∏∫√∞≈≠≤≥±×÷∂∇∈∉⊂⊆∪∩→←↔∀∃λμσθβαγδφψω^_{}|', ''))"
EQUATION_SQL = f"""
WITH {B}, t AS (SELECT *, {_SQ} AS s FROM b WHERE text IS NOT NULL AND bbox IS NOT NULL),
m AS (SELECT *, {_SIGNS} AS signs, len(regexp_extract_all(s, '[A-Za-z]{{3,}}')) AS words, abs((bbox[1] + bbox[3]) / 2 - 300) < 72 AND bbox[3] - bbox[1] < 432 AS centred,
  regexp_matches(s, '\\( *[0-9]+[a-z]? *\\) *$') AS numbered, ({_SIGNS}) / greatest(length(replace(s, ' ', '')), 1) AS dense FROM t WHERE length(s) BETWEEN 1 AND 260)
SELECT paper_id, block_id, numbered FROM m WHERE (centred AND signs >= 1 AND dense >= 0.12 AND words <= 6) OR (signs >= 2 AND dense >= 0.1 AND words <= 3) OR (numbered AND signs >= 1 AND words <= 6)"""


def section_briefs(spark: SparkSession, sf: str) -> DataFrame:
    """For each part of the story the first three texts, long enough to say something, of the sections that support it."""
    numbered = running_sum(headings(spark, sf), F.col("is_heading"), "section_no").where("section_no > 0 and role = 'body' and length(s) >= 35")
    r = section_router(spark, sf).where("part is not null")
    j = numbered.join(r, ["paper_id", "section_no"])
    w = Window.partitionBy("paper_id", "part").orderBy("section_no", "page", "ord")
    return j.withColumn("place", F.row_number().over(w)).where("place <= 3").select("paper_id", "part", "place", "block_id")


BRIEF_SQL = f"""
WITH {SECTION_CTE}, r AS ({SECTION_ROUTER_SQL})
SELECT n.paper_id, part, row_number() OVER (PARTITION BY n.paper_id, part ORDER BY n.section_no, page, ord) AS place, block_id
FROM n JOIN r ON r.paper_id = n.paper_id AND r.section_no = n.section_no WHERE part IS NOT NULL AND role = 'body' AND length(s) >= 35 QUALIFY place <= 3"""


def relation_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence that best shows a citation's relation: in a section on earlier work, then on method, then the shortest."""
    rel = citation_relation(spark, sf).where("relation is not null")
    e = clean_evidence(spark, sf).select("paper_id", "evidence_id", "page", F.length("verbatim_text").alias("n"))
    titles = section_segments(spark, sf).select("paper_id", F.explode(F.sequence("page_start", "page_end")).alias("page"), "section_no", "title")
    page_title = titles.groupBy("paper_id", "page").agg(F.min_by("title", "section_no").alias("title"))
    place = F.when(F.col("title").rlike(r"(?i)\b(related work|background|introduction|prior work|literature)\b"), 3).when(F.col("title").rlike(r"(?i)\b(method|approach|model|architecture)\b"), 2).otherwise(1)
    cited = citation_expand(spark, sf).join(rel, ["paper_id", "evidence_id"]).join(e, ["paper_id", "evidence_id"]).join(page_title, ["paper_id", "page"], "left").withColumn("place", place)
    f = reference_fields(spark, sf).select("paper_id", "citation_id", "number")
    best = f.join(cited, ["paper_id", "number"]).groupBy("paper_id", "citation_id").agg(F.min(F.struct((-F.col("place")).alias("p"), "n", "evidence_id", "relation")).alias("b"))
    return best.select("paper_id", "citation_id", (-F.col("b.p")).alias("section_rank"), F.col("b.evidence_id").alias("evidence_id"), F.col("b.relation").alias("relation"))


RANK_SQL = f"""
WITH {E}, x AS ({EXPAND_SQL}), f AS ({FIELD_SQL}), l AS ({RELATION_SQL}), t AS ({PAGE_SECTION_SQL})
SELECT f.paper_id, citation_id, CASE WHEN regexp_matches(title, '(?i)\\b(related work|background|introduction|prior work|literature)\\b') THEN 3 WHEN regexp_matches(title, '(?i)\\b(method|approach|model|architecture)\\b') THEN 2 ELSE 1 END AS section_rank,
  x.evidence_id, relation FROM f JOIN x ON f.paper_id = x.paper_id AND f.number = x.number JOIN l ON l.paper_id = x.paper_id AND l.evidence_id = x.evidence_id AND relation IS NOT NULL
JOIN e ON e.paper_id = x.paper_id AND e.evidence_id = x.evidence_id LEFT JOIN t ON t.paper_id = e.paper_id AND t.page = e.page
QUALIFY row_number() OVER (PARTITION BY f.paper_id, citation_id ORDER BY section_rank DESC, length(verbatim_text), x.evidence_id, relation) = 1"""


def visual_requests(spark: SparkSession, sf: str) -> DataFrame:
    """What is asked to be shown of each paper, by what it holds: original pictures and tables, equations, relations."""
    b = clean_blocks(spark, sf).withColumn("s", T.squeeze(F.col("text")))
    cap = b.where(F.col("s").rlike(T.CAPTION)).select("paper_id", F.when(F.col("s").rlike("(?i)^table"), "original_table").otherwise("original_figure").alias("request"), "block_id")
    eq = b.where("role = 'formula'").select("paper_id", F.lit("formula").alias("request"), "block_id")
    p = clean_provenance(spark, sf).where("kind = 'generated_summary'").select("paper_id", F.lit("relation").alias("request"), F.col("owner_id").alias("block_id"))
    return cap.unionByName(eq).unionByName(p).groupBy("paper_id", "request").agg(F.count_distinct("block_id").alias("n"), F.min("block_id").alias("first_id"))


VISUAL_SQL = f"""
WITH {B}, {P}, t AS (SELECT *, {_SQ} AS s FROM b),
v AS (SELECT paper_id, CASE WHEN regexp_matches(s, '(?i)^table') THEN 'original_table' ELSE 'original_figure' END AS request, block_id FROM t WHERE regexp_matches(s, {q(T.CAPTION)})
  UNION ALL SELECT paper_id, 'formula', block_id FROM t WHERE role = 'formula' UNION ALL SELECT paper_id, 'relation', owner_id FROM p WHERE kind = 'generated_summary')
SELECT paper_id, request, count(DISTINCT block_id) AS n, min(block_id) AS first_id FROM v GROUP BY ALL"""


def content_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Claims under a patch bound to what they said: a rewrite whose hash no longer fits is left out."""
    c = clean_claims(spark, sf)
    base = c.select("paper_id", "claim_id", "summary")
    patch = c.where("importance = 'primary'").select("paper_id", "claim_id", F.concat(F.lit("Edited: "), "summary").alias("new"), F.sha2(F.concat("summary", F.when(F.col("display_label") == "原文摘录", "").otherwise(" ")), 256).alias("bound_to"))
    j = base.join(patch, ["paper_id", "claim_id"], "left")
    fits = F.col("bound_to") == F.sha2("summary", 256)
    return j.select("paper_id", "claim_id", F.when(fits, F.col("new")).otherwise(F.col("summary")).alias("summary"), F.coalesce(fits, F.lit(False)).alias("edited"))


OVERLAY_SQL = f"""
WITH {C}, j AS (SELECT paper_id, claim_id, summary, importance = 'primary' AND display_label = '原文摘录' AND summary IS NOT NULL AS fits FROM c)
SELECT paper_id, claim_id, CASE WHEN fits THEN 'Edited: ' || summary ELSE summary END AS summary, coalesce(fits, false) AS edited FROM j"""


def schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Values of papers and records outside their contract, as path and message."""
    p, m = papers(spark, sf), clean_records(spark, sf)
    say = lambda df, key, path, ok, what: df.where(~F.coalesce(ok, F.lit(False))).select(F.col(key).alias("id"), F.lit(path).alias("path"), F.lit(what).alias("message"))
    parts = [
        say(p, "paper_id", "source.sha256", F.col("sha256").rlike("^[a-f0-9]{64}$"), "no digest"),
        say(p, "paper_id", "source.kind", F.col("kind").isin("local", "url"), "unknown kind"),
        say(p, "paper_id", "source.page_count", F.col("page_count") >= 1, "no pages"),
        say(p, "paper_id", "paper.language", F.col("language").rlike("^[a-z]{2,3}$"), "malformed language"),
        say(m, "record_id", "record.title", F.length("title") > 0, "no title"),
        say(m, "record_id", "record.year", F.col("year").between(1900, 2099), "no year"),
        say(m, "record_id", "record.doi", F.col("doi").isNull() | F.col("doi").rlike(r"^10\.[0-9]{4,9}/"), "malformed doi"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


SCHEMA_SQL = f"""
WITH {PA}, m AS (SELECT DISTINCT record_id, title, year, doi FROM metadata)
SELECT DISTINCT * FROM (SELECT paper_id AS id, 'source.sha256' AS path, 'no digest' AS message FROM pa WHERE NOT coalesce(regexp_matches(sha256, '^[a-f0-9]{{64}}$'), false)
UNION ALL SELECT paper_id, 'source.kind', 'unknown kind' FROM pa WHERE NOT coalesce(kind IN ('local', 'url'), false)
UNION ALL SELECT paper_id, 'source.page_count', 'no pages' FROM pa WHERE NOT coalesce(page_count >= 1, false)
UNION ALL SELECT paper_id, 'paper.language', 'malformed language' FROM pa WHERE NOT coalesce(regexp_matches(language, '^[a-z]{{2,3}}$'), false)
UNION ALL SELECT record_id, 'record.title', 'no title' FROM m WHERE NOT coalesce(length(title) > 0, false)
UNION ALL SELECT record_id, 'record.year', 'no year' FROM m WHERE NOT coalesce(year BETWEEN 1900 AND 2099, false)
UNION ALL SELECT record_id, 'record.doi', 'malformed doi' FROM m WHERE NOT coalesce(doi IS NULL OR regexp_matches(doi, '^10\\.[0-9]{{4,9}}/'), false))"""

RULES = ("order taken twice", "block id taken twice", "box off the page", "malformed block id", "empty span", "evidence does not rebuild", "hash differs", "claim without text", "unknown importance", "claim without evidence", "provenance without source", "unknown evidence")


def review_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row per rule: passed, warning or blocker, with its number of broken rows."""
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    g = gate_counts(spark, sf)
    blocker = F.col("rule").isin("evidence does not rebuild", "hash differs", "block id taken twice")
    return rules.join(g, "rule", "left").select("rule", F.when(F.col("n").isNull(), "passed").when(blocker, "blocker").otherwise("warning").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


REPORT_SQL = f"""
WITH g AS ({GATE_SQL}), r AS (SELECT unnest([{", ".join(q(x) for x in RULES)}]) AS rule)
SELECT r.rule, CASE WHEN n IS NULL THEN 'passed' WHEN r.rule IN ('evidence does not rebuild', 'hash differs', 'block id taken twice') THEN 'blocker' ELSE 'warning' END AS status, coalesce(n, 0) AS n FROM r LEFT JOIN g ON g.rule = r.rule"""


def issue_list(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules numbered within each paper, each once."""
    w = Window.partitionBy("paper_id").orderBy("rule", "id")
    return violations(spark, sf).select("paper_id", F.row_number().over(w).alias("issue_no"), "rule", "id")


ISSUE_SQL = f"WITH v AS ({VIOLATION_SQL}) SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY rule, id) AS issue_no, rule, id FROM v"


def label_dereference(spark: SparkSession, sf: str) -> DataFrame:
    """Values that references of the form entity and field point to, blank where nothing is there."""
    long = clean_claims(spark, sf).select("paper_id", F.col("claim_id").alias("id"), F.explode(F.create_map(F.lit("summary"), F.col("summary"), F.lit("importance"), F.col("importance"))).alias("field", "value"))
    refs = clean_provenance(spark, sf).where("kind = 'paper_excerpt'").select("paper_id", F.col("owner_id").alias("id"), F.lit("summary").alias("field")).distinct()
    return refs.join(long, ["paper_id", "id", "field"], "left").select("paper_id", "id", "field", F.coalesce("value", F.lit("")).alias("value"))


DEREF_SQL = f"""
WITH {C}, {P}, r AS (SELECT DISTINCT paper_id, owner_id AS id FROM p WHERE kind = 'paper_excerpt')
SELECT r.paper_id, id, 'summary' AS field, coalesce(summary, '') AS value FROM r LEFT JOIN c ON c.paper_id = r.paper_id AND c.claim_id = r.id"""


def companions(spark: SparkSession, sf: str) -> DataFrame:
    """For each paper's file the paper of the catalog it belongs to, by path, else by its stem."""
    p = papers(spark, sf)
    stem = F.regexp_extract("local_pdf", r"([^/]+)\.pdf$", 1)
    files = p.where("kind = 'local'").select("local_pdf", stem.alias("stem")).distinct()
    cat = p.select(F.col("paper_id").alias("by_path"), "local_pdf")
    by_stem = p.select(F.col("paper_id").alias("by_stem"), F.substring("sha256", 1, 8).alias("stem"))
    return files.join(cat, "local_pdf", "left").join(by_stem, "stem", "left").groupBy("local_pdf").agg(F.min(F.coalesce("by_path", "by_stem")).alias("paper_id"))


COMPANION_SQL = f"""
WITH {PA}, f AS (SELECT DISTINCT local_pdf, regexp_extract(local_pdf, '([^/]+)\\.pdf$', 1) AS stem FROM pa WHERE kind = 'local')
SELECT f.local_pdf, min(coalesce(a.paper_id, b.paper_id)) AS paper_id FROM f LEFT JOIN pa a ON a.local_pdf = f.local_pdf LEFT JOIN pa b ON substring(b.sha256, 1, 8) = f.stem GROUP BY ALL"""


def data_uris(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence texts as data addresses, left out beyond 25 MiB."""
    e = clean_evidence(spark, sf).where(F.octet_length("verbatim_text") <= 25 * 2**20)
    return e.select("paper_id", "evidence_id", F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.encode("verbatim_text", "UTF-8")), "[\r\n]", "")).alias("uri"))


URI_SQL = f"WITH {E} SELECT paper_id, evidence_id, 'data:text/plain;base64,' || base64(encode(verbatim_text)) AS uri FROM e"


def query_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty titles to ask a provider for in each paper, by citation."""
    c = table(spark, sf, "citations").where("title is not null").select("paper_id", "citation_id", "title").distinct()
    w = Window.partitionBy("paper_id").orderBy("citation_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 20")


TARGET_SQL = "WITH c AS (SELECT DISTINCT paper_id, citation_id, title FROM citations WHERE title IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY citation_id) AS place FROM c QUALIFY place <= 20"


def reader_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """The second extractor's reading order: regions between wide blocks, columns where both hold two or more."""
    return region_order(flat_blocks(spark, sf).drop("text", "role"), G.WIDTH)


READER_ORDER_SQL = READING_SQL.format(b=B) + REGION_SQL


def equation_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Equations with the fragments on their line; too many words make them text again."""
    return per_page(spark, sf, consolidate, "paper_id string, page int, block_id string, n_merged int, joined string, kind string")


def sentence_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of body blocks with the box around the lines they stand on."""
    return per_page(spark, sf, sentence_boxes, "paper_id string, page int, block_id string, sentence_no int, sentence string, y0 double, y1 double")


def redacted_props(spark: SparkSession, sf: str) -> DataFrame:
    """Event payloads as maps, values of secret-bearing keys masked."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    full = e.select("event_id", F.map_concat(F.col("m"), F.create_map(F.lit("api_token"), F.lit("abc"))).alias("m"))
    return full.select("event_id", F.to_json(T.redact(F.col("m"))).alias("props"))


QUERIES = {f.__name__: f for f in (
    title_argmax, abstracts, outline, equation_lines, section_briefs, relation_rank, visual_requests, content_overlay, schema_violations, review_report, issue_list,
    label_dereference, companions, data_uris, query_targets, reader_reading_order, equation_groups, sentence_rectangles, redacted_props,
)}
SQL = {
    "title_argmax": TITLE_SQL, "abstracts": ABSTRACT_SQL, "outline": OUTLINE_SQL, "equation_lines": EQUATION_SQL, "section_briefs": BRIEF_SQL, "relation_rank": RANK_SQL, "visual_requests": VISUAL_SQL, "content_overlay": OVERLAY_SQL,
    "schema_violations": SCHEMA_SQL, "review_report": REPORT_SQL, "issue_list": ISSUE_SQL, "label_dereference": DEREF_SQL, "companions": COMPANION_SQL, "data_uris": URI_SQL, "query_targets": TARGET_SQL, "reader_reading_order": READER_ORDER_SQL,
}
