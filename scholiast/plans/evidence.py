"""Queries on evidence, claims and their text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import geometry as G
from scholiast.functions import text as T
from scholiast.functions.readable import Kept, claim_summary, sentence_spans
from scholiast.operators.ordering import PAGE, clean_blocks, running_sum
from scholiast.plans.layout import PAGE_SECTION_SQL, SECTION_SQL, B, page_sections, q, section_segments
from scholiast.runtime import table

E = "e AS (SELECT DISTINCT paper_id, evidence_id, verbatim_text, text_sha256, page, block_ids, char_start, char_end, section_id, deleted_at FROM evidence)"
C = "c AS (SELECT DISTINCT paper_id, claim_id, summary, evidence_ids, importance, display_label FROM claims)"
_STRIP = f"regexp_replace(text, '^{T.WS}+|{T.WS}+$', '', 'g')"
_ROLES = ("body", "caption", "formula")
# The words by which section titles and texts tell where a claim belongs, most telling first.
TITLE_RULES = (
    ("conclusion_limitations", r"(?i)\b(conclusion|limitation|future|broader impact|opportunit)\w*\b"),
    ("existing_methods", r"(?i)\b(related work|background|prior work|literature)\b"),
    ("analysis", r"(?i)\b(ablation|analysis|discussion|robustness|sensitivity|case stud|qualitative|error analysis)\b"),
    ("experimental_setup", r"(?i)\b(setup|setting|dataset|metric|baseline|study(?:\s+\d+)?|participants?|procedure|implementation detail)\b"),
    ("main_results", r"(?i)\b(main results?|results?|evaluation|performance|comparison)\b|\b(experiment|result|evaluation|benchmark|ablation|analysis|finding)s?\b"),
    ("motivation", r"(?i)\b(motivation|problem|research question|diagnosis|diagnostic)\b|\bdesign goals?\b"),
    ("training_inference", r"(?i)\b(train|training|inference|objective|loss|optimization|implementation)\b"),
    ("method_overview", r"(?i)\b(overview|framework|architecture|system)\b"),
    ("method_details", r"(?i)\b(method|approach|model|architecture|algorithm|training|objective|implementation)\b"),
    ("research_task", r"(?i)\b(task|problem setup|preliminar)\b|\b(abstract|introduction)\b"),
)
# The words of section titles and texts that the rules for claims ask for.
RELATED = r"(?i)\b(related work|background|prior work|literature)\b"
METHOD_TITLE = r"(?i)\b(method|approach|model|architecture|algorithm|training|objective|implementation)\b"
EXPERIMENT_TITLE = r"(?i)\b(experiment|result|evaluation|benchmark|ablation|analysis|finding)s?\b"
PROBLEM_TITLE = r"(?i)\b(motivation|problem|research question|diagnosis|diagnostic)\b"
TASK_TITLE = r"(?i)\b(task|problem setup|preliminar)\b"
OVERVIEW_TITLE = r"(?i)\b(overview|framework|architecture|system)\b"
TRAINING = r"(?i)\b(train|training|inference|objective|loss|optimization|implementation)\b"
SETUP = r"(?i)\b(setup|setting|dataset|metric|baseline|study(?:\s+\d+)?|participants?|procedure|implementation detail)\b"
RESULT_TITLE = r"(?i)\b(main results?|results?|evaluation|performance|comparison)\b"
ANALYSIS = r"(?i)\b(ablation|analysis|discussion|robustness|sensitivity|case stud|qualitative|error analysis)\b"
CONCLUSION = r"(?i)\b(conclusion|limitation|future|broader impact|opportunit)\w*\b"
PRIOR_WORK = r"(?i)\b(?:previous|prior|earlier|existing|recent)(?:\s+[a-z-]+){0,4}\s+(?:work|approach|method|model|system)s?\b|\bhas been (?:proposed|studied|used)\b"
CITED = r"(?i)\[[0-9,\s-]+\]|\bet al\."
PROPOSES = r"(?i)\bwe\s+(?:propose|present|introduce)\b"
EXPERIMENT = r"(?i)\b(experiments?|experimental|results?|evaluation|benchmark|ablation|accuracy|outperform\w*|performance|metrics?)\b"
METHOD = r"(?i)\b(method|approach|model|architecture|algorithm|train|framework|objective|propos|introduc|comput|concatenat|project|encode|decode|generat|normaliz|optim|update)\w*\b"
PROBLEM = r"(?i)\b(problem|challenge|limitation|motivat|question|gap|failure|difficult|lack|need)\w*\b"
# Each rule: part, then what titles (t) or texts (s) must or must not show; the first that holds counts.
CLAIM_RULES = (
    ("conclusion_limitations", ("t", True, CONCLUSION)),
    ("existing_methods", ("t", True, RELATED)),
    ("analysis", ("t", True, ANALYSIS)),
    ("experimental_setup", ("t", True, SETUP)),
    ("main_results", ("t", True, RESULT_TITLE)),
    ("main_results", ("t", True, EXPERIMENT_TITLE)),
    ("training_inference", ("t", True, TRAINING)),
    ("method_overview", ("t", True, OVERVIEW_TITLE), ("t", True, METHOD_TITLE)),
    ("method_details", ("t", True, METHOD_TITLE)),
    ("motivation", ("t", True, PROBLEM_TITLE), ("s", False, EXPERIMENT)),
    ("research_task", ("t", True, TASK_TITLE)),
    ("existing_methods", ("s", True, PRIOR_WORK), ("s", True, CITED)),
    ("method_overview", ("s", True, PROPOSES)),
    ("conclusion_limitations", ("s", True, CONCLUSION)),
    ("analysis", ("s", True, ANALYSIS)),
    ("experimental_setup", ("s", True, SETUP)),
    ("main_results", ("s", True, EXPERIMENT)),
    ("training_inference", ("s", True, TRAINING)),
    ("method_details", ("s", True, METHOD)),
    ("motivation", ("s", True, PROBLEM)),
)
SLOTS = {"research_task": 4, "method_overview": 4, "method_details": 4, "main_results": 4}


def clean_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "evidence").select("paper_id", "evidence_id", "verbatim_text", "text_sha256", "page", "block_ids", "char_start", "char_end", "section_id", "deleted_at").distinct()


def clean_claims(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "claims").select("paper_id", "claim_id", "summary", "evidence_ids", "importance", "display_label").distinct()


def evidence_build(spark: SparkSession, sf: str) -> DataFrame:
    """One evidence row per content block that is not blank, numbered along the paper, with its hash."""
    b = clean_blocks(spark, sf).withColumn("t", T.strip(F.col("text")))
    content = F.coalesce(F.col("role").isin(*_ROLES) & (F.length("t") > 0), F.lit(False))
    rows = running_sum(b, content, "n").where(content)
    return rows.select("paper_id", F.format_string("evidence:%05d", "n").alias("new_id"), "block_id", "page", F.length("t").alias("char_end"), F.sha2("t", 256).alias("sha256"))


BUILD_SQL = f"""
WITH {B}, t AS (SELECT *, {_STRIP} AS t FROM b)
SELECT paper_id, format('evidence:{{:05d}}', row_number() OVER (PARTITION BY paper_id ORDER BY page, ord)) AS new_id, block_id, page, length(t) AS char_end, sha256(t) AS sha256
FROM t WHERE role IN ('body', 'caption', 'formula') AND t <> ''"""


def rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence with the text its locator names: the blocks of a page, trimmed, joined by a blank, cut."""
    e = clean_evidence(spark, sf)
    ids = e.select("paper_id", "evidence_id", F.posexplode("block_ids").alias("k", "block_id"))
    b = clean_blocks(spark, sf).select("paper_id", "block_id", F.col("page").alias("block_page"), "ord", "bbox", T.strip(F.col("text")).alias("t"))
    parts = ids.join(b, ["paper_id", "block_id"]).groupBy("paper_id", "evidence_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "t", "ord", "block_page"))).alias("p"),
        F.min(G.side(F.col("bbox"), 0)).alias("x0"), F.min(G.side(F.col("bbox"), 1)).alias("y0"), F.max(G.side(F.col("bbox"), 2)).alias("x1"), F.max(G.side(F.col("bbox"), 3)).alias("y1"),
    )
    joined = F.trim(F.array_join("p.t", " "))
    whole = parts.withColumn("joined", joined).withColumn("span", F.element_at("p.ord", -1) - F.element_at("p.ord", 1) + 1)
    return e.join(whole, ["paper_id", "evidence_id"], "left").withColumn("found", F.expr("substring(joined, char_start + 1, char_end - char_start)"))


def evidence_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each evidence row rebuilds from its blocks, and the box around them."""
    r = rebuilt(spark, sf)
    ok = F.coalesce((F.col("found") == F.col("verbatim_text")) & (F.sha2("found", 256) == F.col("text_sha256")) & (F.size("p") == F.size("block_ids")) & (F.col("span") == F.size("block_ids")), F.lit(False))
    return r.select("paper_id", "evidence_id", ok.alias("rebuilds"), "x0", "y0", "x1", "y1")


REBUILD_SQL = f"""
WITH {B}, {E}, i AS (SELECT paper_id, evidence_id, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) AS k FROM e),
p AS (SELECT i.paper_id, evidence_id, trim(string_agg({_STRIP}, ' ' ORDER BY k)) AS joined, count(*) AS n, arg_max(ord, k) - arg_min(ord, k) + 1 AS span,
  min(bbox[1]) AS x0, min(bbox[2]) AS y0, max(bbox[3]) AS x1, max(bbox[4]) AS y1 FROM i JOIN b ON b.paper_id = i.paper_id AND b.block_id = i.block_id GROUP BY ALL),
r AS (SELECT e.*, p.* EXCLUDE (paper_id, evidence_id), substring(joined, char_start + 1, char_end - char_start) AS found FROM e LEFT JOIN p ON p.paper_id = e.paper_id AND p.evidence_id = e.evidence_id)
SELECT paper_id, evidence_id, coalesce(found = verbatim_text AND sha256(found) = text_sha256 AND n = len(block_ids) AND span = len(block_ids), false) AS rebuilds, x0, y0, x1, y1 FROM r"""


def span_to_block(spark: SparkSession, sf: str) -> DataFrame:
    """The first and last block that each evidence span touches, by cumulated lengths."""
    e = clean_evidence(spark, sf)
    ids = e.select("paper_id", "evidence_id", "char_start", "char_end", F.posexplode("block_ids").alias("k", "block_id"))
    b = clean_blocks(spark, sf).select("paper_id", "block_id", F.length(T.strip(F.col("text"))).alias("n"))
    w = Window.partitionBy("paper_id", "evidence_id").orderBy("k")
    j = ids.join(b, ["paper_id", "block_id"]).withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = j.where((F.col("start") < F.col("char_end")) & (F.col("start") + F.col("n") > F.col("char_start")))
    return hit.groupBy("paper_id", "evidence_id").agg(F.min_by("block_id", "k").alias("first_block"), F.max_by("block_id", "k").alias("last_block"))


SPAN_SQL = f"""
WITH {B}, {E}, i AS (SELECT paper_id, evidence_id, char_start, char_end, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) AS k FROM e),
j AS (SELECT i.*, length({_STRIP}) AS n, coalesce(sum(length({_STRIP}) + 1) OVER (PARTITION BY i.paper_id, evidence_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM i JOIN b ON b.paper_id = i.paper_id AND b.block_id = i.block_id)
SELECT paper_id, evidence_id, arg_min(block_id, k) AS first_block, arg_max(block_id, k) AS last_block FROM j WHERE start < char_end AND start + n > char_start GROUP BY ALL"""

_BAD = (r"[=<>≤≥≻]", r"(?i)\b(?:Sec|Fig|Eq)\.$", r"\b[0-9]+[A-Z][a-z]", r":\s+[A-Z][A-Za-z-]*(?:\s+[A-Za-z-]+){0,2}\.$", r"@|\b[A-Z]\.$")


def claims_of(evidence: DataFrame) -> DataFrame:
    """Evidence rows (paper_id, evidence_id, verbatim_text) whose text can stand as a claim, with its importance; null texts cannot."""
    e = evidence.withColumn("s", T.squeeze(F.col("verbatim_text")))
    first = F.regexp_extract("s", r"\p{L}", 0)
    ok = F.length("s").between(35, 1200) & ~first.rlike(r"^\p{Ll}")
    for bad in _BAD:
        ok = ok & ~F.col("s").rlike(bad)
    return e.where(ok).select("paper_id", "evidence_id", F.when(F.col("s").rlike(T.CLAIM_CUE), "primary").otherwise("context").alias("importance"))


def claim_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence whose text can stand as a claim, with its importance."""
    return claims_of(clean_evidence(spark, sf))


_ES = f"trim(regexp_replace(verbatim_text, '{T.WS}+', ' ', 'g'))"
CLAIM_FILTER_SQL = f"""
WITH {E}, t AS (SELECT *, {_ES} AS s FROM e)
SELECT paper_id, evidence_id, CASE WHEN regexp_matches(s, {q(T.CLAIM_CUE)}) THEN 'primary' ELSE 'context' END AS importance
FROM t WHERE length(s) BETWEEN 35 AND 1200 AND NOT regexp_matches(regexp_extract(s, '\\p{{L}}', 0), '^\\p{{Ll}}') AND {" AND ".join(f"NOT regexp_matches(s, {q(p)})" for p in _BAD)}"""


def _route(rules: tuple, c) -> F.Column:
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out


def _route_sql(rules: tuple, c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {q(p)}) THEN '{n}'" for n, p in rules) + " END"


def routed_sections(s: DataFrame) -> DataFrame:
    """The part of the story each section (paper_id, section_no, title) can support; titles that are noise have no row."""
    words = F.regexp_count("title", F.lit(r"[^ ]+"))
    numeric = F.regexp_count("title", F.lit(r"(?:^| )[0-9.,%]+(?= |$)"))
    noise = F.col("title").rlike(r"(?i)@|arXiv") | (numeric * 2 > words)
    return s.where(~noise).select("paper_id", "section_no", _route(TITLE_RULES, F.col("title")).alias("part"))


def section_router(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the reader's story that each section can support, by its title."""
    return routed_sections(section_segments(spark, sf))


SECTION_ROUTER_SQL = f"""
WITH s AS ({SECTION_SQL}) SELECT paper_id, section_no, {_route_sql(TITLE_RULES, "title")} AS part FROM s
WHERE NOT (regexp_matches(title, '(?i)@|arXiv') OR len(list_filter(string_split(title, ' '), lambda x: regexp_full_match(x, '[0-9.,%]+'))) * 2 > len(list_filter(string_split(title, ' '), lambda x: x <> '')))"""


def claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """One row per claim and evidence it names, ids tidied, dead ids left out."""
    c = clean_claims(spark, sf).select("paper_id", "claim_id", "summary", "importance", F.explode(F.transform("evidence_ids", lambda x: F.lower(F.trim(x)))).alias("evidence_id"))
    e = clean_evidence(spark, sf).select("paper_id", "evidence_id", "verbatim_text", "section_id", "page")
    return c.distinct().join(e, ["paper_id", "evidence_id"])


_CE = f"""{E}, {C}, ce AS (SELECT DISTINCT c.paper_id, claim_id, summary, importance, e.evidence_id, verbatim_text, section_id, page
  FROM (SELECT paper_id, claim_id, summary, importance, lower(trim(unnest(evidence_ids))) AS evidence_id FROM c) c JOIN e ON e.paper_id = c.paper_id AND e.evidence_id = c.evidence_id)"""


def claim_router(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the story each claim belongs to, with a mark where nothing tells.

    Titles of the sections that its evidence stands in outrank its words. A claim without
    evidence that is there has no row; null summaries and unknown sections add no words.
    """
    ce = claim_evidence(spark, sf)
    said = ce.groupBy("paper_id", "claim_id").agg(F.first("summary").alias("summary"), F.array_join(F.array_sort(F.collect_list("verbatim_text")), " ").alias("said"))
    at = page_sections(spark, sf).select("paper_id", "page", "title")
    under = ce.select("paper_id", "claim_id", "page").distinct().join(at, PAGE).groupBy("paper_id", "claim_id").agg(F.array_join(F.array_sort(F.collect_set("title")), " ").alias("titles"))
    j = said.join(under, ["paper_id", "claim_id"], "left").withColumn("titles", F.coalesce("titles", F.lit(""))).withColumn("s", F.concat_ws(" ", "summary", "said"))
    tests = {"t": F.col("titles"), "s": F.col("s")}
    part = None
    for name, *needs in CLAIM_RULES:
        hit = F.lit(True)
        for where, wanted, pattern in needs:
            found = tests[where].rlike(pattern)
            hit = hit & (found if wanted else ~found)
        part = F.when(hit, name) if part is None else part.when(hit, name)
    return j.select("paper_id", "claim_id", F.coalesce(part, F.lit("research_task")).alias("part"), part.isNull().alias("fallback"))


_CLAIM_CASE = "CASE " + " ".join(
    "WHEN " + " AND ".join(("" if wanted else "NOT ") + f"regexp_matches({'titles' if where == 't' else 's'}, {q(p)})" for where, wanted, p in needs) + f" THEN '{name}'" for name, *needs in CLAIM_RULES
) + " END"
CLAIM_ROUTER_SQL = f"""
WITH {_CE}, heads AS ({PAGE_SECTION_SQL}), t AS (SELECT ce.paper_id, claim_id, concat_ws(' ', any_value(summary), string_agg(verbatim_text, ' ' ORDER BY verbatim_text)) AS s FROM ce GROUP BY ALL),
u AS (SELECT paper_id, claim_id, string_agg(title, ' ' ORDER BY title) AS titles FROM (SELECT DISTINCT ce.paper_id, claim_id, title FROM ce JOIN heads ON heads.paper_id = ce.paper_id AND heads.page = ce.page) GROUP BY ALL),
j AS (SELECT t.paper_id, t.claim_id, s, coalesce(titles, '') AS titles FROM t LEFT JOIN u ON u.paper_id = t.paper_id AND u.claim_id = t.claim_id),
r AS (SELECT paper_id, claim_id, {_CLAIM_CASE} AS p FROM j)
SELECT paper_id, claim_id, coalesce(p, 'research_task') AS part, p IS NULL AS fallback FROM r"""


def top2_per_section(spark: SparkSession, sf: str) -> DataFrame:
    """The first two evidence rows of each section, those with a cue first; equal texts count once."""
    e = clean_evidence(spark, sf).where("section_id is not null").withColumn("fp", T.spaced_fingerprint(F.col("verbatim_text")))
    cue = ~F.col("verbatim_text").rlike(T.CLAIM_CUE)
    once = e.groupBy("paper_id", "section_id", "fp").agg(F.min(F.struct(cue.alias("late"), "page", "evidence_id", "char_start")).alias("k"))
    w = Window.partitionBy("paper_id", "section_id").orderBy("k")
    return once.withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("paper_id", "section_id", F.col("k.evidence_id").alias("evidence_id"), "rank")


_FP = f"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(verbatim_text), 'ß', 'ss'), '\\[[0-9,\\s-]+\\]', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g'), '{T.WS}+', ' ', 'g'))"
TOP2_SQL = f"""
WITH {E}, k AS (SELECT *, {_FP} AS fp, NOT regexp_matches(verbatim_text, {q(T.CLAIM_CUE)}) AS late FROM e WHERE section_id IS NOT NULL),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY paper_id, section_id, fp ORDER BY late, page, evidence_id, char_start) = 1)
SELECT paper_id, section_id, evidence_id, row_number() OVER (PARTITION BY paper_id, section_id ORDER BY late, page, evidence_id, char_start) AS rank FROM o QUALIFY rank <= 2"""


def slot_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Claims placed into the story, up to the number of places each part has."""
    r = claim_router(spark, sf)
    most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv]), F.col("part")), F.lit(3))
    w = Window.partitionBy("paper_id", "part").orderBy("claim_id")
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("paper_id", "part", "claim_id", "place")


SLOT_SQL = f"""
WITH r AS ({CLAIM_ROUTER_SQL}) SELECT paper_id, part, claim_id, row_number() OVER (PARTITION BY paper_id, part ORDER BY claim_id) AS place FROM r
QUALIFY place <= CASE WHEN part IN ({", ".join(q(k) for k in SLOTS)}) THEN 4 ELSE 3 END"""


def digest_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """For each paper the claim that best states its result: words of results, then brevity."""
    c = clean_claims(spark, sf).where("summary is not null")
    score = F.col("summary").rlike(r"(?i)\b(result|significant|outperform|improv|accuracy|score|less time|higher|lower|evaluation)\w*\b").cast("int") * 3
    best = c.groupBy("paper_id").agg(F.min(F.struct((-score).alias("s"), F.length("summary").alias("n"), "claim_id")).alias("b"))
    return best.select("paper_id", F.col("b.claim_id").alias("claim_id"), (-F.col("b.s")).alias("score"))


DIGEST_SQL = f"""
WITH {C}, s AS (SELECT *, CASE WHEN regexp_matches(summary, '(?i)\\b(result|significant|outperform|improv|accuracy|score|less time|higher|lower|evaluation)\\w*\\b') THEN 3 ELSE 0 END AS score FROM c WHERE summary IS NOT NULL)
SELECT paper_id, claim_id, score FROM s QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY -score, length(summary), claim_id) = 1"""


def duplicate_text(spark: SparkSession, sf: str) -> DataFrame:
    """Normal forms of long texts that several documents share."""
    d = table(spark, sf, "documents").withColumn("norm", T.squeeze(T.fold_case(F.col("text")))).where("length(norm) >= 60")
    return d.groupBy(F.sha2("norm", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_doc")).where("n_documents > 1")


DUPLICATE_SQL = f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '{T.WS}+', ' ', 'g')) AS norm FROM documents)
SELECT sha256(norm) AS digest, count(*) AS n_documents, min(doc_id) AS first_doc FROM d WHERE length(norm) >= 60 GROUP BY ALL HAVING count(*) > 1"""


def text_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    c = clean_claims(spark, sf).where("summary is not null")
    return c.select("paper_id", "claim_id", T.fingerprint(F.col("summary")).alias("tight"), T.spaced_fingerprint(F.col("summary")).alias("spaced"), T.complete_sentence(F.col("summary")).alias("sentence"))


FINGERPRINT_SQL = f"""
WITH {C}, s AS (SELECT *, rtrim(substring(trim(summary), 1, 1200)) AS v, {_FP.replace("verbatim_text", "summary")} AS spaced FROM c WHERE summary IS NOT NULL)
SELECT paper_id, claim_id, regexp_replace(replace(lower(trim(regexp_replace(summary, '{T.WS}+', ' ', 'g'))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', '', 'g') AS tight, spaced,
  CASE WHEN length(v) >= 20 AND NOT regexp_matches(v, '(…|\\.\\.\\.|-|—|:|;|,)$') THEN CASE WHEN regexp_matches(v, '[.!?。！？]["''”’]? *$') THEN v ELSE v || '.' END END AS sentence FROM s"""


def evidence_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence rows that say the same at the same place; the first id of each stands for all."""
    e = clean_evidence(spark, sf)
    g = e.groupBy("paper_id", "page", "block_ids", "char_start", "char_end", "text_sha256").agg(F.min("evidence_id").alias("kept_id"), F.count(F.lit(1)).alias("n_rows"))
    return g.select("paper_id", "kept_id", "n_rows")


REUSE_SQL = f"WITH {E} SELECT paper_id, min(evidence_id) AS kept_id, count(*) AS n_rows FROM e GROUP BY paper_id, page, block_ids, char_start, char_end, text_sha256"


def body_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence all of whose blocks are body text: only such evidence may be shown as a target."""
    e = clean_evidence(spark, sf).select("paper_id", "evidence_id", F.size("block_ids").alias("n"), F.explode("block_ids").alias("block_id"))
    b = clean_blocks(spark, sf).where("role = 'body'").select("paper_id", "block_id")
    return e.join(b, ["paper_id", "block_id"]).groupBy("paper_id", "evidence_id", "n").count().where("count = n").select("paper_id", "evidence_id")


BODY_SQL = f"""
WITH {B}, {E}, i AS (SELECT paper_id, evidence_id, len(block_ids) AS n, unnest(block_ids) AS block_id FROM e)
SELECT i.paper_id, evidence_id FROM i JOIN b ON b.paper_id = i.paper_id AND b.block_id = i.block_id AND role = 'body' GROUP BY i.paper_id, evidence_id, n HAVING count(*) = n"""


def source_map(spark: SparkSession, sf: str) -> DataFrame:
    """The rectangle of each evidence row in fractions of its page."""
    r = rebuilt(spark, sf).where("x0 is not null")
    return r.select("paper_id", "evidence_id", "page", G.relative(F.array("x0", "y0", "x1", "y1")).alias("r")).select("paper_id", "evidence_id", "page", "r.*")


SOURCE_MAP_SQL = f"""
WITH {B}, {E}, i AS (SELECT paper_id, evidence_id, page, unnest(block_ids) AS block_id FROM e),
p AS (SELECT i.paper_id, evidence_id, i.page, greatest(0, min(bbox[1]) - 1.5) AS x0, greatest(0, min(bbox[2]) - 1.5) AS y0, least(600, max(bbox[3]) + 1.5) AS x1, least(800, max(bbox[4]) + 1.5) AS y1
  FROM i JOIN b ON b.paper_id = i.paper_id AND b.block_id = i.block_id GROUP BY ALL)
SELECT paper_id, evidence_id, page, round_even(x0 / 600, 6) AS x, round_even(y0 / 800, 6) AS y, round_even(greatest(1, x1 - x0) / 600, 6) AS width, round_even(greatest(1, y1 - y0) / 800, 6) AS height FROM p"""


def click_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """For each claim the block of its first evidence's page that reads most like it, above a least likeness."""
    first = claim_evidence(spark, sf).where("summary is not null").groupBy("paper_id", "claim_id").agg(F.min(F.struct("evidence_id", "page", "summary")).alias("f"))
    b = clean_blocks(spark, sf).where("text is not null").select("paper_id", "page", "block_id", "ord", T.source_key(F.col("text")).alias("kb"))
    j = first.select("paper_id", "claim_id", F.col("f.page").alias("page"), T.source_key(F.col("f.summary")).alias("ka")).join(b, PAGE)
    s = j.withColumn("score", F.bround(T.similarity(F.col("ka"), F.col("kb")), 9))
    best = s.groupBy("paper_id", "claim_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "block_id")).alias("m"), F.min(F.struct("ord", "block_id")).alias("f"))
    near = -F.col("m.s") >= 0.18
    return best.select("paper_id", "claim_id", F.when(near, F.col("m.block_id")).otherwise(F.col("f.block_id")).alias("block_id"), F.when(near, "content-match").otherwise("page-type").alias("matched_by"))


def semantic_titles(spark: SparkSession, sf: str) -> DataFrame:
    c = clean_claims(spark, sf)
    return c.select("paper_id", "claim_id", T.short_title(F.col("summary"), 40).alias("title"))


def readable_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence texts in readable form: hyphens at line ends, glued words and run-in headings repaired."""

    @F.pandas_udf("string")
    def readable(s: pd.Series) -> pd.Series:
        return s.map(claim_summary, na_action="ignore")

    return clean_evidence(spark, sf).select("paper_id", "evidence_id", readable("verbatim_text").alias("summary"))


def evidence_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Complete sentences of evidence with half-open offsets; a tail without final mark is left out."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def spans(s: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in sentence_spans(x)] if isinstance(x, str) else [] for x in s])

    return clean_evidence(spark, sf).select("paper_id", "evidence_id", F.explode(spans("verbatim_text")).alias("s")).select("paper_id", "evidence_id", "s.start", "s.end")


def claims_dedup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of a section kept one after the other unless nearly equal to one kept before.

    Equal fingerprints collapse by a plain aggregate first; sections are small, so the
    greedy pass has few distinct texts per group.
    """
    ce = claim_evidence(spark, sf).where("summary is not null").withColumn("fp", T.spaced_fingerprint(F.col("summary")))
    ce = ce.withColumn("section_id", F.coalesce("section_id", F.format_string("page:%d", "page")))
    once = ce.groupBy("paper_id", "section_id", "fp").agg(F.min("claim_id").alias("claim_id"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = Kept()
        rows = []
        for r in pdf.sort_values("claim_id").itertuples():
            if r.fp and not kept.holds(r.fp):
                kept.add(r.fp)
                rows.append(r.Index)
        return pdf.loc[rows, ["paper_id", "section_id", "claim_id"]]

    return once.groupBy("paper_id", "section_id").applyInPandas(keep, "paper_id string, section_id string, claim_id string")


QUERIES = {f.__name__: f for f in (
    evidence_build, evidence_rebuild, span_to_block, claim_filter, section_router, claim_router, top2_per_section, slot_limit, digest_argmax, duplicate_text,
    text_fingerprints, evidence_reuse, body_evidence, source_map, click_resolution, semantic_titles, readable_claims, evidence_sentences, claims_dedup_greedy,
)}
SQL = {
    "evidence_build": BUILD_SQL, "evidence_rebuild": REBUILD_SQL, "span_to_block": SPAN_SQL, "claim_filter": CLAIM_FILTER_SQL, "section_router": SECTION_ROUTER_SQL,
    "claim_router": CLAIM_ROUTER_SQL, "top2_per_section": TOP2_SQL, "slot_limit": SLOT_SQL, "digest_argmax": DIGEST_SQL, "duplicate_text": DUPLICATE_SQL,
    "text_fingerprints": FINGERPRINT_SQL, "evidence_reuse": REUSE_SQL, "body_evidence": BODY_SQL, "source_map": SOURCE_MAP_SQL,
}
