"""Queries on the graph of claims, evidence and sources: edges, closure, layouts, upserts, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators.ordering import clean_blocks, numbered
from scholiast.plans.citations import M, R, clean_citations, clean_records
from scholiast.plans.evidence import C, E, claim_evidence, clean_claims, clean_evidence, rebuilt
from scholiast.plans.layout import B, SECTION_CTE, headings
from scholiast.runtime import materialize, table

P = "p AS (SELECT DISTINCT paper_id, provenance_id, owner_id, kind, agent, source_ids, verification FROM provenance)"


def clean_provenance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "provenance").select("paper_id", "provenance_id", "owner_id", "kind", "agent", "source_ids", "verification").distinct()


def _ids(c: str):
    return F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x != "", F.lit(False)))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """All references among entities as typed edges (paper_id, type, source_id, target_id)."""
    supports = clean_claims(spark, sf).select("paper_id", F.lit("supports").alias("type"), F.explode(_ids("evidence_ids")).alias("source_id"), F.lower("claim_id").alias("target_id"))
    cites = clean_citations(spark, sf).select("paper_id", F.lit("cites").alias("type"), F.explode(_ids("cited_in_evidence_ids")).alias("source_id"), F.lower("citation_id").alias("target_id"))
    derived = clean_provenance(spark, sf).select("paper_id", F.lit("derived_from").alias("type"), F.lower("owner_id").alias("source_id"), F.explode(_ids("source_ids")).alias("target_id"))
    return supports.unionByName(cites).unionByName(derived).where("source_id is not null and target_id is not null").distinct()


EDGE_CTE = f"""{C}, {R}, {P}, ed AS (SELECT DISTINCT * FROM (
  SELECT paper_id, 'supports' AS type, lower(trim(unnest(evidence_ids))) AS source_id, lower(claim_id) AS target_id FROM c
  UNION ALL SELECT paper_id, 'cites', lower(trim(unnest(cited_in_evidence_ids))), lower(citation_id) FROM r
  UNION ALL SELECT paper_id, 'derived_from', lower(owner_id), lower(trim(unnest(source_ids))) FROM p) WHERE source_id <> '' AND target_id <> '')"""
EDGE_SQL = f"WITH {EDGE_CTE} SELECT * FROM ed"


def evidence_closure(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence each provenance owner rests on, through any number of references; cycles end where they meet.

    Every round joins only the pairs found in the last one and drops those seen before,
    so it ends when nothing new is reached, at whatever depth.
    """
    e = edges(spark, sf)
    refs = e.where("type = 'derived_from'").select("paper_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    refs = materialize(refs.unionByName(e.where("type <> 'derived_from'").select("paper_id", F.col("target_id").alias("a"), F.col("source_id").alias("b"))).where("a <> b").distinct())
    owners = e.where("type = 'derived_from'").select("paper_id", F.col("source_id").alias("owner_id")).distinct()
    front = materialize(owners.join(refs.withColumnRenamed("a", "owner_id"), ["paper_id", "owner_id"]).select("paper_id", "owner_id", F.col("b").alias("at")).distinct())
    seen = front
    while True:
        step = front.join(refs.withColumnRenamed("a", "at"), ["paper_id", "at"]).select("paper_id", "owner_id", F.col("b").alias("at")).distinct()
        front = materialize(step.join(seen, ["paper_id", "owner_id", "at"], "left_anti"))
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front))
    known = clean_evidence(spark, sf).select("paper_id", F.lower("evidence_id").alias("at")).distinct()
    return seen.join(known, ["paper_id", "at"], "left_semi").select("paper_id", "owner_id", F.col("at").alias("evidence_id"))


CLOSURE_SQL = f"""
WITH RECURSIVE {EDGE_CTE}, {E}, refs AS (SELECT DISTINCT * FROM (SELECT paper_id, source_id AS a, target_id AS b FROM ed WHERE type = 'derived_from'
  UNION ALL SELECT paper_id, target_id, source_id FROM ed WHERE type <> 'derived_from') WHERE a <> b),
w AS (SELECT o.paper_id, o.owner_id, refs.b FROM (SELECT DISTINCT paper_id, source_id AS owner_id FROM ed WHERE type = 'derived_from') o JOIN refs ON refs.paper_id = o.paper_id AND refs.a = o.owner_id
  UNION SELECT w.paper_id, w.owner_id, refs.b FROM w JOIN refs ON refs.paper_id = w.paper_id AND refs.a = w.b)
SELECT DISTINCT paper_id, owner_id, b AS evidence_id FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.paper_id = w.paper_id AND lower(e.evidence_id) = w.b)"""


def lane_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Provider lanes one below the other: works in rows of three, lane heights by their number; records without title or provider have no place."""
    m = clean_records(spark, sf).where("title is not null and provider is not null").select("provider", "record_id")
    n = m.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    # one row per provider: the lanes themselves are few
    height = F.greatest(F.lit(150), 72 + F.ceil(F.col("n") / 3) * 88)
    lanes = n.withColumn("height", height).withColumn("top", F.coalesce(F.sum(F.col("height") + 18).over(Window.orderBy("provider").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = numbered(m, ["provider"], [F.col("record_id")], "i").join(lanes, "provider")
    return placed.select("provider", "record_id", (F.pmod("i", F.lit(3)) * 265).cast("int").alias("x"), (F.col("top") + 72 + F.floor(F.col("i") / 3) * 88).cast("int").alias("y"))


LANE_SQL = f"""
WITH {M}, k AS (SELECT provider, record_id, row_number() OVER (PARTITION BY provider ORDER BY record_id) - 1 AS i FROM m WHERE title IS NOT NULL AND provider IS NOT NULL),
n AS (SELECT provider, greatest(150, 72 + CAST(ceil(count(*) / 3) AS BIGINT) * 88) AS height FROM k GROUP BY ALL),
l AS (SELECT provider, coalesce(sum(height + 18) OVER (ORDER BY provider ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM n)
SELECT provider, record_id, i % 3 * 265 AS x, CAST(top + 72 + i // 3 * 88 AS INT) AS y FROM k JOIN l USING (provider)"""


def layered_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Claims in a left and their evidence in a right column, evenly spread, for each section."""
    ce = claim_evidence(spark, sf).where("section_id is not null")
    out = None
    for layer, key, x in (("claim", "claim_id", 80), ("evidence", "evidence_id", 620)):
        nodes = ce.select("paper_id", "section_id", F.col(key).alias("node_id")).distinct()
        by = Window.partitionBy("paper_id", "section_id")
        i, n = F.row_number().over(by.orderBy("node_id")), F.count(F.lit(1)).over(by)
        part = nodes.select("paper_id", "section_id", F.lit(layer).alias("layer"), "node_id", F.lit(x).alias("x"), F.bround(90 + i * 420 / (n + 1), 6).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


LAYERED_SQL = f"""
WITH {E}, {C}, ce AS (SELECT DISTINCT c.paper_id, claim_id, e.evidence_id, section_id FROM (SELECT paper_id, claim_id, lower(trim(unnest(evidence_ids))) AS evidence_id FROM c) c
  JOIN e ON e.paper_id = c.paper_id AND e.evidence_id = c.evidence_id WHERE section_id IS NOT NULL),
n AS (SELECT DISTINCT paper_id, section_id, 'claim' AS layer, claim_id AS node_id, 80 AS x FROM ce UNION ALL SELECT DISTINCT paper_id, section_id, 'evidence', evidence_id, 620 FROM ce)
SELECT paper_id, section_id, layer, node_id, x, round_even(90 + row_number() OVER (PARTITION BY paper_id, section_id, layer ORDER BY node_id) * 420 / (count(*) OVER (PARTITION BY paper_id, section_id, layer) + 1), 6) AS y FROM n"""


def edge_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Start and end of every line from a claim to its evidence in the layered layout."""
    nodes = layered_layout(spark, sf)
    ce = claim_evidence(spark, sf).select("paper_id", "section_id", "claim_id", "evidence_id").distinct()
    left = nodes.where("layer = 'claim'").select("paper_id", "section_id", F.col("node_id").alias("claim_id"), F.col("y").alias("y1"))
    right = nodes.where("layer = 'evidence'").select("paper_id", "section_id", F.col("node_id").alias("evidence_id"), F.col("y").alias("y2"))
    return ce.join(left, ["paper_id", "section_id", "claim_id"]).join(right, ["paper_id", "section_id", "evidence_id"])


ENDPOINT_SQL = f"""
WITH l AS ({LAYERED_SQL}), {E}, {C}, ce AS (SELECT DISTINCT c.paper_id, claim_id, e.evidence_id, section_id FROM (SELECT paper_id, claim_id, lower(trim(unnest(evidence_ids))) AS evidence_id FROM c) c
  JOIN e ON e.paper_id = c.paper_id AND e.evidence_id = c.evidence_id WHERE section_id IS NOT NULL)
SELECT ce.paper_id, ce.section_id, claim_id, evidence_id, a.y AS y1, b.y AS y2 FROM ce JOIN l a ON a.layer = 'claim' AND a.paper_id = ce.paper_id AND a.section_id = ce.section_id AND a.node_id = claim_id
JOIN l b ON b.layer = 'evidence' AND b.paper_id = ce.paper_id AND b.section_id = ce.section_id AND b.node_id = evidence_id"""


def entity_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Customers after a patch: some removed, some with a new balance, some added, the rest unchanged."""
    base = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    n = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    patch = n.select((F.col("k") * 3).alias("c_custkey"), F.when(F.col("k") % 2 == 0, F.col("name")).alias("p_name"), F.col("bal").alias("p_bal"), (F.col("k") % 5 == 0).alias("removed"))
    j = base.withColumn("old", F.lit(True)).join(patch, "c_custkey", "full")
    return j.where(~F.coalesce("removed", F.lit(False))).select("c_custkey", F.coalesce("p_name", "c_name").alias("c_name"), F.coalesce("p_bal", "c_acctbal").alias("c_acctbal"), F.col("old").isNull().alias("added"))


UPSERT_SQL = """
WITH patch AS (SELECT s_suppkey * 3 AS c_custkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS p_name, s_acctbal AS p_bal, s_suppkey % 5 = 0 AS removed FROM supplier)
SELECT coalesce(c.c_custkey, p.c_custkey) AS c_custkey, coalesce(p_name, c_name) AS c_name, coalesce(p_bal, c_acctbal) AS c_acctbal, c.c_custkey IS NULL AS added
FROM customer c FULL JOIN patch p ON c.c_custkey = p.c_custkey WHERE NOT coalesce(removed, false)"""


def registry_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence that is named but unknown, and known but never named."""
    named = edges(spark, sf).where("type in ('supports', 'cites')").select("paper_id", F.col("source_id").alias("evidence_id")).distinct()
    known = clean_evidence(spark, sf).select("paper_id", F.lower("evidence_id").alias("evidence_id")).distinct()
    unknown = named.join(known, ["paper_id", "evidence_id"], "left_anti").withColumn("problem", F.lit("unknown"))
    return unknown.unionByName(known.join(named, ["paper_id", "evidence_id"], "left_anti").withColumn("problem", F.lit("unused")))


DIFF_SQL = f"""
WITH {EDGE_CTE}, {E}, n AS (SELECT DISTINCT paper_id, source_id AS evidence_id FROM ed WHERE type IN ('supports', 'cites')), k AS (SELECT DISTINCT paper_id, lower(evidence_id) AS evidence_id FROM e)
SELECT *, 'unknown' AS problem FROM (SELECT * FROM n EXCEPT SELECT * FROM k) UNION ALL SELECT *, 'unused' FROM (SELECT * FROM k EXCEPT SELECT * FROM n)"""


def violations(spark: SparkSession, sf: str) -> DataFrame:
    """All broken rules of the model as (rule, paper_id, id)."""
    b, e, c, p = clean_blocks(spark, sf), clean_evidence(spark, sf), clean_claims(spark, sf), clean_provenance(spark, sf)
    row = lambda df, rule, key: df.select(F.lit(rule).alias("rule"), "paper_id", F.col(key).cast("string").alias("id"))
    box = F.col("bbox")
    parts = [
        row(b.groupBy("paper_id", "page", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("k")).where("n > 1"), "order taken twice", "k"),
        row(b.groupBy("paper_id", "block_id").count().where("count > 1"), "block id taken twice", "block_id"),
        row(b.where(box.isNotNull() & ((F.get(box, 0) < 0) | (F.get(box, 2) > 600) | (F.get(box, 1) < 0) | (F.get(box, 3) > 800) | (F.get(box, 0) > F.get(box, 2)) | (F.get(box, 1) > F.get(box, 3)))), "box off the page", "block_id"),
        row(b.where(~F.col("block_id").rlike("^block:p[0-9]{4}:[0-9]{4}$")), "malformed block id", "block_id"),
        row(e.where("char_end <= char_start or char_start < 0"), "empty span", "evidence_id"),
        row(rebuilt(spark, sf).where("coalesce(found = verbatim_text and sha2(found, 256) = text_sha256, false) = false"), "evidence does not rebuild", "evidence_id"),
        row(e.where(F.sha2("verbatim_text", 256) != F.col("text_sha256")), "hash differs", "evidence_id"),
        row(c.where("summary is null or trim(summary) = ''"), "claim without text", "claim_id"),
        row(c.where("importance is null or importance not in ('primary', 'secondary', 'context')"), "unknown importance", "claim_id"),
        row(c.where(F.size(_ids("evidence_ids")) <= 0), "claim without evidence", "claim_id"),
        row(p.where("kind is null or source_ids is null"), "provenance without source", "provenance_id"),
        row(registry_diff(spark, sf).where("problem = 'unknown'"), "unknown evidence", "evidence_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def gate_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each rule is broken; rules that hold have no row."""
    return violations(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("paper_id").alias("n_papers"))


VIOLATION_SQL = f"""
WITH {EDGE_CTE}, {B}, {E}, i AS (SELECT paper_id, evidence_id, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) AS k FROM e),
j AS (SELECT i.paper_id, evidence_id, trim(string_agg(regexp_replace(text, '^{T.WS}+|{T.WS}+$', '', 'g'), ' ' ORDER BY k)) AS joined FROM i JOIN b ON b.paper_id = i.paper_id AND b.block_id = i.block_id GROUP BY ALL),
f AS (SELECT e.paper_id, e.evidence_id, verbatim_text, text_sha256, substring(joined, char_start + 1, char_end - char_start) AS found FROM e LEFT JOIN j ON j.paper_id = e.paper_id AND j.evidence_id = e.evidence_id),
v AS (SELECT 'order taken twice' AS rule, paper_id, min(block_id) AS id FROM b GROUP BY paper_id, page, ord HAVING count(*) > 1
UNION ALL SELECT 'block id taken twice', paper_id, block_id FROM b GROUP BY paper_id, block_id HAVING count(*) > 1
UNION ALL SELECT 'box off the page', paper_id, block_id FROM b WHERE bbox IS NOT NULL AND (bbox[1] < 0 OR bbox[3] > 600 OR bbox[2] < 0 OR bbox[4] > 800 OR bbox[1] > bbox[3] OR bbox[2] > bbox[4])
UNION ALL SELECT 'malformed block id', paper_id, block_id FROM b WHERE NOT regexp_matches(block_id, '^block:p[0-9]{{4}}:[0-9]{{4}}$')
UNION ALL SELECT 'empty span', paper_id, evidence_id FROM e WHERE char_end <= char_start OR char_start < 0
UNION ALL SELECT 'evidence does not rebuild', paper_id, evidence_id FROM f WHERE NOT coalesce(found = verbatim_text AND sha256(found) = text_sha256, false)
UNION ALL SELECT 'hash differs', paper_id, evidence_id FROM e WHERE sha256(verbatim_text) <> text_sha256
UNION ALL SELECT 'claim without text', paper_id, claim_id FROM c WHERE summary IS NULL OR trim(summary) = ''
UNION ALL SELECT 'unknown importance', paper_id, claim_id FROM c WHERE importance IS NULL OR importance NOT IN ('primary', 'secondary', 'context')
UNION ALL SELECT 'claim without evidence', paper_id, claim_id FROM c WHERE coalesce(len(list_filter(evidence_ids, lambda x: trim(x) <> '')), 0) = 0
UNION ALL SELECT 'provenance without source', paper_id, provenance_id FROM p WHERE kind IS NULL OR source_ids IS NULL
UNION ALL SELECT 'unknown evidence', paper_id, source_id FROM (SELECT DISTINCT paper_id, source_id FROM ed WHERE type IN ('supports', 'cites')) n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.paper_id = n.paper_id AND lower(e.evidence_id) = n.source_id))
SELECT DISTINCT * FROM v"""
GATE_SQL = f"WITH w AS ({VIOLATION_SQL}) SELECT rule, count(*) AS n, count(DISTINCT paper_id) AS n_papers FROM w GROUP BY ALL"


def section_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Papers without any heading although they hold body text."""
    h = headings(spark, sf)
    return h.groupBy("paper_id").agg(F.max(F.col("is_heading").cast("int")).alias("h"), F.count_if(F.col("role") == "body").alias("n_body")).where("h = 0 and n_body > 0").select("paper_id", "n_body")


SECTION_GATE_SQL = f"WITH {SECTION_CTE} SELECT paper_id, count(*) FILTER (role = 'body') AS n_body FROM n GROUP BY paper_id HAVING max(is_heading::INT) = 0 AND count(*) FILTER (role = 'body') > 0"


def provenance_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Claims whose label and provenance disagree on whether they are excerpts."""
    c = clean_claims(spark, sf).select("paper_id", F.col("claim_id").alias("owner_id"), F.when(F.col("display_label") == "原文摘录", "paper_excerpt").otherwise("generated_summary").alias("by_label"))
    p = clean_provenance(spark, sf).where("kind in ('paper_excerpt', 'generated_summary')").select("paper_id", "owner_id", "provenance_id", "kind")
    return p.join(c, ["paper_id", "owner_id"]).where("kind <> by_label").select("paper_id", "provenance_id", "kind", "by_label")


AGREEMENT_SQL = f"""
WITH {C}, {P} SELECT p.paper_id, provenance_id, kind, CASE WHEN display_label = '原文摘录' THEN 'paper_excerpt' ELSE 'generated_summary' END AS by_label
FROM p JOIN c ON c.paper_id = p.paper_id AND c.claim_id = p.owner_id WHERE kind IN ('paper_excerpt', 'generated_summary') AND kind <> CASE WHEN display_label = '原文摘录' THEN 'paper_excerpt' ELSE 'generated_summary' END"""


def coverage_facets(spark: SparkSession, sf: str) -> DataFrame:
    """For each paper which kinds of provenance cover it, with their numbers."""
    p = clean_provenance(spark, sf).where("kind is not null")
    return p.groupBy("paper_id", "kind").agg(F.count_distinct("owner_id").alias("n_owners"), F.when(F.max((F.col("verification") == "verified").cast("int")) == 1, "covered").otherwise("fallback").alias("status"))


COVERAGE_SQL = f"WITH {P} SELECT paper_id, kind, count(DISTINCT owner_id) AS n_owners, CASE WHEN max((verification = 'verified')::INT) = 1 THEN 'covered' ELSE 'fallback' END AS status FROM p WHERE kind IS NOT NULL GROUP BY ALL"


def placement_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Owners that stand in several provenance rows of one kind."""
    p = clean_provenance(spark, sf)
    return p.groupBy("paper_id", "owner_id", "kind").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


PLACEMENT_SQL = f"WITH {P} SELECT paper_id, owner_id, kind, count(*) AS n FROM p GROUP BY ALL HAVING count(*) > 1"


def flow_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges both of whose ends are owners with provenance of their own."""
    e = edges(spark, sf).where("type = 'derived_from'")
    own = e.select("paper_id", F.col("source_id").alias("target_id")).distinct()
    return e.join(own, ["paper_id", "target_id"], "left_semi").select("paper_id", "source_id", "target_id")


FLOW_SQL = f"WITH {EDGE_CTE}, d AS (SELECT * FROM ed WHERE type = 'derived_from') SELECT paper_id, source_id, target_id FROM d WHERE EXISTS (SELECT 1 FROM d x WHERE x.paper_id = d.paper_id AND x.source_id = d.target_id)"

QUERIES = {f.__name__: f for f in (
    evidence_closure, lane_layout, layered_layout, edge_endpoints, entity_upsert, registry_diff, violations, gate_counts, section_gate, provenance_agreement,
    coverage_facets, placement_unique, flow_graph,
)} | {"relation_edges": edges}
SQL = {
    "relation_edges": EDGE_SQL, "evidence_closure": CLOSURE_SQL, "lane_layout": LANE_SQL, "layered_layout": LAYERED_SQL, "edge_endpoints": ENDPOINT_SQL, "entity_upsert": UPSERT_SQL,
    "registry_diff": DIFF_SQL, "violations": VIOLATION_SQL, "gate_counts": GATE_SQL, "section_gate": SECTION_GATE_SQL, "provenance_agreement": AGREEMENT_SQL,
    "coverage_facets": COVERAGE_SQL, "placement_unique": PLACEMENT_SQL, "flow_graph": FLOW_SQL,
}
