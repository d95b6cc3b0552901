"""Queries that lay out a page per paper: plan items, placements, components, hubs, and their contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholiast.functions import geometry as G
from scholiast.functions import text as T
from scholiast.operators.ordering import PAGE, clean_blocks
from scholiast.plans.citations import GRAPH_SQL, provenance_graph
from scholiast.plans.evidence import BODY_SQL, C, E, SLOT_SQL, TITLE_RULES, body_evidence, claim_evidence, clean_claims, clean_evidence, slot_limit
from scholiast.plans.layout import B, q
from scholiast.runtime import table

_CE = f"""ce AS (SELECT DISTINCT c.paper_id, claim_id, e.evidence_id, e.page, length(verbatim_text) AS n FROM (SELECT paper_id, claim_id, lower(trim(unnest(evidence_ids))) AS evidence_id FROM c) c
  JOIN e ON e.paper_id = c.paper_id AND e.evidence_id = c.evidence_id)"""


def plan_items(spark: SparkSession, sf: str) -> DataFrame:
    """What each paper's page tells: claims in their places, with the evidence they rest on."""
    ce = claim_evidence(spark, sf).groupBy("paper_id", "claim_id").agg(F.count_distinct("evidence_id").alias("n_evidence"), F.min("evidence_id").alias("first_evidence"))
    return slot_limit(spark, sf).join(ce, ["paper_id", "claim_id"]).select("paper_id", F.concat_ws("-", F.lit("content:item"), "part", "place").alias("item_id"), "part", "place", "claim_id", "n_evidence", "first_evidence")


ITEM_SQL = f"""
WITH s AS ({SLOT_SQL}), {E}, {C}, {_CE}, k AS (SELECT paper_id, claim_id, count(DISTINCT evidence_id) AS n_evidence, min(evidence_id) AS first_evidence FROM ce GROUP BY ALL)
SELECT s.paper_id, 'content:item-' || part || '-' || place AS item_id, part, place, s.claim_id, n_evidence, first_evidence FROM s JOIN k ON k.paper_id = s.paper_id AND k.claim_id = s.claim_id"""


def plan_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Each part of each paper's page: complete, told without a telling word, or without content."""
    items = plan_items(spark, sf).groupBy("paper_id", "part").agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.array(*(F.lit(p) for p, _ in TITLE_RULES))).alias("part")
    whole = clean_claims(spark, sf).select("paper_id").distinct().select("paper_id", every)
    return whole.join(items, ["paper_id", "part"], "left").select("paper_id", "part", F.coalesce("n", F.lit(0)).alias("n_items"), F.when(F.col("n") > 0, "complete").otherwise("unavailable").alias("status"))


_PARTS = ", ".join(q(p) for p, _ in TITLE_RULES)
PLAN_SECTION_SQL = f"""
WITH i AS ({ITEM_SQL}), g AS (SELECT paper_id, part, count(*) AS n FROM i GROUP BY ALL), p AS (SELECT DISTINCT paper_id FROM claims), w AS (SELECT paper_id, unnest([{_PARTS}]) AS part FROM p)
SELECT w.paper_id, w.part, coalesce(n, 0) AS n_items, CASE WHEN n > 0 THEN 'complete' ELSE 'unavailable' END AS status FROM w LEFT JOIN g ON g.paper_id = w.paper_id AND g.part = w.part"""


def page_components(spark: SparkSession, sf: str) -> DataFrame:
    """The components of each page with the registry entries they open; only body evidence may be opened."""
    items = plan_items(spark, sf)
    open_ = body_evidence(spark, sf).withColumn("opens", F.lit(True))
    j = items.join(open_.withColumnRenamed("evidence_id", "first_evidence"), ["paper_id", "first_evidence"], "left")
    return j.select("paper_id", "item_id", F.when(F.col("part").isin("main_results", "analysis"), "result").when(F.col("part").startswith("method"), "step").otherwise("text").alias("component"), F.when(F.col("opens"), F.col("first_evidence")).alias("opens_evidence"))


COMPONENT_SQL = f"""
WITH i AS ({ITEM_SQL}), o AS ({BODY_SQL})
SELECT i.paper_id, item_id, CASE WHEN part IN ('main_results', 'analysis') THEN 'result' WHEN starts_with(part, 'method') THEN 'step' ELSE 'text' END AS component, o.evidence_id AS opens_evidence
FROM i LEFT JOIN o ON o.paper_id = i.paper_id AND o.evidence_id = i.first_evidence"""


def page_registry(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence each page's components open, with its text by digest: what a reader's click finds."""
    used = page_components(spark, sf).where("opens_evidence is not null").select("paper_id", F.col("opens_evidence").alias("evidence_id")).distinct()
    e = clean_evidence(spark, sf).select("paper_id", "evidence_id", "page", "text_sha256")
    return used.join(e, ["paper_id", "evidence_id"]).select("paper_id", "evidence_id", "page", "text_sha256", T.page_link(F.lit(""), F.col("page")).alias("link"))


REGISTRY_SQL = f"""
WITH p AS ({COMPONENT_SQL}), {E}, u AS (SELECT DISTINCT paper_id, opens_evidence AS evidence_id FROM p WHERE opens_evidence IS NOT NULL)
SELECT u.paper_id, u.evidence_id, page, text_sha256, '#page=' || greatest(page, 1) AS link FROM u JOIN e ON e.paper_id = u.paper_id AND e.evidence_id = u.evidence_id"""


def plan_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules of the plan: an item placed twice, a claim without known evidence, an opened target that is no body text."""
    items = plan_items(spark, sf)
    twice = items.groupBy("paper_id", "claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("placed twice").alias("rule"), "paper_id", F.col("claim_id").alias("id"))
    known = claim_evidence(spark, sf).select("paper_id", "claim_id").distinct()
    bare = clean_claims(spark, sf).select("paper_id", "claim_id").join(known, ["paper_id", "claim_id"], "left_anti").select(F.lit("no known evidence").alias("rule"), "paper_id", F.col("claim_id").alias("id"))
    dark = page_components(spark, sf).where("opens_evidence is null").select(F.lit("opens nothing").alias("rule"), "paper_id", F.col("item_id").alias("id"))
    return twice.unionByName(bare).unionByName(dark)


PLAN_GATE_SQL = f"""
WITH i AS ({ITEM_SQL}), {E}, {C}, {_CE}, p AS ({COMPONENT_SQL})
SELECT 'placed twice' AS rule, paper_id, claim_id AS id FROM i GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'no known evidence', paper_id, claim_id FROM c WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.paper_id = c.paper_id AND ce.claim_id = c.claim_id)
UNION ALL SELECT 'opens nothing', paper_id, item_id FROM p WHERE opens_evidence IS NULL"""


def hub_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from cited works to the hub of their relation, and from each hub to the paper."""
    g = provenance_graph(spark, sf)
    hub = F.concat_ws(":", F.lit("hub"), "relation")
    spokes = g.select(F.col("target_id").alias("paper_id"), "source_id", hub.alias("target_id"), F.lit("semantic").alias("kind"))
    ends = g.select(F.col("target_id").alias("paper_id"), hub.alias("source_id"), F.col("target_id"), F.lit("terminal").alias("kind")).distinct()
    return spokes.unionByName(ends)


HUB_SQL = f"""
WITH g AS ({GRAPH_SQL}) SELECT target_id AS paper_id, source_id, 'hub:' || relation AS target_id, 'semantic' AS kind FROM g
UNION ALL SELECT DISTINCT target_id, 'hub:' || relation, target_id, 'terminal' FROM g"""


def related_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Works that do not have exactly one edge to their paper."""
    g = provenance_graph(spark, sf)
    return g.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n_edges")).where("n_edges <> 1")


RELATED_GATE_SQL = f"WITH g AS ({GRAPH_SQL}) SELECT source_id, target_id, count(*) AS n_edges FROM g GROUP BY ALL HAVING count(*) <> 1"


def pair_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Slides and written parts of each paper side by side: sizes, and how the two compare."""
    d = table(spark, sf, "documents").where("paper_id is not null and text is not null").select("paper_id", "doc_id", F.when(F.col("doc_kind").isin("slide", "poster"), "shown").otherwise("written").alias("side"), F.length("text").alias("n")).distinct()
    g = d.groupBy("paper_id").agg(F.count_if(F.col("side") == "shown").alias("n_shown"), F.count_if(F.col("side") == "written").alias("n_written"), F.sum(F.when(F.col("side") == "shown", F.col("n")).otherwise(0)).alias("shown_chars"), F.sum("n").alias("all_chars"))
    return g.where("n_shown > 0 and n_written > 0").select("paper_id", "n_shown", "n_written", F.bround(F.col("shown_chars") / F.col("all_chars"), 9).alias("shown_share"))


PAIR_SQL = """
WITH d AS (SELECT DISTINCT paper_id, doc_id, CASE WHEN doc_kind IN ('slide', 'poster') THEN 'shown' ELSE 'written' END AS side, length(text) AS n FROM documents WHERE paper_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT paper_id, count(*) FILTER (side = 'shown') AS n_shown, count(*) FILTER (side = 'written') AS n_written, sum(CASE WHEN side = 'shown' THEN n ELSE 0 END) AS shown_chars, sum(n) AS all_chars FROM d GROUP BY ALL)
SELECT paper_id, n_shown, n_written, round_even(shown_chars / all_chars, 9) AS shown_share FROM g WHERE n_shown > 0 AND n_written > 0"""


def pairs_to_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Papers whose two sides are there but whose audit is not: only they are run again."""
    p = pair_scores(spark, sf).select("paper_id")
    done = table(spark, sf, "documents").where("doc_kind = 'review_note' and paper_id is not null").select("paper_id").distinct()
    return p.join(done, "paper_id", "left_anti")


RESUME_SQL = f"WITH s AS ({PAIR_SQL}) SELECT paper_id FROM s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.paper_id = s.paper_id AND doc_kind = 'review_note')"


def block_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks a reader shows: of the chosen roles, and not replaced by a later block of the same text on their page."""
    b = clean_blocks(spark, sf).where("role in ('body', 'heading', 'caption') and text is not null")
    w = Window.partitionBy(*PAGE, F.sha2(T.squeeze(F.col("text")), 256)).orderBy("ord")
    return b.withColumn("later", F.lead("block_id").over(w)).where("later is null").select("paper_id", "block_id", "role")


FILTER_SQL = f"""
WITH {B}, t AS (SELECT *, lead(block_id) OVER (PARTITION BY paper_id, page, sha256(trim(regexp_replace(text, '{T.WS}+', ' ', 'g'))) ORDER BY ord) AS later FROM b WHERE role IN ('body', 'heading', 'caption') AND text IS NOT NULL)
SELECT paper_id, block_id, role FROM t WHERE later IS NULL"""


def crop_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """For each caption the room above it in its column, down from the foot of the nearest block of text: where its picture stands."""
    b = clean_blocks(spark, sf).where("bbox is not null")
    cap = b.where("role = 'caption'").select(*PAGE, F.col("block_id").alias("caption_id"), F.col("bbox").alias("cb"))
    txt = b.where("role in ('body', 'heading', 'caption', 'header')").select(*PAGE, F.col("block_id").alias("tid"), F.col("bbox").alias("tb"))
    above = cap.join(txt, PAGE).where((F.col("tid") != F.col("caption_id")) & (G.side(F.col("tb"), 3) <= G.side(F.col("cb"), 1)) & (G.horizontal_overlap(F.col("tb"), F.col("cb")) >= 0.25))
    top = above.groupBy(*PAGE, "caption_id").agg(F.max(G.side(F.col("tb"), 3)).alias("top"))
    j = cap.join(top, [*PAGE, "caption_id"], "left")
    return j.select("paper_id", "caption_id", G.side(F.col("cb"), 0).alias("x0"), F.coalesce("top", F.lit(0.0)).alias("y0"), G.side(F.col("cb"), 2).alias("x1"), G.side(F.col("cb"), 1).alias("y1"))


CROP_SQL = f"""
WITH {B}, c AS (SELECT * FROM b WHERE role = 'caption' AND bbox IS NOT NULL), t AS (SELECT * FROM b WHERE role IN ('body', 'heading', 'caption', 'header') AND bbox IS NOT NULL),
a AS (SELECT c.paper_id, c.block_id AS caption_id, max(t.bbox[4]) AS top FROM c JOIN t ON t.paper_id = c.paper_id AND t.page = c.page AND t.block_id <> c.block_id AND t.bbox[4] <= c.bbox[2]
  AND greatest(0, least(t.bbox[3], c.bbox[3]) - greatest(t.bbox[1], c.bbox[1])) / greatest(1, least(t.bbox[3] - t.bbox[1], c.bbox[3] - c.bbox[1])) >= 0.25 GROUP BY ALL)
SELECT c.paper_id, c.block_id AS caption_id, bbox[1] AS x0, coalesce(top, 0) AS y0, bbox[3] AS x1, bbox[2] AS y1 FROM c LEFT JOIN a ON a.paper_id = c.paper_id AND a.caption_id = c.block_id"""

QUERIES = {f.__name__: f for f in (
    plan_items, plan_sections, page_components, page_registry, plan_gate, hub_graph, related_gate, pair_scores, pairs_to_resume, block_filter, crop_boxes,
)}
SQL = {
    "plan_items": ITEM_SQL, "plan_sections": PLAN_SECTION_SQL, "page_components": COMPONENT_SQL, "page_registry": REGISTRY_SQL, "plan_gate": PLAN_GATE_SQL, "hub_graph": HUB_SQL,
    "related_gate": RELATED_GATE_SQL, "pair_scores": PAIR_SQL, "pairs_to_resume": RESUME_SQL, "block_filter": FILTER_SQL, "crop_boxes": CROP_SQL,
}
