"""Queries on what the corpus knows by id: the entity index, what may stand on what, links, paths, and compact views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions import geometry as G
from scholiast.operators.orphans import KEYED, tidy_id
from scholiast.operators.ordering import clean_blocks
from scholiast.plans.layout import B, q
from scholiast.runtime import table

# Kinds of entities by table; records and papers belong to no paper.
KINDS = {"evidence": "evidence", "blocks": "block", "claims": "claim", "citations": "citation"}
# What an owner of each kind may stand on.
ALLOWED = {"claim": ("evidence",), "citation": ("evidence", "block", "record"), "evidence": ("block",)}


def entity_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every id with its kind and paper; null ids have no row, records and papers no paper."""
    parts = [table(spark, sf, t).select("paper_id", tidy_id(F.col(key)).alias("entity_id"), F.lit(KINDS[t]).alias("kind")) for t, key in KEYED.items()]
    parts.append(table(spark, sf, "metadata").select(F.lit(None).cast("string").alias("paper_id"), tidy_id(F.col("record_id")).alias("entity_id"), F.lit("record").alias("kind")))
    parts.append(table(spark, sf, "papers").select(F.lit(None).cast("string").alias("paper_id"), F.col("paper_id").alias("entity_id"), F.lit("paper").alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("entity_id is not null").distinct()


INDEX_SQL = """
SELECT paper_id, lower(trim(evidence_id)) AS entity_id, 'evidence' AS kind FROM evidence WHERE evidence_id IS NOT NULL
UNION SELECT paper_id, lower(trim(block_id)), 'block' FROM blocks WHERE block_id IS NOT NULL
UNION SELECT paper_id, lower(trim(claim_id)), 'claim' FROM claims WHERE claim_id IS NOT NULL
UNION SELECT paper_id, lower(trim(citation_id)), 'citation' FROM citations WHERE citation_id IS NOT NULL
UNION SELECT NULL, lower(trim(record_id)), 'record' FROM metadata WHERE record_id IS NOT NULL
UNION SELECT NULL, paper_id, 'paper' FROM papers WHERE paper_id IS NOT NULL"""


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "provenance").select("paper_id", "provenance_id", tidy_id(F.col("owner_id")).alias("owner_id"), "source_ids").distinct()
    return p.select("paper_id", "provenance_id", "owner_id", F.posexplode(F.transform("source_ids", tidy_id)).alias("pos", "source_id")).where("source_id <> ''")


_SOURCES = """p AS (SELECT DISTINCT paper_id, provenance_id, lower(trim(owner_id)) AS owner_id, source_ids FROM provenance),
s AS (SELECT paper_id, provenance_id, owner_id, generate_subscripts(source_ids, 1) - 1 AS pos, lower(trim(unnest(source_ids))) AS source_id FROM p)"""


def source_kind_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of a kind that an owner of its kind may not stand on; ids that name nothing are no breach of this rule."""
    known = entity_index(spark, sf)
    own = known.where("paper_id is not null")
    s = _sources(spark, sf).join(own.select("paper_id", F.col("entity_id").alias("owner_id"), F.col("kind").alias("owner_kind")), ["paper_id", "owner_id"])
    free = known.where("kind = 'record'").select(F.col("entity_id").alias("source_id"), F.col("kind").alias("free_kind"))
    s = s.join(own.select("paper_id", F.col("entity_id").alias("source_id"), "kind"), ["paper_id", "source_id"], "left").join(free, "source_id", "left")
    s = s.withColumn("source_kind", F.coalesce("kind", "free_kind")).where("source_kind is not null")
    fine = F.lit(False)
    for owner, kinds in ALLOWED.items():
        fine = fine | ((F.col("owner_kind") == owner) & F.col("source_kind").isin(*kinds))
    return s.where(~fine).select("paper_id", "provenance_id", "owner_kind", "source_id", "source_kind").distinct()


KIND_SQL = f"""
WITH k AS ({INDEX_SQL}), {_SOURCES},
j AS (SELECT s.paper_id, s.provenance_id, o.kind AS owner_kind, s.source_id, coalesce(x.kind, r.kind) AS source_kind FROM s
  JOIN k o ON o.paper_id = s.paper_id AND o.entity_id = s.owner_id
  LEFT JOIN k x ON x.paper_id = s.paper_id AND x.entity_id = s.source_id LEFT JOIN k r ON r.kind = 'record' AND r.entity_id = s.source_id WHERE s.source_id <> '')
SELECT DISTINCT * FROM j WHERE source_kind IS NOT NULL AND NOT ({" OR ".join(f"(owner_kind = '{o}' AND source_kind IN ({', '.join(q(x) for x in ks)}))" for o, ks in ALLOWED.items())})"""


def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of each owner over all its provenance rows, each once, with the place it is first named at."""
    s = _sources(spark, sf).where("owner_id is not null")
    return s.groupBy("paper_id", "owner_id", "source_id").agg(F.min(F.struct("provenance_id", "pos")).alias("f")).select("paper_id", "owner_id", "source_id", F.col("f.provenance_id").alias("first_named_by"), F.col("f.pos").alias("pos"))


UNION_SQL = f"""
WITH {_SOURCES} SELECT paper_id, owner_id, source_id, provenance_id AS first_named_by, CAST(pos AS INT) AS pos FROM s WHERE source_id <> '' AND owner_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY paper_id, owner_id, source_id ORDER BY provenance_id, pos) = 1"""

# A web address with a host that has a dot; one with any host; an endpoint that is safe to send to.
URL_TESTS = {
    "is_web": r"(?i)^https?://[^/?#\s@]*[^/?#\s@.]\.[^/?#\s@.]+(?::[0-9]+)?(?:[/?#]|$)",
    "has_host": r"(?i)^https?://[^/?#\s]+",
    "is_endpoint": r"(?i)^(?:https://[^/?#\s]+|http://(?:localhost|127\.0\.0\.1)(?::[0-9]+)?(?:[/?#]|$))",
}


def link_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Which tests each paper's address passes; papers without address have no row."""
    p = table(spark, sf, "papers").where("original_url is not null").select("paper_id", F.trim("original_url").alias("url")).distinct()
    return p.select("paper_id", "url", *(F.col("url").rlike(t).alias(n) for n, t in URL_TESTS.items()))


LINK_SQL = f"SELECT DISTINCT paper_id, trim(original_url) AS url, {', '.join(f'regexp_matches(trim(original_url), {q(t)}) AS {n}' for n, t in URL_TESTS.items())} FROM papers WHERE original_url IS NOT NULL"


def path_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each local path stays within its folder: relative, and no step up beyond it."""
    p = table(spark, sf, "papers").where("local_pdf is not null").select("paper_id", F.col("local_pdf").alias("path")).distinct()
    steps = F.filter(F.split("path", "/"), lambda s: ~s.isin("", "."))
    lowest = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return p.select("paper_id", "path", (~F.startswith("path", F.lit("/")) & (lowest["low"] >= 0)).alias("confined"))


PATH_SQL = r"""
WITH p AS (SELECT DISTINCT paper_id, local_pdf AS path FROM papers WHERE local_pdf IS NOT NULL),
s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), lambda x: CASE WHEN x = '..' THEN -1 ELSE 1 END) AS v FROM p)
SELECT paper_id, path, NOT starts_with(path, '/') AND coalesce(list_min(list_transform(generate_series(1, len(v)), lambda k: list_sum(v[1:k]))), 0) >= 0 AS confined FROM s"""


def recent_papers(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve papers that came in last, each once, latest first."""
    p = table(spark, sf, "papers").where("paper_id is not null and ingested_at is not null")
    return p.groupBy("paper_id").agg(F.max("ingested_at").alias("seen_at")).orderBy(F.desc("seen_at"), "paper_id").limit(12)


RECENT_SQL = "SELECT paper_id, max(ingested_at) AS seen_at FROM papers WHERE paper_id IS NOT NULL AND ingested_at IS NOT NULL GROUP BY ALL ORDER BY seen_at DESC, paper_id LIMIT 12"


def crop_points(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes given in fractions of the page, in points; those below 4 % of its width or 1.5 % of its height are none."""
    b = clean_blocks(spark, sf).where("bbox is not null and size(bbox) = 4").withColumn("r", G.relative(F.col("bbox")))
    box = G.absolute(F.col("r.x"), F.col("r.y"), F.col("r.width"), F.col("r.height"))
    b = b.select("paper_id", "block_id", box.alias("p")).where("p is not null")
    return b.select("paper_id", "block_id", *(F.bround(F.get("p", F.lit(k)), 3).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


CROP_SQL = f"""
WITH {B}, r AS (SELECT paper_id, block_id, round_even(greatest(0, bbox[1] - 1.5) / 600, 6) AS x, round_even(greatest(0, bbox[2] - 1.5) / 800, 6) AS y,
  round_even(greatest(1, least(600, bbox[3] + 1.5) - greatest(0, bbox[1] - 1.5)) / 600, 6) AS w, round_even(greatest(1, least(800, bbox[4] + 1.5) - greatest(0, bbox[2] - 1.5)) / 800, 6) AS h FROM b WHERE len(bbox) = 4),
c AS (SELECT *, least(1, greatest(0, x)) AS l, least(1, greatest(0, y)) AS t FROM r), d AS (SELECT *, least(1, greatest(l, l + w)) AS rr, least(1, greatest(t, t + h)) AS bb FROM c)
SELECT paper_id, block_id, round_even(l * 600, 3) AS x0, round_even(t * 800, 3) AS y0, round_even(rr * 600, 3) AS x1, round_even(bb * 800, 3) AS y1 FROM d WHERE rr - l >= 0.04 AND bb - t >= 0.015"""


def lookup_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What looking up every record once costs per provider, at a cent and a half a call, in two decimals."""
    m = table(spark, sf, "metadata").select("record_id", "provider").distinct()
    return m.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"), F.bround(F.count(F.lit(1)) * F.lit(0.015), 2).alias("cost"))


COST_SQL = "SELECT provider, count(*) AS calls, round_even(count(*) * 0.015::DOUBLE, 2) AS cost FROM (SELECT DISTINCT record_id, provider FROM metadata) GROUP BY ALL"

QUERIES = {f.__name__: f for f in (entity_index, source_kind_gate, source_union, link_checks, path_gate, recent_papers, crop_points, lookup_costs)}
SQL = {
    "entity_index": INDEX_SQL, "source_kind_gate": KIND_SQL, "source_union": UNION_SQL, "link_checks": LINK_SQL, "path_gate": PATH_SQL, "recent_papers": RECENT_SQL,
    "crop_points": CROP_SQL, "lookup_costs": COST_SQL,
}
