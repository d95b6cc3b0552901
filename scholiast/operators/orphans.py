"""References to rows that do not exist, from signed reference and existence counts.

Every table is read as a stream of deltas on keys: a row that comes in adds one to the
existence count of its key, its deletion takes one away, a referring row adds one to the
reference count of each key it names. A key is an orphan while its reference count is
positive and its existence count is zero. `merge_counts` maintains the counts as batches
of deltas arrive. A reference made at some time is judged by the counts of its key in the
epoch it falls in: the existence deltas of a key part time into epochs, and references
and existence are counted per key and epoch (`orphan_references`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.runtime import table

# The referring fields: table, key column, array column.
FIELDS = {
    "claims.evidence_ids": ("claims", "claim_id", "evidence_ids"),
    "citations.cited_in_evidence_ids": ("citations", "citation_id", "cited_in_evidence_ids"),
    "provenance.source_ids": ("provenance", "provenance_id", "source_ids"),
}
# The tables that hold referable rows of a paper, and their key columns.
KEYED = {"evidence": "evidence_id", "blocks": "block_id", "claims": "claim_id", "citations": "citation_id"}
_BLANK = r"^[\s\x{A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]+|[\s\x{A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]+$"


def tidy_id(c: Column) -> Column:
    """An id trimmed and in lower case."""
    return F.lower(F.regexp_replace(c, _BLANK, ""))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per referring field, owner and named id, at the earliest time its owner's key came in.

    Null and blank elements and null arrays are no references; rows repeated under a key
    collapse before the shuffle (partial aggregation).
    """
    parts = []
    for field, (name, key, ids) in FIELDS.items():
        df = table(spark, sf_dir, name)
        parts.append(
            df.select("paper_id", F.col(key).alias("owner_id"), "ingested_at", F.explode(F.array_distinct(F.transform(ids, tidy_id))).alias("ref_id"))
            .where("ref_id <> ''")
            .select(F.lit(field).alias("ref_field"), "paper_id", "owner_id", "ref_id", "ingested_at")
        )
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("ref_field", "paper_id", "owner_id", "ref_id").agg(F.min("ingested_at").alias("at"))


def existence(df: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Signed existence deltas of each key: +1 when it first came in, -1 when it was deleted."""
    deleted = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp")
    return (
        df.where(F.col(key).isNotNull())
        .select(*scope, tidy_id(F.col(key)).alias("ref_id"), "ingested_at", deleted.alias("gone"))
        .groupBy(*scope, "ref_id")
        .agg(F.min("ingested_at").alias("came"), F.when(F.count("gone") == F.count(F.lit(1)), F.max("gone")).alias("gone"))
        .select(
            *scope,
            "ref_id",
            F.filter(
                F.array(F.struct(F.col("came").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("gone").alias("ts"), F.lit(-1).alias("d"))),
                lambda x: x["ts"].isNotNull(),
            ).alias("deltas"),
        )
    )


def timelines(spark: SparkSession, sf_dir: str, refs: DataFrame) -> DataFrame:
    """ref_field, paper_id, ref_id, deltas of every referred key: the signed existence deltas of all rows it can name, by time.

    Ids of the first two fields name evidence of the same paper; source_ids name evidence,
    blocks, claims or citations of the same paper, or metadata records. Null ids name
    nothing. Existence has one row per key and table, so a hot key is one row here.
    """
    own = None
    for name, key in KEYED.items():
        part = existence(table(spark, sf_dir, name), ["paper_id"], key).withColumn("named", F.lit(name))
        own = part if own is None else own.unionByName(part)
    # one row per (paper, id), whatever the table: evidence deltas apart, for the fields that name evidence only
    own = own.groupBy("paper_id", "ref_id").agg(
        F.flatten(F.collect_list(F.when(F.col("named") == "evidence", F.col("deltas")))).alias("evidence_deltas"),
        F.flatten(F.collect_list("deltas")).alias("own_deltas"),
    )
    records = existence(table(spark, sf_dir, "metadata"), [], "record_id").withColumnRenamed("deltas", "record_deltas")
    keys = refs.select("ref_field", "paper_id", "ref_id").distinct()
    joined = keys.join(own, ["paper_id", "ref_id"], "left").join(records, "ref_id", "left")
    none = F.expr("cast(array() as array<struct<ts: timestamp_ntz, d: int>>)") if dict(refs.dtypes)["at"] == "timestamp_ntz" else F.expr("cast(array() as array<struct<ts: timestamp, d: int>>)")
    any_kind = F.concat(F.coalesce("own_deltas", none), F.coalesce("record_deltas", none))
    deltas = F.when(F.col("ref_field") == "provenance.source_ids", any_kind).otherwise(F.coalesce("evidence_deltas", none))
    return joined.select("ref_field", "paper_id", "ref_id", F.array_sort(deltas).alias("deltas"))


KEY = ["ref_field", "paper_id", "ref_id"]


def _match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys equal null keys."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*(f"_{k}" for k in keys))


def orphan_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose named key had references and no existence in the epoch of their own time.

    The epoch of an instant is the number of existence deltas of the key up to it. Counts
    per key and epoch are maintained as in `merge_counts`; references of an orphan key and
    epoch are orphans. A hot key only swells the referring side of the joins, which
    adaptive execution splits; its counts combine before they are shuffled.
    """
    refs = references(spark, sf_dir)
    lines = timelines(spark, sf_dir, refs)
    made = _match(refs, lines, KEY).withColumn("epoch", F.size(F.filter("deltas", lambda x: x["ts"] <= F.col("at")))).drop("deltas")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    epochs = lines.select(*KEY, F.posexplode(F.concat(F.array(F.lit(0)), F.transform("deltas", lambda x, i: F.aggregate(F.slice("deltas", 1, i + 1), F.lit(0), lambda a, y: a + y["d"])))).alias("epoch", "n"))
    counts = made.select(*KEY, "epoch", one.alias("refs"), zero.alias("exists")).unionByName(epochs.select(*KEY, "epoch", zero.alias("refs"), F.col("n").cast("long").alias("exists")))
    orphan = orphan_keys(merge_counts(None, counts)).select(*KEY, "epoch")
    return _match(made, orphan, [*KEY, "epoch"], "left_semi").select("ref_field", "paper_id", "owner_id", "ref_id", "at")


def merge_counts(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Maintained counts per key: the old state plus a batch of deltas (key..., refs, exists).

    Counts are sums, so batches may arrive in any order and keys that cancel out vanish.
    """
    keys = [c for c in deltas.columns if c not in ("refs", "exists")]
    rows = deltas if state is None else state.unionByName(deltas.select(state.columns))
    return rows.groupBy(*keys).agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists")).where("refs <> 0 or exists <> 0")


def orphan_keys(state: DataFrame) -> DataFrame:
    """The current orphan report: keys with positive references and no existence."""
    return state.where("refs > 0 and exists <= 0")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(spark, sf_dir).select("ref_field", "paper_id", "owner_id", "ref_id")


def p4_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per referring field and month of the referring row."""
    return (
        orphan_references(spark, sf_dir)
        .groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_orphans"))
    )


def count_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed deltas (ref_field, paper_id, ref_id, refs, exists) of all referring fields and all tables they name.

    Evidence counts for every field; blocks, claims, citations and metadata records for
    source_ids only. Records belong to no paper: their existence goes to each paper that
    names them. Rows without paper exist for no reference.
    """
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    any_kind = F.lit("provenance.source_ids")
    refs = references(spark, sf_dir)
    deltas = refs.select("ref_field", "paper_id", "ref_id", one.alias("refs"), none.alias("exists"))
    exists = F.aggregate("deltas", F.lit(0), lambda a, x: a + x["d"]).cast("long").alias("exists")
    for name, key in KEYED.items():
        fields = F.array(*map(F.lit, FIELDS)) if name == "evidence" else F.array(any_kind)
        rows = existence(table(spark, sf_dir, name).where("paper_id is not null"), ["paper_id"], key)
        deltas = deltas.unionByName(rows.select(F.explode(fields).alias("ref_field"), "paper_id", "ref_id", none.alias("refs"), exists))
    named = refs.where(F.col("ref_field") == any_kind).select(*KEY).distinct()
    records = existence(table(spark, sf_dir, "metadata"), [], "record_id")
    return deltas.unionByName(named.join(records, "ref_id").select("ref_field", "paper_id", "ref_id", none.alias("refs"), exists))


def p4_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every referring field that lead nowhere once all deltas are in, with their reference counts."""
    return orphan_keys(merge_counts(None, count_deltas(spark, sf_dir))).select("ref_field", "paper_id", "ref_id", "refs")
