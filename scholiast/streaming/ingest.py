"""Streams: blocks turned into evidence as they come in, reference counts maintained, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholiast.functions.text import strip
from scholiast.operators.orphans import merge_counts

BLOCKS = "paper_id string, page int, ord int, block_id string, text string, role string, ingested_at timestamp"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def evidence_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Evidence of content blocks from Parquet files as they appear; repeated rows within the watermark count once."""
    b = spark.readStream.schema(BLOCKS).parquet(path).withWatermark("ingested_at", late)
    once = b.dropDuplicatesWithinWatermark(["paper_id", "block_id"])
    t = strip(F.col("text"))
    return once.where(F.col("role").isin("body", "caption", "formula") & (F.length(t) > 0)).select("paper_id", "block_id", "page", t.alias("verbatim_text"), F.sha2(t, 256).alias("text_sha256"), "ingested_at")


def event_windows(spark: SparkSession, path: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and sum of events per window and kind; events later than the watermark are left out."""
    e = spark.readStream.schema(EVENTS).parquet(path).withWatermark("ts", late)
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(spark: SparkSession, path: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed by a pause."""
    e = spark.readStream.schema(EVENTS).parquet(path).withWatermark("ts", late)
    s = e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def maintain_counts(deltas: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keep signed counts per key up to date from a stream of (key..., refs, exists).

    Each batch writes the next version of the state; a batch that is run again after a
    failure writes the same version, so counts are added once.
    """

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{state_path}/v={n - 1}") if n else None
        merge_counts(state, batch).write.mode("overwrite").parquet(f"{state_path}/v={n}")

    return deltas.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
