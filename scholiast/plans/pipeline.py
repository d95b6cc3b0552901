"""The whole way from blocks to evidence, claims, sections and citations, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions import text as T
from scholiast.operators.ordering import clean_blocks
from scholiast.operators.stages import Runner, Stage, table_fingerprint
from scholiast.plans import citations, evidence, layout

VERSION = "2"


def _claims(spark: SparkSession, sf: str, built: DataFrame) -> DataFrame:
    """Claims among the evidence that was built, by the texts of its blocks."""
    texts = clean_blocks(spark, sf).select("paper_id", "block_id", T.strip(F.col("text")).alias("verbatim_text"))
    return evidence.claims_of(built.withColumnRenamed("new_id", "evidence_id").join(texts, ["paper_id", "block_id"]))


def stages(sf: str) -> list[Stage]:
    unique = lambda *key: lambda df: df.groupBy(*key).count().where("count > 1")
    return [
        Stage("sections", VERSION, lambda s, _: layout.section_segments(s, sf), unique("paper_id", "section_no"), reads=("blocks",)),
        Stage("parts", VERSION, lambda s, f: evidence.routed_sections(f["sections"]), unique("paper_id", "section_no"), after=("sections",)),
        Stage("evidence", VERSION, lambda s, _: evidence.evidence_build(s, sf), unique("paper_id", "new_id"), reads=("blocks",)),
        Stage("claims", VERSION, lambda s, f: _claims(s, sf, f["evidence"]), lambda df: df.where(F.col("importance").isNull()), reads=("blocks",), after=("evidence",)),
        Stage("references", VERSION, lambda s, _: citations.reference_fields(s, sf), unique("paper_id", "citation_id"), reads=("citations",)),
        Stage("cited", VERSION, lambda s, _: citations.cited_relations(s, sf), reads=("evidence",)),
        Stage("related", VERSION, lambda s, f: citations.graph_of(f["references"], f["cited"]), unique("source_id", "target_id"), after=("references", "cited")),
    ]


def run_pipeline(spark: SparkSession, sf: str, root: str) -> tuple[dict[str, DataFrame], list[dict]]:
    """All stages into root; (frames by stage, log). Stages made before from the same tables and stages are read."""
    runner = Runner(spark, root)
    done: dict[str, DataFrame] = {}
    known: dict[str, str] = {}
    for stage in stages(sf):
        for name in stage.reads:
            known.setdefault(name, table_fingerprint(spark, f"{sf}/{name}.parquet"))
        done[stage.name] = runner.run(stage, done, {name: known[name] for name in stage.reads})
    return done, runner.log
