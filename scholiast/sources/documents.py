"""JSON inputs: parsed documents, manifests, overlays and catalogs, read with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<id:string,text:string,bbox:array<double>,order:int,role:string,font_size_median:double,coordinate_precision:string>"
PARSED = (
    "schema_version string, stage_version string, status string, input_hashes array<string>, source struct<kind:string,sha256:string,page_count:int,local_pdf:string,original_url:string>, "
    "paper struct<title:string,authors:array<string>,year:int,language:string>, "
    f"pages array<struct<number:int,width:double,height:double,blocks:array<{BLOCK}>>>, references array<struct<id:string,raw_reference:string,page:int,block_ids:array<string>>>, _corrupt_record string"
)
PAIR = "id string, title string, presentation_type string, paper_file string, presentation_file string, paper_url string, presentation_url string"


def parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per parsed document; a file that is no JSON keeps its text in _corrupt_record."""
    return spark.read.schema(PARSED).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def parsed_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of parsed documents in the corpus's own shape."""
    pages = docs.where("_corrupt_record is null").select(F.col("source.sha256").alias("paper_id"), F.explode("pages").alias("p"))
    b = pages.select("paper_id", F.col("p.number").alias("page"), F.explode("p.blocks").alias("b"))
    return b.select("paper_id", "page", F.col("b.order").alias("ord"), F.col("b.id").alias("block_id"), "b.text", "b.bbox", "b.role", "b.font_size_median", "b.coordinate_precision")


def pair_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, faulty pairs) of a manifest, a list of pairs or an object with the list under pairs."""
    raw = spark.read.text(path, wholetext=True)
    shape = f"array<struct<{', '.join(c.replace(' ', ':') for c in PAIR.split(', '))}>>"
    pairs = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", shape)).otherwise(F.from_json("value", f"struct<pairs:{shape}>")["pairs"])
    rows = raw.select(F.explode(pairs).alias("p")).select("p.*")
    whole = F.expr("id is not null and paper_file is not null and presentation_file is not null and presentation_type is not null")
    return rows.where(whole), rows.where(~whole)


def overlay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an optional overlay file; none where the file is missing."""
    try:
        df = spark.read.schema(schema).option("multiLine", True).json(path)
        df.limit(1).collect()  # a missing path shows on reading only
        return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def artifact_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of artifacts that can be shown, by title."""
    m = spark.read.schema("paper_id string, status string, title string, pdf string, preferred boolean").option("multiLine", True).json(f"{path}/*/manifest.json")
    return m.where(F.col("status").isin("built", "preview", "review_failed") & F.col("pdf").isNotNull()).orderBy(F.coalesce("preferred", F.lit(False)).desc(), "title")
