"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.functions.packed import PROFILES
from scholiast.runtime import spread, table


def split_column(field: Column, profile: str) -> Column:
    """Array of the values packed in a string column.

    A null, empty or blank field gives an empty array; text of any length is processed
    whole; repeated values keep their own positions.
    """
    split = PROFILES[profile]

    @F.pandas_udf("array<string>")
    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([split(None if x is None or x != x else x) for x in s], index=s.index, dtype=object)

    return values(field)


def values_of(df: DataFrame, key: Column, field: Column, profile: str, source_field: str) -> DataFrame:
    """source_field, owner_key, n_values, pos, item for every value; repeated rows of a key count once.

    Rows with a null key count once per set of values, under a null owner_key; an empty
    table gives no rows; columns other than key and field are not read.
    """
    fields = df.select(key.alias("owner_key"), field.alias("field")).where(F.col("field").isNotNull())
    packed = spread(fields).select("owner_key", split_column(F.col("field"), profile).alias("v")).dropDuplicates(["owner_key", "v"])
    return packed.select(
        F.lit(source_field).alias("source_field"), "owner_key", F.size("v").alias("n_values"), F.posexplode("v").alias("p", "item")
    ).select("source_field", "owner_key", "n_values", (F.col("p") + 1).cast("int").alias("pos"), "item")


def author_values(metadata: DataFrame) -> DataFrame:
    return values_of(metadata, F.col("record_id"), F.col("authors"), "names", "metadata.authors")


def entry_values(citations: DataFrame) -> DataFrame:
    return values_of(
        citations, F.concat("paper_id", F.lit("/"), "citation_id"), F.col("raw_reference"), "entries", "citations.raw_reference"
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = entry_values(table(spark, sf_dir, "citations")).unionByName(author_values(table(spark, sf_dir, "metadata")))
    return both.where("n_values >= 2").select("source_field", "owner_key", "pos", "item")
