"""Running values along the reading order of papers of any length.

A window over a whole paper would put the largest paper into one task. Running sums are
therefore taken in two steps: within pages, which are small, and over the page totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.runtime import materialize, table

PAPER, PAGE = ["paper_id"], ["paper_id", "page"]


def clean_blocks(spark, sf_dir: str) -> DataFrame:
    """Blocks by key: repeated rows, which agree but for their time of arrival, count once."""
    b = table(spark, sf_dir, "blocks")
    return b.select("paper_id", "page", "ord", "block_id", "text", "bbox", "role", "font_size_median").distinct()


def running_sum(df: DataFrame, value: Column, out: str, order: str = "ord") -> DataFrame:
    """df with the sum of value over all rows of the paper up to and with this one."""
    own = Window.partitionBy(*PAGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__v", value.cast("long"))
    before = Window.partitionBy(*PAPER).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    pages = df.groupBy(*PAGE).agg(F.sum("__v").alias("__t")).select(*PAGE, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__before"))
    return df.join(pages, PAGE).withColumn(out, (F.sum("__v").over(own) + F.col("__before")).cast("long")).drop("__v", "__before")


def upper_median(c: Column) -> Column:
    """The upper of the middle elements, as an aggregate."""
    a = F.array_sort(F.collect_list(c))
    return F.try_element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """df with the rank (from 0) of each row within its group, whatever the group's size.

    Rows are shared out by ranges of group and order, so a group of a third of all rows
    spans many tasks; ranks within a range are raised by the sizes of the ranges before it.
    Rows with a null in group have no rank and are left out.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.dropna(subset=group).repartitionByRange(n, *map(F.col, group), *order).withColumn("__part", F.spark_partition_id())
    parts = materialize(parts)  # a range keeps its number if a task is run again
    sizes = parts.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = Window.partitionBy("__part", *group).orderBy(*order)
    return parts.join(sizes, ["__part", *group]).withColumn(out, F.row_number().over(own) - 1 + F.col("__before")).drop("__part", "__before")
