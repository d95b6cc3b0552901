"""Reading order of the blocks of a page as window expressions.

Blocks that span the page part it into bands; a band is read column by column. The band of
a block is the number of spanning blocks at or above its head, a running sum over the
page, so no block is compared with another and no page is a call of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholiast.operators.ordering import PAGE

_DOWN = ["c1", "c0", "ord", "block_id"]


def _banded(blocks: DataFrame, wide: Column) -> DataFrame:
    """blocks with wide, band (spanning blocks at or above the head) and foot (of the last of them)."""
    page = Window.partitionBy(*PAGE)
    above = page.orderBy("c1").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = page.orderBy(*_DOWN).rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("wide", wide)
    spans = F.sum(F.col("wide").cast("int"))
    last = F.max(F.when(F.col("wide"), F.struct(*_DOWN, "c3"))).over(above)
    return b.withColumn("band", F.when(F.col("wide"), F.coalesce(spans.over(earlier), F.lit(0))).otherwise(spans.over(above))).withColumn("foot", last["c3"])


def _placed(b: DataFrame, *ranks: Column) -> DataFrame:
    order = Window.partitionBy(*PAGE).orderBy(*ranks, *_DOWN)
    return b.select(*PAGE, "block_id", (F.row_number().over(order) - 1).cast("int").alias("place"))


def column_order(blocks: DataFrame, width: float) -> DataFrame:
    """Place of each block: bands between spanning blocks, each left before right; pages without two columns go down.

    A block whose head lies beside the spanning block above it is read last. Ties go by
    head, left side, ord and id; empty input gives no rows.
    """
    x0, x1 = F.col("c0"), F.col("c2")
    narrow = x1 - x0 <= width * 0.62
    wide = ~narrow | ((x0 < width * 0.34) & (x1 > width * 0.66))
    page = Window.partitionBy(*PAGE)
    n = lambda cond: F.count(F.when(cond, 1)).over(page)
    left, right = narrow & (x0 < width * 0.30) & (x1 < width * 0.62), narrow & (x0 > width * 0.38) & (x1 > width * 0.70)
    b = _banded(blocks, wide).withColumn("columns", (n(F.lit(True)) >= 4) & (n(left) >= 2) & (n(right) >= 2))
    late = ~F.col("wide") & (F.col("c1") < F.col("foot"))
    band = F.when(late, F.lit(2**31 - 1)).otherwise(F.col("band"))
    column = F.when(F.col("wide"), 2).when(late, 0).otherwise(((x0 + x1) / 2 >= width / 2).cast("int"))
    return _placed(b, F.when(F.col("columns"), band), F.when(F.col("columns"), column))


def region_order(blocks: DataFrame, width: float) -> DataFrame:
    """Place of each block: regions between wide blocks, each left, right, then middle where both sides hold two or more.

    Ties and empty input as in column_order.
    """
    half, gutter, beyond = width / 2, width * 0.035, width * 0.18
    x0, x1 = F.col("c0"), F.col("c2")
    b = _banded(blocks, (x1 - x0 >= width * 0.68) | ((x0 < half - beyond) & (x1 > half + beyond)))
    side = F.when(x1 <= half + gutter, 0).when(x0 >= half - gutter, 1).otherwise(2)
    region = Window.partitionBy(*PAGE, "band", "wide")
    n = lambda k: F.count(F.when(F.col("side") == k, 1)).over(region)
    b = b.withColumn("side", side).withColumn("full", (n(0) >= 2) & (n(1) >= 2))
    return _placed(b, F.col("band"), F.col("wide"), F.when(F.col("full"), F.col("side")))


_FLAT = "f AS (SELECT paper_id, page, ord, block_id, bbox[1] AS c0, bbox[2] AS c1, bbox[3] AS c2, bbox[4] AS c3 FROM b WHERE len(bbox) = 4)"
# Spanning blocks are joined to the blocks at or below them, instead of running sums.
COLUMN_SQL = f"""
w AS (SELECT *, (c2 - c0 > 372 OR (c0 < 204 AND c2 > 396)) AS wide FROM f),
n AS (SELECT paper_id, page, count(*) AS n, count(*) FILTER (c2 - c0 <= 372 AND c0 < 180 AND c2 < 372) AS l, count(*) FILTER (c2 - c0 <= 372 AND c0 > 228 AND c2 > 420) AS r FROM w GROUP BY ALL),
s AS (SELECT paper_id, page, block_id, ord, c0, c1, c3, row_number() OVER (PARTITION BY paper_id, page ORDER BY c1, c0, ord, block_id) AS k FROM w WHERE wide),
j AS (SELECT w.paper_id, w.page, w.ord, w.block_id, w.c0, w.c1, w.c2, w.wide, count(s.k) AS above, arg_max(s.c3, s.k) AS foot, max(s.k) FILTER (s.block_id = w.block_id) AS own
  FROM w LEFT JOIN s ON s.paper_id = w.paper_id AND s.page = w.page AND s.c1 <= w.c1 GROUP BY ALL),
r AS (SELECT j.*, n.n >= 4 AND l >= 2 AND r >= 2 AS cols, NOT wide AND c1 < coalesce(foot, -1e9) AS late FROM j JOIN n ON n.paper_id = j.paper_id AND n.page = j.page)
SELECT paper_id, page, block_id, CAST(row_number() OVER (PARTITION BY paper_id, page ORDER BY
  CASE WHEN NOT cols THEN 0 WHEN late THEN 1000000000 WHEN wide THEN own - 1 ELSE above END,
  CASE WHEN NOT cols OR late THEN 0 WHEN wide THEN 2 WHEN (c0 + c2) / 2 >= 300 THEN 1 ELSE 0 END, c1, c0, ord, block_id) - 1 AS INT) AS place FROM r"""
REGION_SQL = f"""
w AS (SELECT *, (c2 - c0 >= 408 OR (c0 < 192 AND c2 > 408)) AS wide, CASE WHEN c2 <= 321 THEN 0 WHEN c0 >= 279 THEN 1 ELSE 2 END AS side FROM f),
s AS (SELECT paper_id, page, block_id, c1, row_number() OVER (PARTITION BY paper_id, page ORDER BY c1, c0, ord, block_id) AS k FROM w WHERE wide),
j AS (SELECT w.*, CASE WHEN wide THEN (SELECT k - 1 FROM s WHERE s.paper_id = w.paper_id AND s.page = w.page AND s.block_id = w.block_id)
  ELSE (SELECT count(*) FROM s WHERE s.paper_id = w.paper_id AND s.page = w.page AND s.c1 <= w.c1) END AS band FROM w),
n AS (SELECT paper_id, page, band, count(*) FILTER (side = 0) >= 2 AND count(*) FILTER (side = 1) >= 2 AS full_ FROM j WHERE NOT wide GROUP BY ALL)
SELECT j.paper_id, j.page, block_id, CAST(row_number() OVER (PARTITION BY j.paper_id, j.page ORDER BY j.band, wide, CASE WHEN full_ AND NOT wide THEN side ELSE 0 END, c1, c0, ord, block_id) - 1 AS INT) AS place
FROM j LEFT JOIN n ON n.paper_id = j.paper_id AND n.page = j.page AND n.band = j.band"""
READING_SQL = "WITH {b}, " + _FLAT + ", "
