"""First-row-per-key dedup and ordered limits.

``row_number() = 1`` lets Catalyst plan a WindowGroupLimit, which keeps one
row per key in each map task before the shuffle, so a key holding a third of
all rows ships one row per task rather than all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


TAKE_ORDERED_MAX = 100_000


def first_n(df: DataFrame, order: list[Column], n: int | None,
            take_ordered_max: int = TAKE_ORDERED_MAX) -> DataFrame:
    """First N rows in a total order; ``None`` keeps everything.

    Small N: ``orderBy().limit(n)`` is a TakeOrderedAndProject (each task
    keeps its top N, one task merges at most N per task). Large N: an exact
    distributed cut instead, so N rows never pass through one task: a
    range-partitioned sort is written to the shared checkpoint folder, the
    per-partition row counts (one small row per partition) give each
    partition's global offset, and each row's global position is its
    partition offset plus its position inside the partition."""
    if n is None:
        return df
    if n <= take_ordered_max:
        return df.orderBy(*order).limit(n)
    from shortlist.session import cut_lineage
    sorted_df = cut_lineage(df.orderBy(*order).withColumn("_pid", F.spark_partition_id())
                            .withColumn("_mid", F.monotonically_increasing_id()))
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)) + 1
    return (sorted_df.join(F.broadcast(offsets), "_pid")          # one row per partition
            .filter(pos <= n).drop("_pid", "_mid", "_off"))
