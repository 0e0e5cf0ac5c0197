"""Ranks and running totals over groups of any size, without a window over a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one window of a bucket should hold, about.
BUCKET_ROWS = 512


def bits_for(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    """Bits of a hash to use as bucket, so that a bucket holds about ``per_bucket`` rows."""
    return min(20, max(4, math.ceil(math.log2(max(1, rows) / per_bucket + 1))))


def hash_order(*cols: Column | str) -> Column:
    """A uniform, non-negative 63-bit value that depends on ``cols`` alone: a shuffled order."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 1)


def hash_bucket(order: Column, bits: int) -> Column:
    """The first ``bits`` bits of a ``hash_order``; buckets are ranges of that order."""
    return F.shiftright(order, 63 - bits).cast("int")


def running_total(
    df: DataFrame, group: list[str], bucket: str, order: list[Column | str], value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the group (exclusive).

    Rows are ordered by ``bucket``, then by ``order``. Each bucket is summed by its own window and
    added to the total of the buckets before it, so a group is spread over its buckets however many
    rows it holds. Only one row for each group and bucket meets in the window over buckets. Nulls in
    ``group`` form a group of their own. Equal rows get their totals in any order.
    """
    # One struct as the key: nulls in it equal each other, and window, sums and join share its partitioning.
    keyed = df.withColumns({"_value": value, "_key": F.struct(*group, bucket)})
    sums = keyed.groupBy("_key").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*[F.col("_key")[k] for k in group])
    before = over.orderBy(F.col("_key")[bucket]).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_key", F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast(T.LongType()).alias("_start"))
    within = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return (
        local.join(starts, "_key", "left")
        .withColumn(name, (F.col("_start") + F.col("_local")).cast(T.LongType()))
        .drop("_value", "_local", "_start", "_key")
    )
