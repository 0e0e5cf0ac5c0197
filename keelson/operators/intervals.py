"""Ranges of integers: overlay by last writer, reads with gaps filled, merging of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlay(writes: DataFrame, segment: str, seq: str) -> DataFrame:
    """segment, start, end, seq: which write is seen where, later ones on top.

    writes: segment, start, end (exclusive), seq. Each segment is cut at all bounds; every piece takes
    the latest write that covers it, and neighbours of the same write are joined again.
    """
    bounds = writes.select(segment, F.explode(F.array("start", "end")).alias("at")).distinct()
    line = Window.partitionBy(segment).orderBy("at")
    pieces = bounds.withColumn("to", F.lead("at").over(line)).where("to IS NOT NULL")
    w, p = writes.alias("w"), pieces.alias("p")
    cover = p.join(w, (F.col(f"p.{segment}") == F.col(f"w.{segment}")) & (F.col("w.start") <= F.col("p.at")) & (F.col("w.end") >= F.col("p.to")))
    seen = cover.groupBy(F.col(f"p.{segment}").alias(segment), F.col("p.at").alias("at"), F.col("p.to").alias("to")).agg(F.max(f"w.{seq}").alias(seq))
    order = Window.partitionBy(segment).orderBy("at")
    begins = (F.lag("to").over(order).eqNullSafe(F.col("at")) & F.lag(seq).over(order).eqNullSafe(F.col(seq))) == F.lit(False)
    islands = seen.withColumn("_begins", begins.cast("int")).withColumn("_island", F.sum("_begins").over(order))
    return islands.groupBy(segment, "_island", seq).agg(F.min("at").alias("start"), F.max("to").alias("end")).drop("_island")


def coalesce_ranges(ranges: DataFrame, group: list[str], gap: int = 0) -> DataFrame:
    """Ranges (start, end) of a group that touch or lie at most ``gap`` apart, as one; pieces counts them."""
    order = Window.partitionBy(*group).orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") > so_far + gap).cast("int"), F.lit(1))
    islands = ranges.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*group, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("pieces")).drop("_island")


def overlaps(requests: DataFrame, chunks: DataFrame, segment: str, width: int) -> DataFrame:
    """Pairs of requests (id, segment, from, until) and chunks (segment, start, end) with the shared range.

    Both are cut into cells of ``width``, so the join is on equal (segment, cell) instead of on ranges;
    a pair is reported in the first cell that both touch.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width)))
    r = requests.where(F.col("from") < F.col("until")).withColumn("_cell", cells(F.col("from"), F.col("until")))
    c = chunks.where(F.col("start") < F.col("end")).withColumn("_cell", cells(F.col("start"), F.col("end")))
    lo, hi = F.greatest("from", "start"), F.least("until", "end")
    return r.join(c, [segment, "_cell"]).where((lo < hi) & (F.floor(lo / width) == F.col("_cell"))).withColumns({"lo": lo, "hi": hi}).drop("_cell")


def split_by_segment(requests: DataFrame, size: int) -> DataFrame:
    """Byte ranges (offset, length) as one row for each segment they touch: segment, from, until."""
    last = F.col("offset") + F.col("length") - 1
    parts = requests.where("length > 0").withColumn("segment", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor(last / size))))
    base = F.col("segment") * size
    return parts.withColumns({"from": F.greatest(F.col("offset") - base, F.lit(0)), "until": F.least(last + 1 - base, F.lit(size))})
