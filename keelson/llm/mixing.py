"""Mixing sources to target weights by weighted fair queueing.

Each source queues its documents in shuffled order, up to ``MAX_REPEATS`` times over. A document's
virtual finish time is the source's words up to and including it, divided by the source's target.
Documents are served by virtual finish time, over all sources, until the budget of words is used up.

No source is ever in one task: words before a document in its source, and words served before a
virtual time, are running totals over buckets (of the shuffled order, and of the virtual time). As
each source's words are spread evenly over virtual time, so are the buckets. All of this is done on rows
without texts; what comes out is one row for each source, from which each document's share follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.plans.ranking import bits_for, hash_bucket, running_total
from keelson.session import discard, settle

#: Weights of the sources by code point order, repeating; passes over a source at most.
WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of characters other than space, tab and line ends; 0 for a null text."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target and documents: the budget is all words, shared by weight.

    A target stops at ``MAX_REPEATS`` times its source's size and the excess is reshared by weight:
    with sources in order of cap by weight, the first k are capped for the smallest k at which no
    other source's share is above its cap. Windows run over one row for each source.
    """
    everything = Window.partitionBy()
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighted = (
        sizes.withColumn("_weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * MAX_REPEATS)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    )
    by_ratio = Window.partitionBy().orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    up_to = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(up_to), F.lit(0))) / F.sum("_weight").over(rest)
    # the level if exactly the sources before this one are capped; it holds if this one isn't
    levels = weighted.withColumn("_level", F.when(level <= F.col("_ratio"), level))
    final = F.max("_level").over(everything)  # further levels, with more sources capped, are lower
    return levels.select(
        "source", "source_size",
        F.coalesce(F.least(final * F.col("_weight"), F.col("_cap").cast("double")), F.lit(0.0)).alias("target"), "documents",
    )


def shuffled(doc_id: Column) -> Column:
    """A place in the shuffled order: the first 60 bits of the MD5 of the id's text."""
    text = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def checksum(text: Column) -> Column:
    """CRC-32 of the text; a null text counts as empty."""
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


#: Order of a source's documents in each pass; rows equal in all of these are served in any order.
ORDER = ("_order", "doc_id", "_size", "_crc")


def schedule(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Where the service of each source ends: one row for each source, from rows of (source, *ORDER).

    source, source_size, target, whole (passes served in full) and, of the pass after those, the last document
    served (``last``, null if none), with how many rows equal it (equal) and how many of these are served (among).
    A source without words is served in full once. As a source's documents have the same order in
    each pass and finish times rise along it, this says of every document how often it is served.
    """
    aims = settle(targets(sized.select("source", F.col("_size").alias("size")), weights), "targets")
    n, budget, sources = aims.agg(F.sum("documents"), F.sum("source_size"), F.count("*")).first()
    bits, order = bits_for(n or 0), list(ORDER)
    queued = running_total(
        sized.withColumn("_bucket", hash_bucket(F.col("_order") * 8, bits)), ["source"], "_bucket", order, F.col("_size"), "_before"
    )
    passes = (
        queued.drop("_bucket").join(*_by_source(queued, aims.drop("documents").withColumnRenamed("source", "_source"), sources))
        .drop("_source").where("target > 0")
        .withColumn("_pass", F.explode(F.array(*[F.lit(i).cast("long") for i in range(MAX_REPEATS)])))
        .withColumn("_finish", (F.col("_pass") * F.col("source_size") + F.col("_before") + F.col("_size")) / F.col("target"))
        .withColumn("_null_source", F.col("source").isNull())
        .withColumn("_slice", F.floor(F.col("_finish") * F.lit(float(1 << bits))).cast("long"))
    )
    # Each source's target is the words with a finish time of at most 1, so the budget ends near 1.
    by_time = ["_finish", "_null_source", "source", "_pass", *order]
    served = settle(passes.select(*by_time, "_slice"), "passes")
    # The slice in which the budget is used up, looked for among ranges of slices and then within one; so no window is long.
    totals = served.groupBy("_slice").agg(F.sum("_size").alias("_sum")).withColumn("_range", F.floor(F.col("_slice") / RANGE))
    range_, start = _reached(totals.groupBy(F.col("_range").alias("_at")).agg(F.sum("_sum").alias("_sum")), 0, budget or 0)
    slice_, start = _reached(totals.where(F.col("_range") == range_).select(F.col("_slice").alias("_at"), "_sum"), start, budget or 0)
    # Then the first document in it that would exceed the budget.
    within = Window.partitionBy("_slice").orderBy(*by_time)
    place = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by_time)])
    cut = (
        served.where(F.col("_slice") == slice_)
        .withColumn("_total", start + F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("_total") > (budget or 0))
        .orderBy(*by_time).limit(1)
        .select(place.alias("_cut"))
    )
    in_time = served.join(F.broadcast(settle(cut, "cut")), F.lit(True), "left").withColumn("_in", F.col("_cut").isNull() | (place < F.col("_cut")))
    here = F.struct(*order)
    lasts = (
        in_time.where("_in").groupBy("source").agg(F.max(F.struct("_pass", here.alias("_at"))).alias("_last"))
        .select(F.col("source").alias("_source"), F.col("_last._pass").alias("_p"), F.col("_last._at").alias("last"))
    )
    at_last = in_time.join(*_by_source(in_time, lasts, sources)).where((F.col("_pass") == F.col("_p")) & (here == F.col("last")))
    found = at_last.groupBy("source").agg(
        F.first("_p").alias("whole"), F.first("last").alias("last"), F.count("*").alias("equal"), F.count_if("_in").alias("among")
    )
    return settle(
        aims.join(found.withColumnRenamed("source", "_source"), aims["source"].eqNullSafe(F.col("_source")), "left").select(
            "source", "source_size", "target", F.coalesce("whole", F.when(F.col("target") > 0, 0).otherwise(1)).cast("int").alias("whole"), "last", "equal", "among"
        ),
        "schedule",
    )


#: Slices of virtual time in a range.
RANGE = 1024


def _reached(sums: DataFrame, start: int, budget: int) -> tuple[int, int]:
    """The first of ``sums`` (_at, _sum) that exceeds the budget, and what comes before it; -1 if none does."""
    ahead = Window.partitionBy().orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        sums.withColumn("_start", start + F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
        .where(F.col("_start") + F.col("_sum") > budget)
        .orderBy("_at").select("_at", "_start").first()
    )
    return (found["_at"], found["_start"]) if found else (-1, start)


#: Sources up to which a row for each is broadcast; at some 200 bytes these are at most a few MB.
BROADCAST_SOURCES = 10_000
#: Beyond it, each source's row is joined by a shuffle in so many places, as one source may have most rows.
PLACES = 64


def _by_source(rows: DataFrame, other: DataFrame, sources: int) -> tuple[DataFrame, Column]:
    """What to join ``rows`` with, and on what: a table of one row for each ``_source``, nulls included."""
    same = rows["source"].eqNullSafe(other["_source"])
    if sources <= BROADCAST_SOURCES:
        return F.broadcast(other), same
    spread = other.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
    return spread, same & (F.pmod(F.xxhash64("doc_id", "source"), F.lit(PLACES)) == F.col("_place"))


def _placed(docs: DataFrame, size: Column) -> DataFrame:
    """Rows apart in ``_row``, so that no name of theirs matters, with source and ORDER."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source",
        size.alias("_size"), shuffled(F.col("doc_id")).alias("_order"), checksum(F.col("text")).alias("_crc"),
    )


def _with_copies(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``_placed`` with their source's row of the schedule and ``copies``.

    Only one source can end between equal rows. These are numbered, the first ones served once more; as they
    may be a great part of the table, the numbers are running totals over buckets of a settled table.
    """
    last, at = F.col("last"), [F.col(c) for c in ORDER]
    # size and checksum only matter, and are only worked out, where order and id are equal
    later = F.when(at[0] != last["_order"], at[0] > last["_order"]).otherwise(F.struct(*at) > last)
    served = F.col("whole") + F.when(last.isNull() | later, 0).otherwise(1)
    sources, ties = plan.agg(F.count("*"), F.count_if(F.col("among") < F.col("equal"))).first()
    joined = placed.join(*_by_source(placed, plan.withColumnRenamed("source", "_source"), sources)).drop("_source")
    if not ties:
        return joined.withColumn("copies", served.cast("int"))
    tied = F.coalesce((F.col("among") < F.col("equal")) & (at[0] == last["_order"]) & (F.struct(*at) == last), F.lit(False))
    rows = settle(joined.where(tied).withColumn("_number", F.monotonically_increasing_id()), "equal rows")
    numbered = running_total(
        rows.withColumn("_bucket", F.shiftright("_number", 9)), ["source"], "_bucket", ["_number"], F.lit(1), "_rank"
    ).withColumn("copies", (F.col("whole") + (F.col("_rank") < F.col("among")).cast("int")).cast("int"))
    return joined.where(~tied).withColumn("copies", served.cast("int")).unionByName(numbered.drop("_number", "_bucket", "_rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, its ``columns`` (all by default) with size, source_size, target, copies and taken.

    ``copies`` says how often the document is served (0 to ``MAX_REPEATS``) and ``taken`` how many
    words that is. Order of service: virtual finish time, source (null last), pass, shuffled order,
    doc_id, then size and CRC-32 of the text; equal rows are served in any order. The first document
    that would exceed the budget ends the service. Null and empty texts have size 0: they are served
    with the document before them and take nothing. With no words at all, targets are 0 and every
    document is served once. Columns of ``docs`` named like a result column are replaced.
    """
    kept = [c for c in columns or docs.columns if c.lower() not in ("size", "source_size", "target", "copies", "taken")]
    placed = _placed(docs, words(F.col("text")))
    # words are counted once
    placed = settle(placed.withColumn("_row", F.struct(*[F.col("_row")[c].alias(c) for c in kept])), "sized")
    plan = schedule(placed.drop("_row"), weights)
    found = _with_copies(placed, plan)
    return found.select("_row.*", F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def serve(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` that the mix serves, with their columns alone, one row for each time.

    The service is planned on rows without texts; then texts are read once more and never shuffled.
    """
    narrow = settle(_placed(docs, words(F.col("text"))).drop("_row"), "sized")
    plan = schedule(narrow, weights)
    discard(narrow)
    found = _with_copies(_placed(docs, words(F.col("text"))), plan).where("copies > 0")
    return found.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
