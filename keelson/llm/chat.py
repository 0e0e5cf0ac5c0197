"""Chat formatting with cumulative-snapshot collapse.

Chat logs often store a conversation again after every turn, so that a shorter row set is a prefix of
a longer one. Each turn gets a hash of all turns up to it (labelled turn hashes, combined by XOR along
the conversation), and a conversation whose last hash occurs inside another is a prefix of that one.
An anti-join keeps the maximal conversations, one of each set of equal ones, and only those are
rendered. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Turn numbers of one block of the rolling hash, and turns of one rendered row.
BLOCK, SEGMENT = 512, 512
#: How a turn is rendered, and the marks that a text may not hold itself.
TEMPLATE = "<|im_start|>%s\n%s<|im_end|>\n"
MARKS = ("<|im_start|>", "<|im_end|>")


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with their position in the conversation, from 1, without gaps.

    A conversation is cut into blocks of turn numbers; positions run within a block, then blocks are
    joined by their counts, so one very long conversation isn't one task.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40)).cast("long"))
    keyed = rows.withColumn("_block", block)
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    return keyed.withColumn("_at", F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy(*order)))


def _with_starts(turns: DataFrame) -> DataFrame:
    """Adds ``position``: the place in the whole conversation. Only conversations of several blocks have starts to add."""
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = turns.groupBy("conv_id", "_block").agg(F.max("_at").alias("_rows"))
    starts = counts.withColumn("_start", F.sum("_rows").over(earlier)).where("_start > 0").drop("_rows")
    placed = turns.join(starts, ["conv_id", "_block"], "left")
    return placed.withColumn("position", F.col("_at") + F.coalesce("_start", F.lit(0))).drop("_at", "_start")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, position, h1, h2: two 64-bit hashes of the turns up to each position.

    A turn's hash covers its position, role and text (nulls differ from empty texts), and those of a
    prefix are combined by XOR; with two independent hashes an accidental match is out of the question.
    """
    turns = _turns(conversations).select(
        "conv_id", "_block", "_at", F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("_turn"),
        F.xxhash64(F.lit("second"), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("_other"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    hashed = _with_starts(turns).select(
        "conv_id", "_block", "position",
        F.xxhash64("position", "_turn", "_other").alias("_h1"), F.xxhash64("_other", "position", "_turn").alias("_h2"),
    )
    rolling = Window.partitionBy("conv_id", "_block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.withColumns({"_r1": F.bit_xor("_h1").over(rolling), "_r2": F.bit_xor("_h2").over(rolling)})
    blocks = hashed.groupBy("conv_id", "_block").agg(F.bit_xor("_h1").alias("_b1"), F.bit_xor("_h2").alias("_b2"))
    before = blocks.select(
        "conv_id", "_block", F.bit_xor("_b1").over(earlier).alias("_p1"), F.bit_xor("_b2").over(earlier).alias("_p2")
    ).where(F.col("_p1").isNotNull())
    zero = F.lit(0).cast("long")
    return local.join(before, ["conv_id", "_block"], "left").select(
        "conv_id", "position",
        F.col("_r1").bitwiseXOR(F.coalesce("_p1", zero)).alias("h1"),
        F.col("_r2").bitwiseXOR(F.coalesce("_p2", zero)).alias("h2"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that no other one continues.

    Of equal conversations the least conv_id stays; ``copies`` says how many there were.
    """
    hashes = prefix_hashes(conversations)
    n = hashes.groupBy("conv_id").agg(
        F.max("position").alias("n_turns"), F.max_by(F.struct("h1", "h2"), "position").alias("_whole")
    )
    distinct = n.groupBy("n_turns", "_whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    # Each prefix, and the greatest number of turns of a conversation that begins with it.
    sized = hashes.join(n.select("conv_id", "n_turns"), "conv_id").where(F.col("position") < F.col("n_turns"))
    prefixes = sized.select(F.col("position").alias("n_turns"), F.struct("h1", "h2").alias("_whole")).distinct()
    return distinct.join(prefixes, ["n_turns", "_whole"], "left_anti").select("conv_id", "n_turns", "copies")


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn by ``TEMPLATE``; marks inside a role or text lose their bars, null roles are ``unknown``."""

    def plain(x: Column) -> Column:
        for mark in MARKS:
            x = F.replace(x, F.lit(mark), F.lit(mark.replace("|", "")))
        return x

    return F.format_string(TEMPLATE, plain(F.coalesce(role, F.lit("unknown"))), plain(F.coalesce(text, F.lit(""))))


def format_chats(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered: conv_id, segment, n_turns, copies, rendered.

    A conversation is one row, segment 0; one of more than ``SEGMENT`` turns continues in further
    segments, so no row or task holds a conversation of any length. Turns are ordered by turn, then
    role and text, nulls first. Rows without a conv_id belong to no conversation and are left out;
    repeated rows are turns of their own. An empty table gives no rows, other columns are ignored.
    """
    kept = maximal(conversations)
    placed = _with_starts(_turns(conversations))
    pieces = placed.join(kept, "conv_id").select(
        "conv_id", "n_turns", "copies",
        F.floor((F.col("position") - 1) / SEGMENT).alias("segment"),
        F.struct("position", rendered_turn(F.col("role"), F.col("text")).alias("r")).alias("_piece"),
    )
    grouped = pieces.groupBy("conv_id", "segment").agg(
        F.first("n_turns").cast("long").alias("n_turns"), F.first("copies").alias("copies"), F.sort_array(F.collect_list("_piece")).alias("_pieces")
    )
    return grouped.select("conv_id", "segment", "n_turns", "copies", F.array_join(F.col("_pieces.r"), "").alias("rendered"))
