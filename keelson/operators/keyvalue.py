"""Keyed reads and ordered command folds.

Commands are rows (key, seq, op, value). Folds that are associative are grouped aggregates with partial
sums before the shuffle; folds in which each step depends on the one before run over a key's commands
in order, and a key's commands are then in one task by their nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.functions.scalars import wrap64


def scan(entries: DataFrame, keyspace: Column | None = None, start: Column | None = None, ordered: bool = False) -> DataFrame:
    """Entries of a keyspace from a key on, ordered by key if asked to."""
    out = entries if keyspace is None else entries.where(F.col("keyspace_id") == keyspace)
    out = out if start is None else out.where(F.col("key") >= start)
    return out.orderBy("key") if ordered else out


def prefix_scan(entries: DataFrame, prefix: str, keys_only: bool = False) -> DataFrame:
    """Entries whose key starts with ``prefix``; pushed down to Parquet as a filter."""
    out = entries.where(F.col("key").startswith(prefix))
    return out.select("key") if keys_only else out


def prefix_view(entries: DataFrame, prefix: str) -> DataFrame:
    """The entries under a prefix, as a store of its own: the prefix is taken off the keys."""
    return prefix_scan(entries, prefix).withColumn("key", F.substring("key", F.lit(len(prefix) + 1), F.length("key")))


def exists(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """key and found (1 or 0) for each row of ``keys``."""
    present = entries.select(F.col("key").alias("_k")).distinct()
    return keys.join(present, F.col("key") == F.col("_k"), "left").select("key", F.col("_k").isNotNull().cast("int").alias("found"))


def last_write(commands: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    return commands.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias("value"))


def first_write(commands: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    return commands.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias("value"))


def live(commands: DataFrame, key: list[str], op: str, value: str, order: list[str], tombstone: str = "DELETE") -> DataFrame:
    """The last value of keys whose last command isn't the tombstone."""
    last = commands.groupBy(*key).agg(F.max_by(F.struct(F.col(op).alias("o"), F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    return last.where(F.col("_last.o") != tombstone).select(*key, F.col("_last.v").alias("value"))


def multi_delete(entries: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries left, and the count of those removed (one row: changed)."""
    gone = keys.select("key").distinct()
    return entries.join(gone, "key", "left_anti"), entries.join(gone, "key", "left_semi").agg(F.count("*").alias("changed"))


def appended(commands: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Values of a key, one after another."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return commands.groupBy(*key).agg(F.array_join(parts["_v"], "").alias("value"))


def incremented(commands: DataFrame, key: list[str], delta: Column) -> DataFrame:
    """The sum of a key's deltas in 64 bits, wrapping around."""
    return commands.groupBy(*key).agg(wrap64(F.sum(delta.cast("decimal(20,0)"))).alias("value"))


def running(commands: DataFrame, key: list[str], order: list[str], value: Column, name: str, exclusive: bool = False) -> DataFrame:
    """The result after each command of a key (before it, if ``exclusive``)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return commands.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def conditional_fold(commands: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The value left by commands in order: key, value, applied (how many changed something).

    Columns: op (SET, DELETE, APPEND, INCREMENT), value, if_value and if_not_exists. SET and DELETE with
    ``if_value`` need that present value (a missing key never matches); SET with ``if_not_exists`` needs
    a missing key.
    """
    fields = [*order, "op", "value", "if_value", "if_not_exists"]
    steps = F.sort_array(F.collect_list(F.struct(*fields)))
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, c: Column) -> Column:
        now = state["v"]
        allowed = F.coalesce(
            F.when(F.coalesce(c["if_not_exists"], F.lit(False)), now.isNull()).when(c["if_value"].isNotNull(), now == c["if_value"]).otherwise(F.lit(True)),
            F.lit(False),
        )
        new = (
            F.when(c["op"] == "SET", c["value"])
            .when(c["op"] == "DELETE", F.lit(None).cast("string"))
            .when(c["op"] == "APPEND", F.concat(F.coalesce(now, F.lit("")), c["value"]))
            .when(c["op"] == "INCREMENT", wrap64(F.coalesce(now, F.lit("0")).cast("decimal(20,0)") + c["value"].cast("decimal(20,0)")).cast("string"))
            .otherwise(now)
        )
        changes = allowed & ((c["op"] != "DELETE") | now.isNotNull())
        return F.struct(F.when(changes, new).otherwise(now).alias("v"), (state["n"] + changes.cast("long")).alias("n"))

    folded = commands.groupBy(*key).agg(F.aggregate(steps, start, step).alias("_s"))
    return folded.select(*key, F.col("_s.v").alias("value"), F.col("_s.n").alias("applied"))


def compound(requests: DataFrame) -> DataFrame:
    """Children of compound requests (seq, children) as commands in order of (seq, child)."""
    return requests.select("seq", F.posexplode("children").alias("child", "c")).select("seq", "child", "c.*")


def versioned_delete(entries: DataFrame, requests: DataFrame, version: Column) -> DataFrame:
    """key and code for each request (key, if_version): DONE, NOT_FOUND or VERSION_MISMATCH."""
    found = entries.select(F.col("key").alias("_k"), version.alias("_version"))
    code = (
        F.when(F.col("_k").isNull(), "NOT_FOUND")
        .when(F.col("if_version").isNotNull() & (F.col("if_version") != F.col("_version")), "VERSION_MISMATCH")
        .otherwise("DONE")
    )
    return requests.join(found, F.col("key") == F.col("_k"), "left").select("key", code.alias("code"))
