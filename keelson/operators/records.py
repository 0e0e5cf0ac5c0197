"""Typed record sets: query by example, guarded changes, uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(example: dict[str, object]) -> Column:
    """All fields of the example equal; a null field of a row never matches."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in example.items()], F.lit(True))


def compare(column: str, op: str, value: object) -> Column:
    """LESS_THAN, GREATER_THAN or STARTS_WITH; a null is false."""
    c = F.col(column)
    test = {"LESS_THAN": c < F.lit(value), "GREATER_THAN": c > F.lit(value), "STARTS_WITH": c.cast("string").startswith(str(value))}[op]
    return F.coalesce(test, F.lit(False))


def find(rows: DataFrame, example: dict[str, object], *conditions: Column, limit: int | None = None) -> DataFrame:
    out = reduce(lambda df, c: df.where(c), conditions, rows.where(matches(example)))
    return out if limit is None else out.limit(limit)


def find_one(rows: DataFrame, example: dict[str, object]) -> DataFrame:
    """The only match, if there is one; an error, once an action runs, if there are more."""
    two = find(rows, example, limit=2)
    n = two.agg(F.count("*").alias("_n"))
    checked = two.crossJoin(F.broadcast(n)).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row matches"))).isNull())
    return checked.drop("_n")


def insert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` and those of ``new`` whose key isn't there yet; of equal new keys one goes in."""
    return rows.unionByName(new.dropDuplicates(key).join(rows.select(*key), key, "left_anti").select(*rows.columns))


def update(rows: DataFrame, new: DataFrame, key: list[str], guard: Column | None = None, partial: bool = False) -> DataFrame:
    """``rows`` with those of equal key replaced by ``new`` where ``guard`` holds on the old row, and changed.

    With ``partial`` a null in ``new`` leaves the old value. ``new`` has one row for each key.
    """
    others = [c for c in rows.columns if c not in key]
    named = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in others], F.lit(True).alias("_hit"))
    joined = rows.join(named, key, "left")
    changed = F.coalesce(F.col("_hit"), F.lit(False)) & F.coalesce(guard if guard is not None else F.lit(True), F.lit(False))
    value = lambda c: F.coalesce(f"_new_{c}", c) if partial else F.col(f"_new_{c}")
    return joined.select(*key, *[F.when(changed, value(c)).otherwise(F.col(c)).alias(c) for c in others], changed.alias("changed"))


def upsert(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with those of equal key replaced, and the others of ``new`` added."""
    return rows.join(new.select(*key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: list[str], guard: Column | None = None) -> DataFrame:
    """``rows`` without those of the given keys for which ``guard`` holds."""
    if guard is None:
        return rows.join(keys.select(*key), key, "left_anti")
    marked = rows.join(keys.select(*key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.where(~F.coalesce(F.col("_hit") & guard, F.lit(False))).select(*rows.columns)


def reindex(rows: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Rows whose derived columns aren't what they should be, with what they should be."""
    differs = reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(v) for k, v in derived.items()], F.lit(False))
    return rows.where(differs).withColumns(derived)
