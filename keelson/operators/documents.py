"""Tables of JSON documents whose columns are found in the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_path(doc: Column, path: str, known: set[str] | None = None) -> Column:
    """The value at a dotted path; null if a part is missing or null. A nested value is its JSON text.

    A name with dots that is itself a top-level column (in ``known``) is taken literally.
    """
    parts = [path] if known and path in known else path.split(".")
    return F.get_json_object(doc, "$" + "".join(f"['{p}']" for p in parts))


def project(docs: DataFrame, columns: dict[str, str], doc: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """Output name to path, positionally: columns may be renamed, reordered and repeated."""
    return docs.select(*keep, *[json_path(F.col(doc), path).alias(name) for name, path in columns.items()])


def dictionary(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """name and occurrences of every top-level key; partial sums run before the shuffle."""
    return docs.select(F.explode(F.json_object_keys(doc)).alias("name")).groupBy("name").agg(F.count("*").alias("occurrences"))


def expand(docs: DataFrame, names: list[str], doc: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """All known columns as text, parsed once for each document."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return docs.select(*keep, F.from_json(doc, schema).alias("_d")).select(*keep, *[F.col("_d")[n].alias(n) for n in names])


def ensure_keys(known: DataFrame, found: DataFrame) -> DataFrame:
    """known (name, id) with names of ``found`` that it lacks, numbered on from its greatest id, by name.

    Both sides are dictionaries, with one row for each column name of a table.
    """
    from pyspark.sql.window import Window

    new = found.select("name").distinct().join(known, "name", "left_anti")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = new.withColumn("n", F.row_number().over(Window.orderBy("name"))).crossJoin(F.broadcast(top))
    return known.select("name", "id").unionByName(numbered.select("name", (F.col("top") + F.col("n")).cast("long").alias("id")))


def fold_fields(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``$set`` and ``$inc`` changes (key, op, field, value as text) as one value for each key and field.

    The last ``$set`` stands, and later ``$inc`` add to it; increments before it are overwritten.
    """
    at = F.struct(*order)
    last = changes.where(F.col("op") == "$set").groupBy(key, "field").agg(
        F.max_by("value", at).alias("base"), F.max(at).alias("since")
    )
    adds = changes.where(F.col("op") == "$inc").select(key, "field", at.alias("at"), F.col("value").cast("long").alias("delta"))
    joined = adds.join(last, [key, "field"], "full_outer")
    live = F.when(F.col("since").isNull() | (F.col("at") > F.col("since")), F.col("delta"))
    return joined.groupBy(key, "field").agg(F.first("base").alias("base"), F.sum(live).alias("added")).select(
        key, "field", F.when(F.col("added").isNull(), F.col("base")).otherwise((F.coalesce(F.col("base").cast("long"), F.lit(0)) + F.col("added")).cast("string")).alias("value")
    )
