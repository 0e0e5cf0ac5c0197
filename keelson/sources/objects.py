"""Objects and blobs: listing, ranged reads, content addresses, snapshots, JDBC tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_objects(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, length and modification time of the files under a folder; their content isn't read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "length", "modificationTime")


def read_objects(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")


def byte_range(content: Column, first: Column | int, last: Column | int | None = None) -> Column:
    """The bytes from ``first`` to ``last``, both included, as in an HTTP range."""
    first = F.lit(first) if isinstance(first, int) else first
    if last is None:
        return F.substring(content, first + 1, F.length(content))
    last = F.lit(last) if isinstance(last, int) else last
    return F.substring(content, first + 1, last - first + 1)


def content_addressed(blobs: DataFrame, content: str) -> DataFrame:
    """hash, length and copies of distinct contents: storing one again changes nothing."""
    addressed = blobs.select(F.sha2(content, 256).alias("hash"), F.octet_length(content).cast("long").alias("length"))
    return addressed.groupBy("hash").agg(F.max("length").alias("length"), F.count("*").alias("copies"))


def write_snapshot(rows: DataFrame, folder: str, version: int, sort: list[str] | None = None) -> str:
    """Writes a version of a table beside the others; sorted by key so that key ranges skip row groups."""
    path = f"{folder}/version={version}"
    (rows.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else rows).write.mode("overwrite").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the greatest version under ``folder``."""
    versions = spark.read.parquet(folder)
    return versions.join(F.broadcast(versions.agg(F.max("version").alias("version"))), "version").drop("version")


def jdbc_find(spark: SparkSession, url: str, table: str, example: dict[str, object], **options: str) -> DataFrame:
    """Rows of a JDBC table that equal the example; Spark pushes the equalities to the database."""
    from keelson.operators.records import find

    return find(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), example)
