"""Trees of (parent, name, inode): path resolution, listing, moving and deleting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import discard, settle


#: Parts of a path that are looked up before the open paths are settled.
STEPS = 8


def resolve(entries: DataFrame, paths: DataFrame, root: int) -> DataFrame:
    """path and inode: each part of a path looked up below the one before; null where a part is missing.

    Each step is one join of the paths with the entries; there are as many as the longest path has parts.
    """
    from keelson.functions.scalars import path_parts

    here = paths.select("path", path_parts(F.col("path")).alias("_parts"), F.lit(root).cast("long").alias("inode"))
    step = entries.select(F.col("parent").alias("_parent"), F.col("name").alias("_name"), F.col("inode").alias("_child"))
    for i in range(here.agg(F.max(F.size("_parts"))).first()[0] or 0):
        part = F.try_element_at("_parts", F.lit(i + 1))
        joined = here.join(step, (F.col("inode") == F.col("_parent")) & (part == F.col("_name")), "left")
        here = joined.select("path", "_parts", F.when(F.size("_parts") <= i, F.col("inode")).otherwise(F.col("_child")).alias("inode"))
        if i % STEPS == STEPS - 1:
            here = settle(here, "paths")
    return here.select("path", "inode")


def ancestors(edges: DataFrame) -> DataFrame:
    """node, ancestor and depth for every node of ``edges`` (node, parent) and every one above it, however deep.

    Distances double in each round: pairs up to a distance are extended by the table of ancestors at just
    that distance, until nothing is that deep. Edges that form a cycle are an error.
    """
    found = settle(edges.where(F.col("parent").isNotNull()).select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "ancestors")
    jump, far, nodes = found.select("node", "ancestor"), 1, edges.count()
    while jump.head(1):
        if far > nodes:
            raise ValueError("the edges form a cycle")
        up = jump.select(F.col("node").alias("_at"), F.col("ancestor").alias("_up"))
        further = found.join(up, F.col("ancestor") == F.col("_at")).select("node", F.col("_up").alias("ancestor"), (F.col("depth") + far).alias("depth"))
        twice = jump.join(up, F.col("ancestor") == F.col("_at")).select("node", F.col("_up").alias("ancestor"))
        before, found, jump, far = found, settle(found.unionByName(further), "ancestors"), settle(twice, "jumps"), 2 * far
        if far > 2:
            discard(before)
    return found


def list_children(entries: DataFrame, inodes: DataFrame, parent: int) -> DataFrame:
    """Entries of a directory with their attributes; an entry without an inode has nulls."""
    return entries.where(F.col("parent") == parent).join(inodes, "inode", "left")


def move(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """Entries after moves (parent, name, to_parent, to_name); a move to a taken place does nothing."""
    taken = entries.select(F.col("parent").alias("to_parent"), F.col("name").alias("to_name"))
    allowed = moves.join(taken, ["to_parent", "to_name"], "left_anti").dropDuplicates(["to_parent", "to_name"])
    joined = entries.join(allowed, ["parent", "name"], "left")
    return joined.select(
        F.coalesce("to_parent", "parent").alias("parent"), F.coalesce("to_name", "name").alias("name"), "inode"
    )


def delete(entries: DataFrame, names: DataFrame, at_millis: int) -> tuple[DataFrame, DataFrame]:
    """The entries left, and tombstones (inode, at, parent, name) of those removed."""
    gone = entries.join(names, ["parent", "name"], "left_semi")
    return entries.join(names, ["parent", "name"], "left_anti"), gone.withColumn("at", F.lit(at_millis).cast("long"))
