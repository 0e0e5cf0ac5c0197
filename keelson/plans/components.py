"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.session import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``edges`` (a, b).

    In each round every node joins its least neighbour, if that is less than itself; each tree that arises becomes one
    node, its root, and only edges between different ones go on. So what has grown together costs nothing in later
    rounds, whatever its size, and any two rounds leave at most half of the nodes. The rounds' tables of nodes are put
    together from the last to the first; none leaves the cluster.
    """
    left = settle(_between(edges), "edges")
    rounds = []
    while left.head(1):
        both = left.union(left.select("b", "a"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        rounds.append(_roots(settle(least.where("component < node"), "roots")))
        step = settle(_between(contracted(left, rounds[-1])), "edges")
        discard(left)
        left = step
    found = settle(left.select(F.col("a").alias("node"), F.col("b").alias("component")), "roots")  # no rows
    discard(left)
    for step in reversed(rounds):
        table = settle(renamed(step.select("node", "component"), "component", found).union(found), "roots")
        discard(step, found)
        found = table
    # a component's least node was the root of its tree in every round, so it alone has no row yet
    whole = settle(found.union(found.select(F.col("component").alias("node"), "component").distinct()), "components")
    discard(found)
    return whole


def contracted(edges: DataFrame, found: DataFrame) -> DataFrame:
    """``edges`` (a, b) between the components of their nodes; ``found`` is as ``components`` returns it."""
    return renamed(renamed(edges, "a", found), "b", found)


def renamed(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``rows`` with the component of ``column``'s node in its place; nodes without a row in ``found`` stay."""
    to = found.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
    return rows.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def _between(edges: DataFrame) -> DataFrame:
    """The different edges between different nodes, each in one direction."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(up: DataFrame) -> DataFrame:
    """node and the end of its path in ``up`` (node, component), settled; each round doubles the steps taken at once."""
    while True:
        to = up.select(F.col("node").alias("_node"), F.col("component").alias("_to"))
        jumped = up.select("node", "component").join(to, F.col("component") == F.col("_node"), "left").select(
            "node", F.coalesce("_to", "component").alias("component"), F.col("_to").isNotNull().alias("_moved")
        )
        step = settle(jumped, "roots")
        discard(up)
        up = step
        if not up.where("_moved").head(1):
            return up
