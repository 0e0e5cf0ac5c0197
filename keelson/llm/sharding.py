"""Sharding by a hierarchical weighted hash tree.

A document descends from the root: at each level every child draws ``-ln(u) / weight`` with ``u`` a
uniform hash of (doc_id, the child's name), and the least draw wins. A child is drawn in proportion
to its weight, and its draw depends on nothing but its own name and weight, so a change moves
documents only into subtrees whose weight grew or out of subtrees whose weight shrank. A new shard
comes as a subtree of its own beside the regions; then documents move into it alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.ranking import bits_for, hash_bucket, hash_order, running_total


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``shard`` is set for leaves. An inner node weighs what its leaves do."""

    name: str
    own_weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = field(default=())

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` shards; whole racks and regions while they last.

    Shards beyond the last whole region are regions of their own, so ``tree(n + 1)`` adds one
    subtree to ``tree(n)`` unless that completes a region; use ``grown`` to add shards to a tree.
    """
    regions, shard = [], 0
    while shards - shard >= racks * per_rack:
        name = f"region{len(regions)}"
        inside = []
        for r in range(racks):
            leaves = tuple(Node(f"shard{shard + i}", shard=shard + i) for i in range(per_rack))
            inside.append(Node(f"{name}/rack{r}", children=leaves))
            shard += per_rack
        regions.append(Node(name, children=tuple(inside)))
    return Node("root", children=(*regions, *(Node(f"shard{i}", shard=i) for i in range(shard, shards))))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """``root`` with one more shard, as a region of its own."""
    return Node(root.name, children=(*root.children, Node(f"shard{shard}", weight, shard)))


def draw(key: Column, node: Node) -> Column:
    """The node's weighted draw for a key: exponential with rate ``weight``."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11)
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(node.weight))


def descend(key: Column, node: Node) -> Column:
    """The shard that a key reaches below ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [F.struct(draw(key, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(node.children)]
    won = F.least(*draws)["i"]
    out = F
    for i, child in enumerate(node.children):
        out = out.when(won == i, descend(key, child))
    return out


def shard_documents(docs: DataFrame, root: Node, new: Node) -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 1 (null: 1), ``slot`` numbers a shard's rows from 0
    without gaps, ``grown_shard`` is the shard under ``new``. doc_id alone decides; null ids share a
    shard, rows with equal ids too. Slots follow a hash of the row; equal rows take theirs in any
    order. text_crc32 of a null text is 0. An empty table gives no rows, other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bytes_ = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(bytes_) + 1).cast("long").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
        descend(key, root).cast("int").alias("shard"),
        descend(key, new).cast("int").alias("grown_shard"),
    )
    placed = placed.withColumn("_order", hash_order(F.lit("slot"), "doc_id", "text_crc32", "size"))
    placed = placed.withColumn("_bucket", hash_bucket(F.col("_order"), bits_for(docs.count())))
    order = ["_order", "doc_id", "text_crc32", "size"]
    return running_total(placed, ["shard"], "_bucket", order, F.lit(1), "slot").drop("_order", "_bucket")
