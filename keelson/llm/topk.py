"""Exact top-k search by inner product: the threshold algorithm over sorted lists.

Queries and candidates are dealt into blocks, and each pair of blocks is one group. In a group the
candidates are sorted once for each dimension. A query walks all its lists from the end that adds most
to its score, a depth at a time; every candidate met is scored in full, and when no candidate further
down the lists can reach the kth best score found so far the walk ends. That bound is the sum of what
the lists offer at the present depth. The best of all groups are merged by score and id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.session import ship

#: Rows of a block of queries and of candidates, and the first depth of a walk, which doubles.
QUERY_BLOCK, CANDIDATE_BLOCK, DEPTH = 1024, 4096, 32
#: 64-bit integers.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def walk(lists: np.ndarray, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best ``k`` of a block for one query: ids, scores, and how deep the lists were read.

    lists: for each dimension the candidates by ascending value, (rows, dimensions). Ids equal to
    ``own`` never count. A candidate that ties with the kth may still have a smaller id, so the walk
    ends only when the bound is below the kth score, or when every candidate has been met.
    """
    n = len(rows)
    up = q > 0
    seen = np.zeros(n, bool)
    best_ids, best = np.empty(0, np.int64), np.empty(0, q.dtype)
    depth, step = 0, DEPTH
    while depth < n and rows.shape[1]:
        end = min(n, depth + step)
        part = np.where(up, lists[n - end : n - depth][::-1], lists[depth:end])
        before = seen.copy()
        seen[part.ravel()] = True
        met = np.flatnonzero(seen & ~before)
        scores = rows[met] @ q
        if q.dtype == object:
            scores = np.minimum(np.maximum(scores, LEAST), MOST)
        found = ids[met]
        if (other := found != own).sum() < len(found):
            scores, found = scores[other], found[other]
        best_ids, best = np.concatenate([best_ids, found]), np.concatenate([best, scores])
        if len(best) > k:
            good = best >= np.partition(best, len(best) - k)[len(best) - k]
            best_ids, best = best_ids[good], best[good]
        depth, step = end, step * 2
        if seen.all() or len(best) >= k and rows[part[-1], np.arange(len(q))] @ q < best.min():
            break
    order = np.lexsort((best_ids, -best))[:k]
    return best_ids[order], best[order], depth


def matrix(rows: pa.Table, name: str) -> np.ndarray:
    """The vectors of a column as rows, shorter ones padded with zeros."""
    column = rows.column(name).combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def blocks_for(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def valid(embedding: Column) -> Column:
    """True for vectors that aren't null and hold neither nulls nor NaN nor infinities."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(odd, F.lit(True))


def integers(embedding: Column, scale: int = 64) -> Column:
    """Each component x as floor(scale * x), with x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """The ``k`` best other rows of ``vectors`` (vec_id, embedding) for each row where ``queries`` holds.

    query_id, rank from 1, vec_id, score, depth (how far the lists of the candidate's block were read).
    Score: inner product of the integer vectors; ties go to the smaller vec_id. Queries with fewer than
    ``k`` candidates get all of them. Vectors null or holding null, NaN or infinite components, and rows
    without vec_id, take no part. Shorter vectors count as padded with zeros. Repeated candidate rows
    each count; of query rows with one vec_id the one with the least integer vector asks. Integers and scores beyond
    64 bits are cut to the nearest 64-bit integer, and then ties go to the smaller vec_id. An empty table gives no rows.
    """
    ints = vectors.where(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), queries.alias("_asks")
    )
    asked = ints.where("_asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    row = ints.agg(F.count("*").alias("n"), F.count_if("_asks").alias("q")).first()
    candidate_blocks, query_blocks = blocks_for(row["n"], CANDIDATE_BLOCK), blocks_for(row["q"], QUERY_BLOCK)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(n)).cast("int")
    left = asked.select("vec_id", "v", own(query_blocks, "q").alias("qb")).withColumn("cb", spread(candidate_blocks))
    right = ints.select(F.col("vec_id").alias("id"), F.col("v").alias("w"), own(candidate_blocks, "c").alias("cb")).withColumn("qb", spread(query_blocks))

    def search(asking: pa.Table, offered: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if asking.num_rows and offered.num_rows:
            q, c = matrix(asking, "v"), matrix(offered, "w")
            dims = max(q.shape[1], c.shape[1])
            q, c = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (q, c))
            # the least exact type: sums stay below 2^24 or 2^53, or else are integers of any size
            far = lambda x: max(-int(x.min(initial=0)), int(x.max(initial=0)))
            most = dims * far(q) * far(c)
            q, c = (x.astype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object) for x in (q, c))
            ids = offered.column("id").to_numpy()
            lists = np.argsort(c, axis=0, kind="stable").astype(np.int32)
            for own_id, vector in zip(asking.column("vec_id").to_pylist(), q):
                found, scores, depth = walk(lists, c, ids, vector, own_id, k)
                for into, x in zip(out, (np.full(len(found), own_id), found, scores, np.full(len(found), depth))):
                    into.append(x.astype(np.int64))
        columns = [pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in out]
        return pa.table(columns, names=["query_id", "vec_id", "score", "depth"])

    ship(vectors.sparkSession)
    found = (
        left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(search, "query_id long, vec_id long, score long, depth long")
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")
