"""Near duplicates by order min-hash, with candidates verified by banded alignment.

A sketch of a text is taken from its 5-word k-mers, labelled by how often they occurred before in it:
the ``KEPT`` ones with the least hashes, in the order in which the text has them. Two texts agree on a
sketch if they share those k-mers in that order, which is the more likely the fewer edits lie between
them. Every sketch is a band; texts that agree on one share a bucket. Short texts, of which a few edits leave
hardly a k-mer, also have bands of single k-mers.

In a bucket not all pairs are looked at. First every member is compared with the bucket's most central
one, so a large group of copies becomes one class by as many comparisons as it has members. Then only
members of different classes are compared: pair by pair in small buckets; in large ones in blocks,
of which only enough links to connect the members come out. So no candidate is left out or capped.

A link is a banded alignment of the words that needs at most 1 - ``SIMILARITY`` of the longer text's
words as edits. Before it, pairs are let go that can't have one: n edits leave all but 2 n of a text's word pairs,
and all but n of its words.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import lists, small_batches, tidy
from keelson.plans.components import components, contracted, renamed
from keelson.session import discard, settle, ship

SHINGLE, SIMILARITY = 5, 0.8
#: k-mers of a sketch, sketches (each a band), and k-mers up to which a text has bands of single k-mers too.
KEPT, BANDS, SHORT = 3, 24, 40
#: Members of a bucket up to which pairs are joined; members of a block in larger ones.
SMALL, BLOCK = 12, 384
#: Pairs of members with a word pair from which on they are counted by a product of tables; pairs counted at once one by one.
DENSE, EXPANDED = 1024, 2_000_000
#: Words from which on anchors are tried before an alignment, and up to which a text is aligned by bits.
ANCHORED, BITS = 256, 20_000
#: Ids from here on are given to texts whose least doc_id is also another text's.
OWN_IDS = 1 << 62

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS) | np.uint64(1)


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of the whole text, if it is shorter."""
    w = words.astype(np.int64).view(np.uint64)
    n = max(1, len(w) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        out = mix(out * np.uint64(31) + w[j : j + n])
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """k-mers told apart by their occurrence: the first, second, ... time each stands in the text."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if first.all():
        return grams
    at = np.arange(len(grams))
    count = at - np.maximum.accumulate(np.where(first, at, 0))
    out = np.empty_like(grams)
    out[order] = np.where(first, ranked, mix(ranked + count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return out


def bands(words: np.ndarray) -> np.ndarray:
    """The text's key in each band: ``BANDS`` of sketches, and as many of single k-mers if it is short."""
    grams = labelled(shingles(words))
    n, m = len(grams), len(_SEEDS)
    keys, single = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
    step = max(1, 4_000_000 // n)
    for i in range(0, m, step):
        hashed = (grams[None] ^ _SEEDS[i : i + step, None]) * _FACTORS[i : i + step, None]
        hashed ^= hashed >> np.uint64(32)
        rows = np.arange(len(hashed))
        places = []
        for _ in range(min(KEPT, n)):
            least = hashed.argmin(1)
            places.append(least)
            hashed[rows, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
        single[i : i + step] = mix(grams[places[0]])
        for place in np.sort(np.stack(places), axis=0):  # in the order of the text
            keys[i : i + step] = mix(keys[i : i + step] * np.uint64(31) + grams[place] + np.uint64(1))
    return (np.concatenate([keys, single]) if n <= SHORT else keys).view(np.int64)


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether at most ``most`` word edits turn ``a`` into ``b``; equal words at both ends are free."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if differ.size else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    end = int(differ[0]) if differ.size else n
    a, b = a[: len(a) - end], b[: len(b) - end]
    if max(len(a), len(b)) <= most:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    if not len(a) or not len(b):
        return max(len(a), len(b)) <= most
    if min(len(a), len(b)) >= ANCHORED and anchored_edits(a, b, most) <= most:
        return True
    return _by_bits(a, b, most) if len(a) <= BITS else _row_by_row(a, b, most)


def anchored_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits of one alignment of two texts, so not fewer than needed: quick, and close where texts differ at places.

    Runs of 5 words that both have, in a band of ``most`` words, are its anchors, as many as can stand in the order of both;
    what lies between two anchors is replaced.
    """
    if min(len(a), len(b)) < SHINGLE:
        return max(len(a), len(b))
    _, x, y = np.intersect1d(labelled(shingles(a)), labelled(shingles(b)), assume_unique=True, return_indices=True)
    inside = np.abs(x - y) <= most
    order = np.argsort(x[inside], kind="stable")
    x, y = x[inside][order], y[inside][order]
    if not len(x):
        return max(len(a), len(b))
    if (np.diff(y) <= 0).any():  # the longest chain that rises in both
        ends: list[int] = []
        last, before = [], np.full(len(y), -1)
        for i, v in enumerate(y.tolist()):
            at = bisect.bisect_left(ends, v)
            before[i] = last[at - 1] if at else -1
            ends[at : at + 1], last[at : at + 1] = [v], [i]
        chain, i = [], last[-1]
        while i >= 0:
            chain.append(i)
            i = int(before[i])
        x, y = x[chain[::-1]], y[chain[::-1]]
    dx, dy = np.diff(x), np.diff(y)
    between = np.maximum(dx, dy) - np.minimum(SHINGLE, np.minimum(dx, dy))
    return int(max(x[0], y[0]) + between.sum() + max(len(a) - x[-1], len(b) - y[-1]) - SHINGLE)


def _by_bits(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Alignment by bits of whole numbers (Myers, Hyyrö): one column of differences, all of ``a``'s words, for each word of ``b``."""
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits, left = full, 0, len(a), len(b)
    for word in b.tolist():
        left -= 1
        equal = places.get(word, 0)
        level = ((((equal & up) + up) ^ up) | equal) & full
        more, less = down | (full ^ (level | up)), up & level
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
        if edits - left > most:  # the words that are left can't make up for it
            return False
        more = (more << 1 | 1) & full
        steep = equal | down
        up, down = (less << 1 & full) | (full ^ (steep | more)), more & steep
    return edits <= most


def _row_by_row(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """The same for very long texts, within a band of ``most`` words: one row of it at a time."""
    offsets = np.arange(-most, most + 1)
    row = np.where(offsets >= 0, offsets, most + 1).astype(np.int32)
    padded = np.full(len(a) + len(b) + 2 * most + 1, np.iinfo(np.int64).min)
    padded[most : most + len(b)] = b
    for i in range(1, len(a) + 1):
        other = padded[i - 1 : i + 2 * most]
        up = np.concatenate([row[1:], [most + 1]]) + 1
        row = np.minimum(row + (other != a[i - 1]), up)
        row[(offsets + i < 0) | (offsets + i > len(b))] = most + 1
        row = (np.minimum.accumulate(row - offsets) + offsets).astype(np.int32)
        if row.min() > most:
            return False
    return bool(row[len(b) - len(a) + most] <= most)


def most_edits(a: int, b: int) -> int:
    """Edits that texts of ``a`` and ``b`` words may have between them."""
    return int((1 - SIMILARITY) * max(a, b) + 1e-9)


def word_pairs(words: np.ndarray) -> np.ndarray:
    """Sorted hashes of a text's pairs of neighbouring words, told apart by their occurrence."""
    return np.sort(labelled(shingles(words, 2)))


def single_words(words: np.ndarray) -> np.ndarray:
    """The same of a text's words by themselves."""
    return np.sort(labelled(shingles(words, 1)))


def linked(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> bool:
    """Whether two texts (words, and their ``word_pairs``) are near duplicates."""
    most = most_edits(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return False
    if len(np.intersect1d(pa_, pb, assume_unique=True)) < max(len(a), len(b)) - 1 - 2 * most:
        return False
    if len(np.intersect1d(single_words(a), single_words(b), assume_unique=True)) < max(len(a), len(b)) - most:
        return False
    return edits_within(a, b, most)


def words(text: Column) -> Column:
    """Hashes of a text's words in lower case, divided by white space."""
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.transform(parts, lambda w: F.hash(w))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and keys, the text's key in each band; no keys for texts without words."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [bands(w) if len(w) else np.empty(0, np.int64) for w in lists(batch.column("w"))]
            ends = np.cumsum([0, *map(len, found)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), keys], ["doc_id", "digest", "keys"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "digest", words(F.col("text")).alias("w")).mapInArrow(tidy(run), "doc_id long, digest binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near duplicates. texts: uid and w, the hashes of its words."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            good = [linked(x, y, word_pairs(x), word_pairs(y)) for x, y in zip(lists(batch.column("wa")), lists(batch.column("wb")))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("uid").alias("a"), F.col("w").alias("wa"))
    right = texts.select(F.col("uid").alias("b"), F.col("w").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(tidy(run), "a long, b long")


def in_common(sa: list[np.ndarray], sb: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``sa`` has in common with each of ``sb``; every one holds distinct values.

    A value of many members on both sides is a column of two tables, whose product counts; of the others, mostly
    of a member or two, each pair of members is counted by itself.
    """
    sides = []
    for sets in (sa, sb):
        value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(value, kind="stable")
        sides.append((*np.unique(value[order], return_index=True, return_counts=True), owner[order]))
    (va, fa, ca, oa), (vb, fb, cb, ob) = sides
    _, x, y = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    fa, ca, fb, cb = fa[x], ca[x], fb[y], cb[y]
    common = np.zeros(len(sa) * len(sb), np.int64)
    many = ca * cb > DENSE
    ends = np.cumsum(np.where(many, 0, ca * cb))
    parts = np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, EXPANDED), "right")
    for lo, hi in zip(parts, [*parts[1:], len(ends)]):
        few = lo + np.flatnonzero(~many[lo:hi])
        n = ca[few] * cb[few]
        k = np.repeat(few, n)  # one row for each pair of members that have this value
        at = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        common += np.bincount(oa[fa[k] + at // cb[k]] * len(sb) + ob[fb[k] + at % cb[k]], minlength=len(common))
    common, dense = common.reshape(len(sa), len(sb)), np.flatnonzero(many)
    for i in range(0, len(dense), 4096):
        part = dense[i : i + 4096]
        tables = []
        for first, count, owner, size in ((fa, ca, oa, len(sa)), (fb, cb, ob, len(sb))):
            n = count[part]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            table = np.zeros((size, len(part)), np.float32)
            table[owner[np.repeat(first[part], n) + at], np.repeat(np.arange(len(part)), n)] = 1
            tables.append(table)
        common += (tables[0] @ tables[1].T).astype(np.int64)
    return common


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def block_links(asking: pa.Table, offered: pa.Table) -> pa.Table:
    """Links between two blocks of a bucket's members: enough of them to connect all that are linked.

    The word pairs that any two have in common are counted first, then their words, and only where both suffice is a
    pair aligned; those with most words in common come first, as a link spares the pairs of classes that it connects.
    """
    none = pa.table([pa.array([], pa.int64())] * 2, names=["a", "b"])
    if not asking.num_rows or not offered.num_rows:
        return none
    ia, ib = asking.column("uid").to_numpy(), offered.column("id").to_numpy()
    ca, cb = asking.column("component").to_numpy(), offered.column("group").to_numpy()
    wa, wb = lists(asking.column("w")), lists(offered.column("v"))
    sa, sb = ([word_pairs(x) for x in w] for w in (wa, wb))
    na, nb = (np.array([len(x) for x in w]) for w in (wa, wb))
    common = in_common(sa, sb)
    longer = np.maximum(na[:, None], nb[None])
    most = np.floor((1 - SIMILARITY) * longer + 1e-9)
    near = (np.abs(na[:, None] - nb[None]) <= most) & (common >= longer - 1 - 2 * most) & (ca[:, None] != cb[None])
    if near.any():
        spare = in_common(*([single_words(x) for x in w] for w in (wa, wb))) - (longer - most)
        near &= spare >= 0
    i, j = np.nonzero(near)
    if len(i):
        order = np.argsort(-spare[i, j], kind="stable")
        i, j = i[order], j[order]
    # members of a class stand for it: a link between two classes that are linked already adds nothing
    done: dict[int, int] = {}

    def root(x: int) -> int:
        while done.setdefault(x, x) != x:
            done[x] = done[done[x]]
            x = done[x]
        return x

    found = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(int(ca[x])), root(int(cb[y]))
        if p != q and edits_within(wa[x], wb[y], int(most[x, y])):
            done[p] = q
            found.append((ia[x], ib[y]))
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"]) if found else none


def _identified(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (doc_id, digest) with text_id and uid of their text.

    A text of more than a thousandth of all rows would gather them in one task of a join; there are
    fewer than a thousand of those, so they are broadcast, and the others joined by a shuffle.
    """
    ids = texts.select("digest", "text_id", "uid", "copies")
    often = settle(ids.where(F.col("copies") > max(100, rows.count() // 1000)).drop("copies"), "often")
    hot = rows.join(F.broadcast(often), "digest")
    rest = rows.join(F.broadcast(often.select("digest")), "digest", "left_anti").join(ids.drop("copies"), "digest")
    return hot.unionByName(rest)


def classes(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, text_id, digest and leads.

    ``class_id`` is the least doc_id of its near duplicates, ``text_id`` the least doc_id with exactly this
    text, and ``digest`` the MD5 of the text. ``leads`` holds for one text of each class, on the rows with its
    least doc_id; these are equal in both. Documents are near duplicates if links
    connect them. Texts are compared by their words in lower case; texts of fewer than five words
    match as a whole; texts without words, empty ones too, only equal ones; null texts match nothing and lead.
    Different texts with one doc_id are documents of their own, compared as any others; where all of a class
    share their least doc_id with another text, class_id is that of its leading one. Rows without
    doc_id have null ids, match nothing and lead. An empty table gives no rows, other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    apart = F.col("doc_id").isNull() | F.col("text").isNull()
    known = rows.where(~apart)
    # Distinct texts. Equal ones have equal keys, so any of them will do, and copies are merged before the shuffle.
    with small_batches(docs.sparkSession):
        distinct = settle(
            sketches(known).groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.first("keys").alias("keys"), F.count("*").alias("copies")), "distinct"
        )
    shared_ids = distinct.groupBy("text_id").agg(F.min("digest").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    own = F.col("_first").isNotNull() & (F.col("digest") != F.col("_first"))
    fresh = F.lit(OWN_IDS) + F.shiftrightunsigned(F.xxhash64("digest"), 3)
    texts = settle(distinct.join(shared_ids, "text_id", "left").withColumn("uid", F.when(own, fresh).otherwise(F.col("text_id"))).drop("_first"), "texts")
    discard(distinct)

    entries = texts.select("uid", F.posexplode("keys").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    # buckets of several members, and a member's centrality: with how many others it shares buckets
    buckets = settle(entries.join(shared, ["band", "key"]).select("band", "key", "uid", "n"), "buckets")
    central = buckets.groupBy("uid").agg(F.sum("n").alias("weight"))
    wanted = texts.select("uid", "text_id", F.col("digest").alias("_digest")).join(central.select("uid"), "uid", "left_semi")
    hashed = settle(
        known.join(wanted, F.col("doc_id") == F.col("text_id"))
        .where(F.col("digest") == F.col("_digest"))
        .select("uid", words(F.col("text")).alias("w"))
        .dropDuplicates(["uid"]),
        "words",
    )
    order = F.struct(F.col("weight"), -F.col("uid"))
    weighed = buckets.join(central, "uid")
    leaders = weighed.groupBy("band", "key").agg(F.max(order).alias("_lead")).select("band", "key", (-F.col("_lead.col2")).alias("leader"))
    stars = buckets.join(leaders, ["band", "key"]).where("uid <> leader")
    pairs = stars.select(F.least("uid", "leader").alias("a"), F.greatest("uid", "leader").alias("b")).distinct()
    with small_batches(docs.sparkSession):
        links = settle(verified(pairs, hashed), "links")
    groups = components(links)
    discard(links)
    placed = settle(
        buckets.join(groups, F.col("uid") == F.col("node"), "left").select("band", "key", "uid", "n", F.coalesce("component", "uid").alias("component")),
        "placed",
    )
    # the class with most of a bucket's members, and the others
    sizes = placed.groupBy("band", "key", "component").agg(F.count("*").alias("c"))
    mixed = settle(
        sizes.groupBy("band", "key")
        .agg(F.count("*").alias("classes"), F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("_most"))
        .where("classes > 1")
        .select("band", "key", "n", F.col("_most.component").alias("major"), (F.col("n") - F.col("_most.c")).alias("minors")),
        "mixed",
    )
    rest = placed.drop("n").join(mixed, ["band", "key"])
    few = rest.where(F.col("n") <= SMALL)
    other = few.select("band", "key", F.col("uid").alias("b"), F.col("component").alias("_other"))
    again = few.select("band", "key", F.col("uid").alias("a"), "component").join(other, ["band", "key"]).where("a < b AND component <> _other")
    second = verified(again.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), hashed)

    many = rest.where(F.col("n") > SMALL).withColumns({"_l": F.ceil(F.col("minors") / BLOCK), "_r": F.ceil(F.col("n") / BLOCK)})
    block = lambda n: F.pmod(F.xxhash64("uid", F.lit("block")), n).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    by = ["band", "key", "lb", "rb"]
    asking = (
        many.where("component <> major").withColumn("lb", block(F.col("_l"))).withColumn("rb", up_to(F.col("_r")))
        .join(hashed, "uid").select("band", "key", "lb", "rb", "uid", "component", "w")
    )
    offered = (
        many.withColumn("rb", block(F.col("_r"))).withColumn("lb", up_to(F.col("_l")))
        .join(hashed, "uid").select(*[F.col(c).alias(f"{c}_") for c in by], F.col("uid").alias("id"), F.col("component").alias("group"), F.col("w").alias("v"))
    )
    # a pair of blocks is little data and much work, so tasks are dealt by the number of pairs, not merged by size
    pairs_of_blocks = mixed.where(F.col("n") > SMALL).agg(F.sum(F.ceil(F.col("minors") / BLOCK) * F.ceil(F.col("n") / BLOCK))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs_of_blocks) // 8)
    asking, offered = asking.repartition(tasks, *by), offered.repartition(tasks, *[f"{c}_" for c in by])
    third = asking.groupBy(*by).cogroup(offered.groupBy(*[f"{c}_" for c in by])).applyInArrow(block_links, LINKS)
    with small_batches(docs.sparkSession):
        further = settle(second.union(third), "links")
    # between the classes found so far, however many links these have inside
    merged = components(contracted(further, groups))
    final = renamed(groups, "component", merged).union(merged.join(groups, "node", "left_anti")).withColumnRenamed("node", "_node")
    discard(buckets, placed, mixed, hashed, further)

    members = _identified(known.select("doc_id", "digest"), texts)
    members = members.join(final, F.col("uid") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "uid"))
    # only where a class has none but texts with ids of their own is its name looked up
    names = texts.where(F.col("uid") >= OWN_IDS).select(F.col("uid").alias("component"), F.col("text_id").alias("_name"))
    named = members.join(names, "component", "left").select(
        "doc_id", F.coalesce("_name", "component").alias("class_id"), "text_id", "digest",
        ((F.col("uid") == F.col("component")) & (F.col("doc_id") == F.col("text_id"))).alias("leads"),
    )
    alone = rows.where(apart).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"), "digest", F.lit(True).alias("leads"))
    return named.unionByName(alone)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class of near duplicates; rows without doc_id or text stay.

    Of rows that are equal in doc_id and text one stays, whatever their other columns.
    """
    kept = classes(docs).where(F.col("leads") & F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    kept = settle(kept.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).distinct(), "kept")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
        F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("_digest"),
    )
    known = F.col("_id").isNotNull() & F.col("_digest").isNotNull()
    one = rows.where(known).join(kept, ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"])
    return one.unionByName(rows.where(~known)).select("_row.*")
