"""Best-fit packing by exact-complement hashing.

Documents become token ids by a public tokenizer, each followed by one separator id. Only documents
longer than a sequence are cut. Pieces are packed into as few sequences as possible:

1. The corpus is reduced to a histogram: how many pieces have each length. It has at most
   ``capacity`` entries however large the corpus is, so the packing is planned on it.
2. From the longest length down, the gap it leaves is looked up among the single lengths, then the
   sums of pairs, then of triples, which are indexed; a combination that fills the gap exactly is consumed as
   often as the counts allow, and the index is made anew when a length has run out.
3. What is left is packed best-fit: each length into the sequences with the least sufficient gap.

The plan is a short list of patterns with a multiplicity. Pieces are ranked within their length by
a distributed running total, and a rank finds its pattern by a join on (length, block of ranks).
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import batches, small_batches, tidy, with_text
from keelson.plans.ranking import bits_for, hash_bucket, hash_order, running_total
from keelson.session import settle, ship

#: Tokens of a sequence, the id that ends a document, and words whose ids a task remembers.
CAPACITY, SEPARATOR, REMEMBERED_WORDS = 2048, 0, 200_000
#: Ranks of one block in the join that finds a piece's pattern.
RANK_BLOCK = 1024


#: Letters that lower case and composition leave alone or map one to one, and where a mark behind one begins.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SIMPLE, MARK = re.compile(f"[{LETTERS}]+"), rf"([{LETTERS}])([!-&(-/:-@\[-`{{-~])"
#: Texts that are left as they are: other scripts, a letter whose lower case is two, special tokens.
OTHER = "[^\x00-įı-ɏ\u2010-\u2060]|<\\|"


class WordEncoder:
    """Ids of texts as little-endian bytes, remembering the ids of each word.

    The tokenizer's first steps put text in lower case and split it at white space and between
    letters, digits and marks; no token spans such a split. So a text may be put in lower case and its
    marks set apart from the letters before them, and its ids are those of its parts at spaces and line
    ends, one after another. Parts of Latin letters alone skip the tokenizer's first steps, as there is
    nothing left to do; every other part passes through all of them. Parts are remembered up to a
    number and a length; beyond the number the memory is emptied.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._merges = Tokenizer(self._whole.model)
        self._known: dict[str, bytes] = {}
        # the letters that stand for bytes: printable ones for themselves, then the rest from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self._letters = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(rest)})

    def _learn(self, parts: list[str]) -> None:
        known = self._known
        plain = [w for w in parts if SIMPLE.fullmatch(w) and w.islower()]
        rest = list(set(parts).difference(plain))
        for part, found in zip(rest, self._whole.encode_batch(rest, add_special_tokens=False)):
            known[part] = np.asarray(found.ids, dtype="<u4").tobytes()
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            spelt = [w if w.isascii() else w.encode().decode("latin-1").translate(self._letters) for w in some]
            found = self._merges.encode(spelt, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(found.ids, dtype="<u4").tobytes()
            ends = (np.cumsum(np.bincount(np.asarray(found.word_ids), minlength=len(some))) * 4).tolist()
            known.update(zip(some, (ids[a:b] for a, b in zip([0, *ends[:-1]], ends))))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For each text the bytes of its ids, 4 for each id; a null text counts as empty."""
        if len(self._known) > REMEMBERED_WORDS:
            self._known.clear()
        spaced = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " ")
        apart = pc.replace_substring_regex(pc.utf8_lower(spaced), MARK, r"\1 \2")
        parts = pc.split_pattern(pc.if_else(pc.match_substring_regex(spaced, OTHER), spaced, apart), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self._known
        self._learn([w for w in words if w not in known])
        spelt = [known[w] for w in words]
        # the ids of all words in a row, where each begins, and so the ids of the whole texts
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt)) // 4
        ids, starts = np.frombuffer(b"".join(spelt), "<u4"), np.cumsum(sizes) - sizes
        order = coded.indices.to_numpy()
        n = sizes[order]
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts[order] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        at = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()] * 4
        for word in words:
            if len(word) > 64:
                known.pop(word, None)
        return [flat[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this process; its memory serves one task after another."""
    return WordEncoder(path)


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32.

    Null and empty texts are one piece that holds the separator alone. Repeated rows are documents
    of their own.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    )
    end = np.asarray([SEPARATOR], dtype="<u4").tobytes()

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches(stream, rows=1024, chars=1_500_000):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text"))):
                ids += end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ship(docs.sparkSession)
    return with_text(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(tidy(cut), PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns (multiplicity, lengths) that use every length as often as ``counts`` says."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    patterns: list[tuple[int, list[int]]] = []

    def use(lengths: list[int]) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        at = np.flatnonzero(need)
        times = int((left[at] // need[at]).min())
        left[at] -= times * need[at]
        patterns.append((times, lengths))

    # Which sums pairs and triples of available lengths have; lengths only run out, so what is missing stays missing.
    index: dict[str, np.ndarray] = {}

    def sums() -> tuple[np.ndarray, np.ndarray]:
        has = left > 0
        if "has" not in index or not np.array_equal(has, index["has"]):
            spectrum = np.fft.rfft(has, 4 * capacity)
            pairs, triples = (np.fft.irfft(spectrum**k)[: capacity + 1] > 0.5 for k in (2, 3))
            index.update(has=has, pairs=pairs, triples=triples)
        return index["pairs"], index["triples"]

    def single(gap: int) -> list[int] | None:
        return [gap] if left[gap] else None

    def pair(gap: int) -> list[int] | None:
        """Two lengths with this sum; the longer one as long as possible."""
        low = np.arange(1, gap // 2 + 1)
        fits = np.flatnonzero((left[low] > 0) & (left[gap - low] > 0) & ((low != gap - low) | (left[low] > 1)))
        return [gap - int(low[fits[0]]), int(low[fits[0]])] if fits.size else None

    def triple(gap: int) -> list[int] | None:
        """Three lengths with this sum: the longest one whose rest is among the sums of pairs."""
        pairs, triples = sums()
        if not triples[gap]:
            return None
        thirds = np.arange(1, gap - 1)
        for third in thirds[(left[thirds] > 0) & pairs[gap - thirds]][::-1].tolist():
            left[third] -= 1
            rest = pair(gap - third)  # the index knows nothing of counts
            left[third] += 1
            if rest:
                return [third, *rest]
        return None

    for length in range(capacity, 0, -1):
        if length == capacity and left[length]:
            use([length])
        while left[length]:
            left[length] -= 1
            found = None
            for look_up in (single, pair, triple):
                if found := look_up(capacity - length):
                    break
            left[length] += 1
            if not found:
                break
            use([length, *found])

    # Best fit for the rest: open sequences by their gap, as (multiplicity, lengths).
    open_: list[list[tuple[int, list[int]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        while left[length]:
            gap = next((g for g in range(length, capacity) if open_[g]), None)
            if gap is None:
                times, lengths, gap = int(left[length]), [], capacity
                each = capacity // length
                if times >= each > 1:  # further pieces of this length would fit there best
                    times, lengths = times // each, [length] * (each - 1)
                    gap -= length * (each - 1)
                    left[length] -= times * (each - 1)
            else:
                times, lengths = open_[gap].pop()
                if times > left[length]:
                    open_[gap].append((times - int(left[length]), lengths))
                    times = int(left[length])
            left[length] -= times
            open_[gap - length].append((times, [*lengths, length]))
    return patterns + [p for of_gap in open_ for p in of_gap]


SLOTS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("_length", "first_rank", "times", "first_sequence", "offset")]
)


def slots(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of each length go where: (length, first rank, times, first sequence, offset)."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for times, lengths in patterns:
        at = 0
        for length in lengths:
            out.append((length, ranks.get(length, 0), times, sequence, at))
            ranks[length] = ranks.get(length, 0) + times
            at += length
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; offsets
    within a sequence are gapless from 0. Nulls and empty texts take one token, equal rows are packed
    one by one, an empty table gives no rows, and further columns are ignored.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        cut = settle(pieces(docs, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.createDataFrame(slots(plan(counts, capacity)), SLOTS)
    bits = bits_for(sum(counts.values()))
    ordered = cut.withColumn("_order", hash_order(F.lit("pack"), "doc_id", "piece", "ids_crc32"))
    ranked = running_total(
        ordered.withColumn("_bucket", hash_bucket(F.col("_order"), bits)),
        ["length"], "_bucket", ["_order", "doc_id", "piece", "ids_crc32"], F.lit(1), "_rank",
    )
    blocks = places.withColumn(
        "_block",
        F.explode(F.sequence(F.expr(f"first_rank div {RANK_BLOCK}"), F.expr(f"(first_rank + times - 1) div {RANK_BLOCK}"))),
    )
    found = ranked.join(
        blocks,
        (F.col("length") == F.col("_length"))
        & (F.expr(f"_rank div {RANK_BLOCK}") == F.col("_block"))
        & (F.col("_rank") >= F.col("first_rank"))
        & (F.col("_rank") < F.col("first_rank") + F.col("times")),
    )
    return found.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("first_sequence") + F.col("_rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
