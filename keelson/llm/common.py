"""Small helpers shared by the operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.session import ship

#: Rows of a table whose key's remainder is this are never learned from.
FOLDS, HELD_OUT_FOLD = 5, 0


def held_out(doc_id: Column | str) -> Column:
    """True for documents that no model may learn labels from: crc32(doc_id as text) mod 5 is 0.

    A null doc_id counts as the empty text, whose remainder is 0, so such rows are held out.
    """
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS == HELD_OUT_FOLD


def bounded_sample(df: DataFrame, key: Column, bound: int, rows: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows, chosen by a hash of ``key``; all, if they are fewer.

    The expected size is ``bound`` whatever the size of ``df``, and the same rows come each time.
    """
    if rows <= bound:
        return df
    share = int(bound / rows * (1 << 30))
    return df.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 34) < share)


def bounded_texts(df: DataFrame, key: str, rows: int, bytes_: int) -> DataFrame:
    """Rows of ``df`` (``key``, text, ...), at most about ``rows`` of them with ``bytes_`` bytes of text; all, if they are fewer.

    Rows are chosen by a hash of key and text, so neither a repeated key nor long texts exceed the bound. Equal
    rows stand or fall together and are counted once.
    """
    one = df.dropDuplicates([key, "text"])
    n, size = one.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(rows / max(n, 1), bytes_ / max(size or 0, 1))
    if share >= 1:
        return one
    place = F.shiftrightunsigned(F.xxhash64(F.lit("row"), key, "text"), 34)
    return df.where(place < int(share * (1 << 30))).dropDuplicates([key, "text"])


def free_memory() -> None:
    """Gives what this process no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What runs inside passes texts to Python few at a time: Spark's batches of 10,000 are held whole on both sides, with their buffers twice as large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, freeing its memory at the end: a Python process serves one task after another, of other operators too."""

    def tidied(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(stream)
        free_memory()

    return tidied


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded table, worked out by one task; only the result comes to the driver."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(stream)
        if found:
            model = pickle.dumps(fit(pa.Table.from_batches(found)))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    ship(rows.sparkSession)
    got = rows.repartition(1).mapInArrow(tidy(run), "model binary").collect()
    if got:
        return pickle.loads(got[0]["model"])
    empty = pa.table({name: pa.array([], kind) for name, kind in ((f.name, _arrow(f.dataType)) for f in rows.schema.fields)})
    return fit(empty)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32()}.get(kind.simpleString(), pa.string())


def lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[x:y] for x, y in zip(at[:-1], at[1:])]


def batches(
    stream: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 2_000_000
) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches (column ``text``) so that a piece holds few rows and few characters.

    One row larger than ``chars`` stays a piece of its own: memory is bounded by the longest text.
    """
    for batch in stream:
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start >= rows or held + (size or 0) > chars):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def with_text(df: DataFrame, *others: str) -> DataFrame:
    """``others`` and ``text`` alone, so that further columns of any name never interfere."""
    return df.select(*others, F.col("text").cast("string").alias("text"))
