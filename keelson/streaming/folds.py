"""Streams of commands applied to keyed state, and the queue as a stateful operator."""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keelson.operators.queue import VISIBILITY_MILLIS


def apply_batches(folder: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: state is a snapshot for each batch id, so replaying one changes nothing.

    ``merge(state, batch)`` gives the next state; the state before batch n is the snapshot of the
    greatest id below n, whatever later ones there are.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = None
        if batch_id > 0:
            earlier = spark.read.parquet(folder).where(F.col("batch") < batch_id)
            last = earlier.agg(F.max("batch").alias("batch"))
            state = earlier.join(F.broadcast(last), "batch").drop("batch")
        merge(state, batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return run


def merge_counters(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State (key, value) with increments (key, delta) of a batch."""
    new = batch.groupBy("key").agg(F.sum("delta").alias("value"))
    both = new if state is None else state.select("key", "value").unionByName(new)
    return both.groupBy("key").agg(F.sum("value").alias("value"))


def merge_last_write(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State (key, seq, value) with the writes of a batch; the greatest seq of a key stands."""
    both = batch.select("key", "seq", "value")
    both = both if state is None else state.select("key", "seq", "value").unionByName(both)
    return both.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"))


#: Parts of a queue's state; messages are dealt over them by a hash of their id.
PARTS = 4096


class QueueProcessor(StatefulProcessor):
    """A queue by key: SEND keeps a message, RECEIVE hands out up to n visible ones, DELETE takes a receipt.

    The state is read and written by parts, one for each run of SENDs or DELETEs and part that they touch, as a call for
    each message takes longer than all else.

    Commands (queue, seq, op, message_id, body, n, now) carry their own time, so results don't depend on
    the clock. Rows out: what RECEIVE delivers, with receipts.
    """

    OUTPUT = "queue string, seq long, message_id string, body string, version long, receipt string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = T.StructType([T.StructField("part", T.IntegerType())])
        value = T.StructType([T.StructField("messages", T.BinaryType())])
        self._parts = handle.getMapState("parts", key, value)

    def _load(self, part: int) -> dict[str, tuple[str, int, int]]:
        """Body, invisible-until and version of a part's messages."""
        found = self._parts.getValue((part,))
        return pickle.loads(found[0]) if found else {}

    def _store(self, part: int, messages: dict[str, tuple[str, int, int]]) -> None:
        if messages:
            self._parts.updateValue((part,), (pickle.dumps(messages),))
        elif self._parts.containsKey((part,)):
            self._parts.removeKey((part,))

    def _change(self, ids: list[str], change: Callable[[dict[str, tuple[str, int, int]], int], None]) -> None:
        """``change(messages, i)`` for the i-th of ``ids``, in this order for each message; a part is loaded and stored once."""
        parts = np.fromiter((zlib.crc32((i or "").encode()) % PARTS for i in ids), np.int64, len(ids))
        order = np.argsort(parts, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(parts[order])) + 1):
            messages = self._load(int(parts[rows[0]]))
            for i in rows.tolist():
                change(messages, i)
            self._store(int(parts[rows[0]]), messages)

    def _visible(self, now: int) -> Iterator[tuple[int, str, tuple[str, int, int]]]:
        for (part,) in list(self._parts.keys()):
            yield from ((v[1], i, v) for i, v in self._load(part).items() if v[1] < now)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        commands = pd.concat([r[["seq", "op", "message_id", "body", "n", "now"]] for r in rows]).sort_values("seq", kind="stable")
        run = (commands["op"] != commands["op"].shift()) | (commands["op"] == "RECEIVE")
        for _, some in commands.groupby(run.cumsum().to_numpy(), sort=True):
            op, ids = some["op"].iloc[0], some["message_id"].tolist()
            if op == "SEND":
                bodies, nows = some["body"].tolist(), some["now"].tolist()
                self._change(ids, lambda messages, i: messages.setdefault(ids[i], (bodies[i], int(nows[i]), 1)))
            elif op == "RECEIVE":
                seq, n, now = (int(some[c].iloc[0]) for c in ("seq", "n", "now"))
                taken = [(i, (v[0], now + VISIBILITY_MILLIS, int(v[2]) + 1)) for _, i, v in heapq.nsmallest(n, self._visible(now), key=lambda x: x[:2])]
                if taken:
                    self._change([i for i, _ in taken], lambda messages, k: messages.__setitem__(*taken[k]))
                out += [(key[0], seq, i, body, version, f"{i}:{version}") for i, (body, _, version) in taken]
            elif op == "DELETE":
                receipts = [r.rpartition(":") for r in ids]

                def delete(messages, k):
                    i, _, version = receipts[k]
                    if i in messages and str(messages[i][2]) == version:
                        del messages[i]

                self._change([r[0] for r in receipts], delete)
        yield pd.DataFrame(out, columns=["queue", "seq", "message_id", "body", "version", "receipt"])

    def close(self) -> None:
        pass


def queue_stream(commands: DataFrame) -> DataFrame:
    """Deliveries of a stream of queue commands; needs the RocksDB state store provider."""
    return commands.groupBy("queue").transformWithStateInPandas(
        statefulProcessor=QueueProcessor(), outputStructType=QueueProcessor.OUTPUT, outputMode="Append", timeMode="None"
    )


def windowed_counts(events: DataFrame, width: str, lateness: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type; events later than ``lateness`` are left out of a stream."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", lateness) if events.isStreaming else at
    grouped = at.groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Sessions of a user: events no further apart than ``gap``."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = at.withWatermark("ts", lateness) if events.isStreaming else at
    grouped = at.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
