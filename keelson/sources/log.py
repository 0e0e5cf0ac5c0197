"""Append-only logs: framing, byte offsets, and a data source for batch and streaming reads.

A frame is a header of 16 bytes (big-endian: magic, length, CRC-32C of the payload, zero) and the
payload; a log's positions are byte offsets, and the next position is 16 + length further.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.window import Window

from keelson.functions.scalars import crc32c, crc32c_bytes

HEADER, MAGIC = 16, 0x6B65656C


#: Frames, and bytes of them, whose checksums are worked out together.
TOGETHER, TOGETHER_BYTES = 1024, 4_000_000


def frames(payloads: list[bytes]) -> list[bytes]:
    """The frame of each payload."""
    return [struct.pack(">IIII", MAGIC, len(p), int(crc), 0) + p for p, crc in zip(payloads, crc32c_bytes(payloads))]


def frame(payload: bytes) -> bytes:
    return frames([payload])[0]


def _claimed(data: bytes, offset: int, limit: int | None) -> Iterator[tuple[int, bytes, int]]:
    """(offset, payload, checksum) as headers claim them, up to the first that can't be; checksums are not looked at."""
    n = 0
    while offset + HEADER <= len(data) and (limit is None or n < limit):
        magic, length, crc, _ = struct.unpack_from(">IIII", data, offset)
        payload = data[offset + HEADER : offset + HEADER + length]
        if magic != MAGIC or len(payload) < length:
            return
        yield offset, payload, crc
        offset, n = offset + HEADER + length, n + 1


def decode(data: bytes, offset: int = 0, limit: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the frames from ``offset`` on, up to the first invalid one."""
    some: list[tuple[int, bytes, int]] = []
    size, more = 0, _claimed(data, offset, limit)
    while True:
        found = next(more, None)
        if found:
            some.append(found)
            size += len(found[1])
        if some and (not found or len(some) == TOGETHER or size >= TOGETHER_BYTES):
            for (at, payload, claimed), crc in zip(some, crc32c_bytes([p for _, p, _ in some])):
                if claimed != int(crc):
                    return
                yield at, payload
            some, size = [], 0
        if not found:
            return


def decode_each(logs: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """What ``decode`` finds in each of many short logs; their checksums are worked out together."""
    claimed = [list(_claimed(data, 0, None)) for data in logs]
    right = iter(crc32c_bytes([p for log in claimed for _, p, _ in log]).tolist())
    out = []
    for log in claimed:
        good = [crc == next(right) for _, _, crc in log]
        n = good.index(False) if False in good else len(good)
        out.append([(at, payload) for at, payload, _ in log[:n]])
    return out


def positions(messages: DataFrame, log: str, order: list[str], payload: str) -> DataFrame:
    """Messages with offset, length, crc32c and next_offset as they would stand in their logs."""
    length = F.octet_length(payload)
    before = Window.partitionBy(log).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = messages.withColumns({"length": length, "offset": F.coalesce(F.sum(length + HEADER).over(before), F.lit(0)).cast("long")})
    return out.withColumns({"next_offset": F.col("offset") + HEADER + F.col("length"), "crc32c": crc32c(F.col(payload).cast("binary"))})


def read(frames: DataFrame, log: object, offset: int, most: int | None = None) -> DataFrame:
    """Frames of a log from a position on, in order, at most ``most``."""
    out = frames.where((F.col("log") == F.lit(log)) & (F.col("offset") >= offset)).orderBy("offset")
    return out if most is None else out.limit(most)


def segment_of(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (log, offset) the segment that holds it: the one with the greatest start not beyond it.

    Both are sorted together, and the last start so far is carried along; no pairs are formed.
    """
    line = Window.partitionBy("log").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = segments.select("log", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("start").alias("segment")).unionByName(
        wanted.select("log", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("segment"))
    )
    found = both.withColumn("segment", F.last("segment", ignorenulls=True).over(line)).where("kind = 1")
    return found.select("log", F.col("at").alias("offset"), "segment")


class _Files(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Files(p) for p in self.options["path"].split(",")]

    def read(self, partition: _Files) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        for offset, payload in decode(data):
            yield partition.path, offset, len(payload), bytearray(payload)


class _StreamReader(SimpleDataSourceStreamReader):
    """One log file that grows; a stream's offset is the next byte position."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most = int(options.get("maxframes", "10000"))

    def initialOffset(self) -> dict:
        return {"position": 0}

    def _rows(self, start: int, most: int | None = None) -> tuple[list[tuple], int]:
        with open(self.path, "rb") as f:
            f.seek(start)
            data = f.read()
        rows, end = [], start
        for at, payload in decode(data, 0, most):
            rows.append((self.path, start + at, len(payload), bytearray(payload)))
            end = start + at + HEADER + len(payload)
        return rows, end

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._rows(start["position"], self.most)
        return iter(rows), {"position": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows, _ = self._rows(start["position"])
        return iter([r for r in rows if r[1] < end["position"]])

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    """``spark.read.format("framed_log")`` and ``readStream``: log, offset, length, value."""

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return "log string, offset long, length int, value binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options)
