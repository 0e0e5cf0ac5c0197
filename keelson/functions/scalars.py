"""Scalar functions of the data paths, as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def base64url(x: Column) -> Column:
    """URL-safe Base64 of bytes, without the line ends that ``base64`` puts in."""
    return F.translate(F.base64(x), "+/\r\n", "-_")


def unbase64url(x: Column) -> Column:
    """Bytes of URL-safe Base64."""
    return F.unbase64(F.translate(x, "-_", "+/"))


def path_parts(path: Column) -> Column:
    """Decoded parts of a path; empty ones, as between repeated slashes, are dropped."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.url_decode(x))


def parent_path(path: Column) -> Column:
    """The path up to its last part, without the slash; empty for a single part."""
    return F.regexp_extract(F.rtrim(path, F.lit("/")), "^(.*)/[^/]*$", 1)


def last_part(path: Column) -> Column:
    """The last part of a path, a slash at its end aside."""
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def wrap64(total: Column) -> Column:
    """A decimal(38,0) folded into 64-bit two's complement; sums of up to 2^60 terms wrap exactly."""
    span, half = F.lit("18446744073709551616").cast("decimal(38,0)"), F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(total.cast("decimal(38,0)") + half, span) - half).cast("long")


def parse_long(text: Column) -> Column:
    """Decimal text with an optional minus sign; empty text is 0, other text null, overflow wraps."""
    ok = text.rlike("^-?[0-9]*$")
    value = F.when(text.isin("", "-"), F.lit(0).cast("decimal(38,0)")).otherwise(text.try_cast("decimal(38,0)"))
    return F.when(ok, wrap64(value))


def big_endian(x: Column) -> Column:
    """The 8 bytes of a long, most significant first."""
    return F.unhex(F.lpad(F.hex(x), 16, "0"))


def from_big_endian(x: Column) -> Column:
    """The long in 8 bytes, most significant first."""
    return F.conv(F.hex(x), 16, -10).cast("long")


def md5_version(value: Column) -> Column:
    """A value's version: the first 8 bytes of its MD5, least significant first, as a long."""
    first = F.reverse(F.regexp_extract_all(F.substring(F.md5(value), 1, 16), F.lit("(..)"), F.lit(1)))
    return F.conv(F.array_join(first, ""), 16, -10).cast("long")


def uuid3(value: Column) -> Column:
    """Name-based UUID (version 3) of bytes."""
    h = F.md5(value)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("3"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def http_date(ts: Column) -> Column:
    """A UTC time in the form of an HTTP date."""
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


def ceil_div(x: Column, n: int) -> Column:
    """How many blocks of ``n`` hold ``x``."""
    return F.floor((x.cast("long") + F.lit(n - 1)) / F.lit(n)).cast("long")


def _crc32c_table() -> np.ndarray:
    """The 256 entries of the reflected Castagnoli polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_CRC32C = _crc32c_table()


#: Bytes of the blocks that a value is cut into.
CRC_BLOCK = 256


def _advance(crc: np.ndarray, zeros: int) -> np.ndarray:
    """States after so many zero bytes."""
    for _ in range(zeros):
        crc = _CRC32C[crc & 0xFF] ^ (crc >> 8)
    return crc


#: For each byte of a checksum what it becomes when a block follows; a checksum's four parts are combined by XOR.
_BEFORE_BLOCK = [_advance((np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32), CRC_BLOCK) for k in range(4)]


def crc32c_bytes(values: list[bytes]) -> np.ndarray:
    """CRC-32C of each value. Values are cut into blocks, the first one short, and all blocks advance together
    by a byte at a time; a value's checksum is then put together from its blocks'."""
    if not values:
        return np.zeros(0, np.uint32)
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.frombuffer(b"".join(values), np.uint8)
    starts = np.cumsum(sizes) - sizes
    blocks = np.maximum(1, -(-sizes // CRC_BLOCK))
    first = np.cumsum(blocks) - blocks
    at = np.arange(blocks.sum()) - np.repeat(first, blocks)  # a block's place in its value
    short = sizes - (blocks - 1) * CRC_BLOCK
    begin = np.repeat(starts, blocks) + np.where(at > 0, np.repeat(short, blocks) + (at - 1) * CRC_BLOCK, 0)
    length = np.where(at > 0, CRC_BLOCK, np.repeat(short, blocks))
    order = np.argsort(-length, kind="stable")
    begin, crc = begin[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-length[order], -np.arange(CRC_BLOCK), side="left")
    for i, n in enumerate(live):
        if not n:
            break
        crc[:n] = _CRC32C[(crc[:n] ^ flat[begin[:n] + i]) & 0xFF] ^ (crc[:n] >> 8)
    of_block = np.empty_like(crc)
    of_block[order] = crc ^ np.uint32(0xFFFFFFFF)
    out, longest = of_block[first].copy(), np.argsort(-blocks, kind="stable")
    for i in range(1, int(blocks.max())):
        rows = longest[: np.searchsorted(-blocks[longest], -i, side="left")]
        c = out[rows]
        moved = _BEFORE_BLOCK[0][c & 0xFF] ^ _BEFORE_BLOCK[1][c >> 8 & 0xFF] ^ _BEFORE_BLOCK[2][c >> 16 & 0xFF] ^ _BEFORE_BLOCK[3][c >> 24]
        out[rows] = moved ^ of_block[first[rows] + i]
    return out


@F.pandas_udf(T.LongType())
def crc32c(values: pd.Series) -> pd.Series:
    """CRC-32C of bytes; Spark's own ``crc32`` is another polynomial."""
    found = crc32c_bytes([v if v is not None else b"" for v in values]).astype(np.int64)
    return pd.Series(found).where(values.notna().to_numpy())


def murmur3_bytes(values: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 (x86, 32 bits) of each value, as unsigned; all values advance together by four bytes at a time."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.frombuffer(b"".join(values) + bytes(4), np.uint8)
    starts = np.cumsum(sizes) - sizes
    h = np.full(len(values), seed, np.uint32)
    u = np.uint32
    turn = lambda x, n: x << u(n) | x >> u(32 - n)
    scramble = lambda k: turn(k * u(0xCC9E2D51), 15) * u(0x1B873593)
    order = np.argsort(-sizes, kind="stable")
    word = lambda at: sum(flat[at + j].astype(np.uint32) << u(8 * j) for j in range(4))
    for i in range(int(sizes.max(initial=0)) // 4):
        rows = order[: np.searchsorted(-sizes[order], -(4 * i + 4), side="right")]
        h[rows] = turn(h[rows] ^ scramble(word(starts[rows] + 4 * i)), 13) * u(5) + u(0xE6546B64)
    rest = sizes % 4
    rows = np.flatnonzero(rest)
    tail = np.zeros(len(rows), np.uint32)
    for j in range(3):
        some = rest[rows] > j
        tail[some] |= flat[(starts + sizes - rest)[rows][some] + j].astype(np.uint32) << u(8 * j)
    h[rows] ^= scramble(tail)
    h ^= sizes.astype(np.uint32)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> u(shift)) * u(factor)
    return h


@F.pandas_udf(T.LongType())
def murmur3(values: pd.Series) -> pd.Series:
    """MurmurHash3 with seed 0; Spark's own ``hash`` differs in seed and tail."""
    found = murmur3_bytes([v if v is not None else b"" for v in values]).astype(np.int64)
    return pd.Series(found).where(values.notna().to_numpy())


def json_type(value: Column) -> Column:
    """null, boolean, integer, double, string or nested for JSON text of one value."""
    return (
        F.when(value.isNull() | (value == "null"), "null")
        .when(value.isin("true", "false"), "boolean")
        .when(value.rlike("^-?[0-9]+$"), "integer")
        .when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"), "double")
        .when(value.rlike(r"^[\[{]"), "nested")
        .otherwise("string")
    )


def xml_element(name: str, text: Column) -> Column:
    """An XML element with escaped text."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))
