"""What several operators of this subpackage share: Arrow buffers, hashing, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is broadcast.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
BLOCK_BYTES = 1 << 20

#: The class [\x20\x09-\x0D]: what separates words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only where none is named and all runs in one process."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir()
    if named:
        return named
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="ckpt-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read again: later jobs recompute nothing.

    The table goes when the JVM ends.
    """
    spark = df.sparkSession
    place = f"{ensure_checkpoint_dir(spark).rstrip('/')}/proselake-{uuid.uuid4().hex}"
    df.write.parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; looks at no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for broadcast if it is proven to be small, in rows and by their width in bytes, else as it is (a shuffled join).

    It is counted first: pass what is written (``cut``), or its work is done twice. Rows hold no lists or texts of their own.
    """
    width = df._jdf.schema().defaultSize() + 16
    return F.broadcast(df) if is_small(df, min(rows, BROADCAST_BYTES // width)) else df


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held, at


def blocks(at: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts have at most ``most`` bytes together (or are one row)."""
    a, n = 0, len(at) - 1
    while a < n:
        b = int(np.searchsorted(at, at[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and of its inverse."""
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << max(12, int(n - 1).bit_length())

        def table(base: int) -> np.ndarray:
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            return out

        _POW, _INV = table(_BASE), table(pow(_BASE, -1, 1 << 64))
    return _POW[:n], _INV[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with n + 1 values; (C[e] - C[s]) * INV[s] is the polynomial hash of data[s:e]."""
    power, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=c[1:])
    return c


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words of the texts data[at[i]:at[i + 1]]; at[0] is 0."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    inside = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at[1:], starts, side="right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    _, inverse = powers(len(data) + 1)
    c = prefix_hash(data)
    return splitmix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles of each lower-cased text, and n + 1 offsets.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    n = len(at) - 1
    starts, ends, text = words(data, at)
    h = word_hashes(data, starts, ends)
    count = np.bincount(text, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    factor = splitmix(np.arange(11, 11 + width, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
    out = np.zeros(len(h), np.uint64)
    for k in range(min(width, len(h))):
        out[: len(h) - k] += h[k:] * factor[k]
    out = splitmix(out)
    keep = np.zeros(len(h), bool)
    whole = max(0, len(h) - width + 1)
    keep[:whole] = text[:whole] == text[width - 1 : width - 1 + whole]
    short = np.flatnonzero((count > 0) & (count < width))
    for i in short:
        a, b = first[i], first[i + 1]
        with np.errstate(over="ignore"):
            out[a] = splitmix(np.array([(h[a:b] * factor[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))[0]
        keep[a] = True
    out, text = out[keep], text[keep]
    edge = np.searchsorted(text, np.arange(n + 1))
    for i in range(n):
        out[edge[i] : edge[i + 1]].sort()
    same = np.zeros(len(out), bool)
    same[1:] = (out[1:] == out[:-1]) & (text[1:] == text[:-1])
    out, text = out[~same], text[~same]
    return out, np.searchsorted(text, np.arange(n + 1))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, offsets) of successive row blocks of a string column."""
    data, at = utf8(column)
    for a, b in blocks(at):
        yield (a, *shingles(LOWER[data[at[a] : at[b]]], at[a : b + 1] - at[a], width))


def signature(sets: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set as two int64 columns; empty sets get zeros."""
    out = []
    for salt in (0x51ED270B7F4A7C15, 0xC2B2AE3D27D4EB4F):
        c = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(splitmix(sets ^ np.uint64(salt)), out=c[1:])
        out.append(splitmix(c[edge[1:]] - c[edge[:-1]] + (edge[1:] - edge[:-1]).astype(np.uint64)).view(np.int64))
    empty = edge[1:] == edge[:-1]
    for x in out:
        x[empty] = 0
    return out[0], out[1]
