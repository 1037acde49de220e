"""Shared helpers: Arrow batches as flat byte buffers, staged tables, hashing of words."""
from __future__ import annotations

import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.core.scratch import new_path

#: Bytes of text that a task looks at in one vectorised step.
STEP_BYTES = 2 << 20


class Stage:
    """A table written once to shared storage, read back with its lineage cut, and dropped when used up."""

    def __init__(self, df: DataFrame, name: str, codec: str = "snappy"):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        self.schema = df.schema
        df.write.option("compression", codec).parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", empty: bool = True) -> DataFrame:
    """Only (doc_id, text), so that further or clashing columns do no harm; a null text becomes empty on request."""
    text: Column = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(text, F.lit("")) if empty else text).alias("text"))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values, without a copy; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``; a longer value is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def without_gc(items: Iterator) -> Iterator:
    """Large memo tables without cycles: collecting garbage would only walk through them again and again."""
    gc.disable()
    try:
        yield from items
    finally:
        gc.enable()
        pa.default_memory_pool().release_unused()


#: glibc's mallopt: from this size on an array is mapped alone and unmapped when freed, also after larger ones were freed.
_MAP_THRESHOLD, _MAP_BYTES = -3, 1 << 20


def giving_back(items: Iterator) -> Iterator:
    """The same items; what numpy and Arrow free goes back to the system, large arrays at once, the rest at the end, as workers outlive their task."""
    libc = ctypes.CDLL(None)
    fixed, trim = getattr(libc, "mallopt", None), getattr(libc, "malloc_trim", None)
    if fixed is not None:
        fixed(_MAP_THRESHOLD, _MAP_BYTES)
    yield from items
    pa.default_memory_pool().release_unused()
    if trim is not None:
        trim(0)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, by doubling."""
    out = np.ones(n + 1, np.uint64)
    have = 1
    while have <= n:
        more = min(have, n + 1 - have)
        out[have:have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) <= n:
        got = powers(base, max(n, STEP_BYTES + 4096))
        if n > 4 * STEP_BYTES:  # an unusually long text: not kept
            return got
        _POWERS[base] = got
    return _POWERS[base]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, from running polynomial sums modulo 2**64."""
    n = len(values)
    down, up = _powers(_INVERSE, n), _powers(_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * down[:n], out=total[1:])
    return mixed((total[end] - total[start]) * up[start] ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Words of more bytes are hashed by a keyed cryptographic hash: polynomials modulo 2**64 have structural collisions
#: (Thue-Morse words and their complements), which need some hundred bytes.
LONG_WORD = 64


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts data[at[i]:at[i+1]].

    Returns the hash, first byte and byte after the end of every word in order, and for each text the index of
    its first word (one more entry at the end).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    gap = SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    heads = at[:-1][at[:-1] < at[1:]]  # a text's first byte starts a word even right behind another text
    first[heads] = ~gap[heads]
    last = ~gap
    last[:-1] &= gap[1:]
    tails = at[1:][at[:-1] < at[1:]] - 1
    last[tails] = ~gap[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = range_hash(_BYTE[data], start, end)
    for i in np.flatnonzero(end - start > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8, key=b"word").digest(), "little")
    return h, start, end, np.searchsorted(start, at)


def unique_name() -> str:
    return uuid.uuid4().hex


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
