"""Helpers that the operators of this subpackage share: reading tables, staging
intermediate tables in the shared folder, and vectorised word hashing.

Text semantics: a word is a maximal run of code points other than
``\\x20 \\x09-\\x0D``.  All separators are ASCII, so words of the UTF-8 bytes
are the words of the text.  Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.session import stage_parquet

# the separators as a Java regular-expression class and as characters
WORD_SEP = r"[ \t\n\x0B\f\r]"
WORD_SEP_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors, and lets AQE split hot keys of later
    joins (both sides are then plain scans)."""
    return stage_parquet(df, f"llm-{name}")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that texts and tiles travel in."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def id_remainder(doc_id, divisor: int):
    """crc32 of the id's decimal text modulo ``divisor`` (null id: null)."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % divisor


# ---------------------------------------------------------------- hashing

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEP = np.zeros(256, dtype=bool)
SEP[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream64(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words: splitmix64 started at ``seed``."""
    return mix64(_U(seed) + np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


_BYTE = stream64(11, 256)
_BYTE_LOWER = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = {"n": 0}


def _power_tables(n: int):
    if _POW["n"] < n:
        n = max(n, _BLOCK + 4096)
        _POW.update(n=n, up=_powers(_BASE, n), down=_powers(_INVERSE, n))
    return _POW["up"], _POW["down"]


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the byte offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and for every row its first word
    (with one entry more than rows)."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(at), np.int64)
    sep = SEP[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = edge[:n].copy()
    before[1:] |= sep[:-1]
    after = edge[1:]
    after[:-1] |= sep[1:]
    starts = np.flatnonzero(before & ~sep)
    ends = np.flatnonzero(after & ~sep) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial; the
    bytes A-Z count as a-z if ``lower``.  Works through the bytes in blocks."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(hi - lo)
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(table[buf[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string column, and each row's first word."""
    buf, at = text_buffer(col)
    starts, ends, first = word_spans(buf, at)
    return hash_spans(buf, starts, ends, lower), first


def slices(col: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most ``max_bytes`` (one row at least)."""
    lengths = np.diff(text_buffer(col)[1])
    lo, size = 0, 0
    for i, k in enumerate(lengths):
        if i > lo and size + k > max_bytes:
            yield lo, i
            lo, size = i, 0
        size += int(k)
    if lo < len(lengths):
        yield lo, len(lengths)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and row lengths."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


class Memo(dict):
    """A bounded cache of a pure function for one worker process: two
    generations of at most ``size`` entries; what is still used moves on."""

    def __init__(self, compute, size: int = 250_000):
        super().__init__()
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        v = self.old.get(key)
        return self.put(key, self.compute(key) if v is None else v)

    def put(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
