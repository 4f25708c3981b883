"""Importance resampling towards a target distribution.

A pre-tokenizer of the tokenizers library (a Split by a regular expression,
which nothing trains) cuts the ASCII-lowered text into words with their
offsets.  Windows over one to three consecutive offset pairs are the features;
each one's bucket is the crc32 of its words, joined by one space.  Bucket
histograms of the corpus and of the target give a gain by bucket, a text's
weight is the sum of its features' gains, and weight plus Gumbel noise, fixed
by the id, ranks the texts: the first are a sample without replacement.

The crc32 of a window is put together from those of its words: one of a
joined string is that of its left part, taken through as many zero bytes as
the right part has, and the right part's own.

Scale: texts are cut once and never shuffled.  The buckets of their features,
two bytes each, are staged, and read for the histogram and for the weights.  A
task holds a batch of texts, or a long one by blocks, and 14 bytes a word of it.
The order is that of a range-partitioned table whose parts are counted, so no
task and no driver ever ranks all texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm.common import Memo, read, slices, small_batches, stage

BUCKETS = 10_000
LONGEST = 3             # words of a feature
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_BLOCK = 1 << 20        # characters that are pre-tokenised at once
_SLICE = 1 << 18        # words whose windows are formed at once
_TABLED = 64            # zero bytes, up to which there is a table for each number


# -------------------------------------------------------------------- crc32

def _after_zeros(crc: np.ndarray, table: np.ndarray, at=0) -> np.ndarray:
    """What a table makes of crc32s: the change is linear, so it is the xor of
    what it makes of their bytes."""
    out = table[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out ^= table[at + (256 * k) + (crc >> np.uint32(8 * k) & np.uint32(255))]
    return out


def _zeros() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables, by place and value of a byte, of the change of a crc32 by 0 to
    ``_TABLED`` zero bytes, and by further powers of two of them."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    out = np.empty((_TABLED + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _TABLED + 1):
        out[n] = (out[n - 1] >> 8) ^ byte[out[n - 1] & 0xFF]
    powers = [out[_TABLED].ravel()]
    for _ in range(31):
        powers.append(_after_zeros(powers[-1], powers[-1]))
    return out.ravel(), powers


_ZEROS, _POWERS = _zeros()


def append(left: np.ndarray, length: np.ndarray, right: np.ndarray) -> np.ndarray:
    """crc32 of joined strings, of the crc32 of the left ones, and the lengths
    and the crc32 of the right ones."""
    short = length % _TABLED
    long = np.flatnonzero(length >= _TABLED)
    if len(long):
        left, times = left.copy(), length // _TABLED
        for k, table in enumerate(_POWERS):
            at = long[times[long] >> k & 1 == 1]
            left[at] = _after_zeros(left[at], table)
    return _after_zeros(left, _ZEROS, short << 10) ^ right


_SPACE = np.uint32(zlib.crc32(b" "))


# ----------------------------------------------------------------- features

class Words:
    """The words of texts: their crc32 and lengths, and their offsets."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers
        self.split = pre_tokenizers.Split(Regex(_WORDS), "removed", invert=True)
        self.known = Memo(self._one, 500_000)

    @staticmethod
    def _one(word: str) -> int:
        b = word.encode()
        return len(b) << 32 | zlib.crc32(b)

    def cut(self, text: str) -> Iterator[tuple[int, list[tuple[str, tuple[int, int]]]]]:
        """Blocks that end between words: where they begin in the text, and their
        words with offsets (start, end) in the block, in characters."""
        text, at = text.encode().lower().decode(), 0
        while at < len(text):
            end = at + _BLOCK
            if end < len(text):
                gap = _GAP.search(text, end)
                end = gap.start() if gap else len(text)
            yield at, self.split.pre_tokenize_str(text[at:end] if at or end < len(text) else text)
            at = end

    def codes(self, text: str) -> np.ndarray:
        """Length and crc32 of every word, in one number."""
        look = self.known.__getitem__
        parts = [np.fromiter([look(w) for w, _ in block], np.int64, len(block)) for _, block in self.cut(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.int64), *parts])

    def offsets(self, text: str) -> np.ndarray:
        """The offset pairs of the words."""
        pairs = [np.array([o for _, o in block], np.int64).reshape(-1, 2) + at for at, block in self.cut(text)]
        return np.concatenate([np.zeros((0, 2), np.int64), *pairs])


def windows(offsets: np.ndarray) -> np.ndarray:
    """Offset pairs of all features of a text, by its words' offset pairs: from
    the start of their first word to the end of their last one."""
    n = len(offsets)
    ends = np.arange(n)[:, None] + np.arange(LONGEST)
    start, end = np.nonzero(ends < n)
    return np.stack([offsets[start, 0], offsets[start + end, 1]], axis=1)


def buckets(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of texts, those of one, two and three words by
    their first word, and where each text's begin.  ``codes`` has the texts'
    words one after the other, ``first`` where each text's begin."""
    words = np.diff(first)
    sizes = sum(np.maximum(words - k, 0) for k in range(LONGEST))
    out = []
    # words behind a word in its text
    behind = np.repeat(first[1:], words) - np.arange(len(codes)) - 1
    for lo in range(0, len(codes), _SLICE):
        part = codes[lo:lo + _SLICE + LONGEST - 1]
        n = min(_SLICE, len(codes) - lo)
        crc, length = part.astype(np.uint32), part >> 32
        spaced = append(np.full(len(part), _SPACE), length, crc)
        got = np.zeros((n, LONGEST), np.uint16)
        whole = behind[lo:lo + n, None] >= np.arange(LONGEST)
        for k in range(LONGEST):
            if k:
                crc = append(crc[:-1], length[k:] + 1, spaced[k:])
            got[:len(crc[:n]), k] = crc[:n] % np.uint32(BUCKETS)
        out.append(got[whole])
    return np.concatenate([np.zeros(0, np.uint16), *out]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


_TOOL: list[Words] = []


def _tool() -> Words:
    if not _TOOL:
        _TOOL.append(Words())
    return _TOOL[0]


def _cut(batches):
    for b in batches:
        tool = _tool()
        for lo, hi in slices(b.column(1), 8 << 20):
            codes = [tool.codes(t) for t in b.column(1).slice(lo, hi - lo).to_pylist()]
            n_words = np.array([len(c) for c in codes], np.int64)
            flat, at = buckets(np.concatenate(codes), np.concatenate([[0], np.cumsum(n_words)]))
            packed = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(2 * at), pa.py_buffer(flat.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n_words), packed.cast(pa.binary())],
                                             names=["doc_id", "n_words", "buckets"])


def feature_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, buckets (of all features, two bytes each) of every text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, buckets binary")


def _spans(batches):
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            codes = _tool().codes(text)
            bucket, _ = buckets(codes, np.array([0, len(codes)]))
            pairs = windows(_tool().offsets(text))
            yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(bucket), b.column(0).type), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                                              pa.array(bucket.astype(np.int64))], names=["doc_id", "start", "end", "bucket"])


def feature_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (characters of the text), bucket: one row a feature,
    to see what a weight is made of."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_spans, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, end long, bucket long")


def _count(batches):
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for one in b.column(0):
            total += np.bincount(np.frombuffer(one.as_buffer(), "<u2"), minlength=BUCKETS)
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total)], names=["bucket", "n"])


def histogram(features: DataFrame) -> np.ndarray:
    """Features (of ``feature_buckets``) by bucket."""
    got = features.select("buckets").mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in got:       # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and corpus by bucket."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + BUCKETS) / ((float(s) + 1) * (t_all + BUCKETS))))
                     for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def _weigh(gain: np.ndarray):
    def run(batches):
        for b in batches:
            got = [np.frombuffer(one.as_buffer(), "<u2") for one in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in got], pa.int64()),
                                              pa.array([int(gain[x].sum()) for x in got], pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])
    return run


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every text."""
    rows = features.select("doc_id", "n_words", "buckets")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_weigh(gain), f"doc_id {kind}, n_words long, n_features long, weight long")


# ----------------------------------------------------------------- sampling

def gumbel(doc_id, seed: int = SEED):
    """Thousandths of Gumbel noise, fixed by seed and id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with rank (from 1) in ``order``: sorted into ranges, whose
    sizes give the first rank of each."""
    placed = stage(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.call_function("shiftright", F.col("place"), F.lit(33))
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(first, part == F.col("part")).withColumn("rank", F.col("first") + place + 1).drop("part", "first", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every text; rank is
    null but for the ``percent`` of the texts of ``least_words`` or more that
    are drawn.  ``target`` has the texts to resemble in its column text.

    Defined cases: null or empty texts have no features, weight 0, and are
    not drawn; a null id has the noise of the empty one and comes before
    others of its score; repeated rows are drawn each on its own; without a
    target all gains fall with the corpus counts; an empty table gives no
    rows; other columns are not read.
    """
    features = stage(feature_buckets(docs, id_col, text_col), "features")
    gain = gains(histogram(features), histogram(feature_buckets(target.withColumn("doc_id", F.lit(0)))))
    rows = weights(features, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    rows = stage(rows, "weights")
    enough = rows.filter(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = ranked(enough, F.desc("score"), F.asc_nulls_first("doc_id"))
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return order.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")
