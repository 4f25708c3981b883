"""Packing of token sequences: bounded-space online packing.

Every partition keeps a fixed number of open windows.  A document's ids first
fill whole sequences of their own; what is left goes to the open window that it
fills best.  If it fits none and no window may be opened, the fullest is topped
up with the head of the document, emitted, and the rest goes on.  At the end a
partition joins its open windows to full sequences and hands on less than one
sequence.  These leftovers are merged over groups of partitions, level by
level, until one is left for the whole table; it is cut at powers of two.  So
no sequence carries padding, however many partitions there are.

Scale: nothing but the leftovers (under one sequence a partition) is shuffled;
a task holds its open windows and one document.  The first pass is staged, so
ids of sequences do not change when an executor is lost later.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import Memo, read, small_batches, stage
from codelake.llm.tokens import tokenizer_path

WINDOW = 4096
OPEN_WINDOWS = 16     # per partition
MERGE_GROUP = 64      # partitions whose leftovers one task merges
END_ID = 2            # closes every document
VOCABULARY = "word_bpe_49k.json"
_CACHED_WORD = 64
_MARKS = "!#$%&*+,-./:;=?@|"  # not of special tokens, nor of "'s" and the like
_MOST_MARKS = 4       # with more, a word is encoded whole


class WordIds:
    """Ids of texts for a vocabulary that drops white space: no id spans two
    words, so each word is encoded once by the library and remembered, as
    little-endian 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = Memo(self._one, 500_000)

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words; new ones are encoded together."""
        known = self.words
        found = list(map(known.get, words))
        new = [w for w, v in zip(words, found, strict=True) if v is None and len(w) <= _CACHED_WORD and w not in known.old]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known.put(w, np.array(e.ids, dtype="<u4").tobytes())
        return [(known[w] if len(w) <= _CACHED_WORD else self._one(w)) if v is None else v for w, v in zip(words, found, strict=True)]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after the other, and where each
        one's begin.  Arrow cuts the column into words, parts letters from a
        few marks behind them (the vocabulary never joins the two), puts A-Z in
        lower case as the vocabulary does, and numbers what is left, so Python
        sees each distinct part of the column once."""
        cut = pc.ascii_split_whitespace(col.cast(pa.large_string()))
        coded = cut.flatten().dictionary_encode()
        whole = coded.dictionary
        stem = pc.utf8_rtrim(whole, _MARKS)
        behind = pc.subtract(pc.utf8_length(whole), pc.utf8_length(stem)).to_numpy(zero_copy_only=False)
        parted = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False) & (behind <= _MOST_MARKS)
        head = pc.if_else(pa.array(parted), pc.ascii_lower(stem), whole).dictionary_encode()
        behind = np.where(parted, behind, 0)
        mark = np.zeros(len(whole), np.int64)      # 0: none
        marks = [""]
        for n in range(1, _MOST_MARKS + 1):
            at = np.flatnonzero(behind == n)
            if len(at):
                some = pc.utf8_slice_codeunits(whole.take(pa.array(at)), -n).dictionary_encode()
                mark[at] = some.indices.to_numpy() + len(marks)
                marks += some.dictionary.to_pylist()
        found = self._look_up(head.dictionary.to_pylist()) + self._look_up(marks)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids, starts = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        both = np.stack([head.indices.to_numpy(), mark + len(head.dictionary)], axis=1)
        part = both[coded.indices.to_numpy()].ravel()
        size = sizes[part]
        ends = np.concatenate([[0], np.cumsum(size)])
        first = ends[2 * (np.asarray(cut.offsets) - cut.offsets[0].as_py())]
        return ids[np.repeat(starts[part] - ends[:-1], size) + np.arange(ends[-1])], first


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


class Packer:
    """The open windows of one task.  A piece is (row, start, ids as bytes);
    finished pieces go to ``out`` with their sequence and offset."""

    def __init__(self, first_sequence: int, window: int = WINDOW, n_open: int = OPEN_WINDOWS):
        self.sequence, self.window, self.n_open = first_sequence, window, n_open
        self.open: list[list] = []   # [free, pieces]
        self.out: list[tuple] = []

    def emit(self, pieces) -> None:
        at = 0
        for row, start, ids in pieces:
            self.out.append((row, start, ids, self.sequence, at))
            at += len(ids) // 4
        self.sequence += 1

    def add(self, row, ids: bytes, start: int = 0) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.window:
            self.emit([(row, start + at, ids[4 * at:4 * (at + self.window)])])
            at += self.window
        while at < n:
            fits = [w for w in self.open if w[0] >= n - at]
            if fits:
                w = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.n_open:
                self.open.append(w := [self.window, []])
            else:
                w = min(self.open, key=lambda w: w[0])
            take = min(w[0], n - at)
            w[1].append((row, start + at, ids[4 * at:4 * (at + take)]))
            w[0] -= take
            at += take
            if not w[0]:
                self.open.remove(w)
                self.emit(w[1])

    def join(self) -> list[tuple]:
        """Close the open windows: full sequences, and less than one left."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        self.open, held, free = [], [], self.window
        for row, start, ids in pieces:
            while ids:
                head, ids = ids[:4 * free], ids[4 * free:]
                held.append((row, start, head))
                start, free = start + len(head) // 4, free - len(head) // 4
                if not free:
                    self.emit(held)
                    held, free = [], self.window
        return held


def split_powers(pieces: list[tuple], size: int) -> list[list[tuple]]:
    """The pieces cut into sequences whose lengths are powers of two."""
    out, queue = [], list(pieces)
    for bit in reversed(range(size.bit_length())):
        if size >> bit & 1:
            need, held = 1 << bit, []
            while need:
                row, start, ids = queue.pop(0)
                head, rest = ids[:4 * need], ids[4 * need:]
                held.append((row, start, head))
                need -= len(head) // 4
                if rest:
                    queue.insert(0, (row, start + len(head) // 4, rest))
            out.append(held)
    return out


def _schema(kind: pa.DataType) -> pa.Schema:
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pa.schema([("doc_id", kind), *((c, pa.int64()) for c in longs), ("part", pa.int64()), ("rank", pa.int64()),
                      ("ids", pa.binary())])


def _batch(done: list[tuple], left: list[tuple], part: int, kind: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    """Rows of finished pieces (part null) and of leftovers (part set)."""
    rows = [(r[0], s, len(i) // 4, zlib.crc32(i), r[1], q, o, None, None, i if with_ids else None) for r, s, i, q, o in done]
    rows += [(r[0], s, len(i) // 4, 0, r[1], None, None, part, k, i) for k, (r, s, i) in enumerate(left)]
    schema = _schema(kind)
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _pack(path: str, window: int, n_open: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder, end = word_ids(path), np.array([END_ID], dtype="<u4").tobytes()
        packer, kind = Packer(part << 24, window, n_open), None
        for b in batches:
            kind = b.column(0).type
            flat, first = encoder.encode(b.column(1))
            for doc, lo, hi in zip(b.column(0).to_pylist(), first[:-1], first[1:], strict=True):
                ids = flat[lo:hi].tobytes() + end
                packer.add((doc, len(ids) // 4), ids)
            yield _batch(packer.out, [], part, kind, with_ids)
            packer.out = []
        if kind is not None:
            left = packer.join()
            yield _batch(packer.out, left, part, kind, with_ids)
    return run


def _merge(level: int, last: bool, window: int, with_ids: bool):
    def run(key, table):
        grp = key[0].as_py()
        t = table.sort_by([("part", "ascending"), ("rank", "ascending")])
        kind = t.schema.field("doc_id").type
        packer = Packer((level << 56) + (grp << 24), window, 1)
        cols = [t.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "ids")]
        packer.open = [[0, [((d, n), s, i) for d, n, s, i in zip(*cols, strict=True)]]]
        left = packer.join()
        if last and left:
            for pieces in split_powers(left, sum(len(i) // 4 for _, _, i in left)):
                packer.emit(pieces)
            left = []
        return pa.Table.from_batches([_batch(packer.out, left, grp, kind, with_ids)])
    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, n_open: int = OPEN_WINDOWS, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of ``docs`` in sequences of at most ``window`` ids: doc_id, start
    (ids of the document before the piece), length, ids_crc32 (of the piece's
    little-endian 32-bit ids), doc_tokens, sequence_id, offset (in the
    sequence), ids (binary; null unless ``with_ids``).

    Defined cases: null or empty text has the end id alone; repeated rows are
    documents each; a null doc_id comes back null; an empty table gives no
    rows.  Sequences are full but for those of the last leftover, whose
    lengths are powers of two.  Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ddl = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long, part long, rank long, ids binary")
    got = stage(rows.mapInArrow(_pack(path, window, n_open, with_ids), ddl), "packed")
    done, left = got.filter("part is null"), got.filter("part is not null")
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level += 1
        parts = -(-parts // MERGE_GROUP)
        merged = (left.withColumn("grp", F.floor(F.col("part") / MERGE_GROUP)).groupBy("grp")
                  .applyInArrow(_merge(level, parts == 1, window, with_ids), ddl))
        if parts == 1:
            return done.unionByName(merged).drop("part", "rank")
        merged = stage(merged, "merged")
        done, left = done.unionByName(merged.filter("part is null")), merged.filter("part is not null")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY)).drop("ids")
