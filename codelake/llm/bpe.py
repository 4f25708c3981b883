"""Byte-level BPE encoding and decoding.

A text is cut at added tokens, then by the byte-level pattern into pieces.  A
piece's bytes are symbols of a doubly linked list; a priority queue holds the
ranks of its adjacent pairs.  The best pair is merged, its new neighbours are
queued, and entries whose symbols have changed meanwhile are skipped when they
come up.  Decoding puts the vocabulary strings of the ids together and reads
the bytes as UTF-8.

Pieces never cross from a non-space to a space, so a text without runs of
spaces is encoded word by word, and each worker remembers frequent words.
Nothing is shuffled; memory is bounded by the two caches and one batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import Memo, read, small_batches
from codelake.llm.tokens import tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
CACHED_WORD = 64  # longer words are encoded without being remembered

# FIXED VALUES: white space as the pattern means it, and the pattern
_WS = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: printable
    Latin-1 characters for themselves, the others moved behind 255 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(moved)}


class Merges:
    """Merge rules: for the left symbol, the ranks of its right partners; for
    a rank, its two symbols and the merged one."""

    def __init__(self, rules: list[tuple[int, int, int]], n_symbols: int):
        self.rank: list[dict[int, int]] = [{} for _ in range(n_symbols)]
        for r, (a, b, _) in enumerate(rules):
            self.rank[a][b] = r
        self.left, self.right, self.merged = (list(x) for x in zip(*rules, strict=True))

    def apply(self, sym: list[int]) -> list[int]:
        """Apply all merges to a piece, lowest rank first, leftmost among
        equals.  A queue entry is its rank above 32 bits of position."""
        n = len(sym)
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        queue = []
        for i in range(n - 1):
            r = rank[sym[i]].get(sym[i + 1])
            if r is not None:
                queue.append(r << 32 | i)
        if not queue:
            return sym
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r = pop(queue)
            i = r & 0xFFFFFFFF
            r >>= 32
            j = after[i]
            if sym[i] != left[r] or j >= n or sym[j] != right[r]:
                continue  # stale: one of the two was merged meanwhile
            new = sym[i] = merged[r]
            sym[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank[new].get(sym[k])
                if r is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank[sym[h]].get(new)
                if r is not None:
                    push(queue, r << 32 | h)
        return [s for s in sym if s >= 0]


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], max(vocab.values()) + 1)
        symbols = byte_symbols()
        self.byte_id = [vocab[symbols[b]] for b in range(256)]
        back = {c: b for b, c in symbols.items()}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.marks = [s for s in self.added]
        self.pattern = regex.compile(_PATTERN)
        self.pieces = Memo(self._piece)
        self.words = Memo(lambda w: self.shown(self._plain(" " + w)))

    def _piece(self, piece: str) -> tuple[int, ...]:
        byte_id = self.byte_id
        return tuple(self.merges.apply([byte_id[b] for b in piece.encode()]))

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        out: list[int] = []
        for p in self.pattern.findall(text):
            out += self.pieces[p] if len(p) <= CACHED_WORD else self._piece(p)
        return out

    def encode(self, text: str) -> list[int]:
        if self.special is None or not any(s in text for s in self.marks):
            return self._plain(text)
        out: list[int] = []
        for part in self.special.split(text):
            out += [self.added[part]] if part in self.added else self._plain(part)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def shown(self, ids) -> tuple[str, int, bytes]:
        """Ids as decimal numbers joined by commas, their number, and what
        they decode to."""
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def round_trip(self, text: str) -> tuple[str, int, bytes]:
        """``shown`` of a whole text, word by word where that is the same."""
        words = text.split(" ")
        if len(words) < 2 or "" in words or any(s in text for s in self.marks):
            return self.shown(self.encode(text))
        parts = [self.shown(self.encode(words[0]))]
        del words[0]
        if max(map(len, words)) > CACHED_WORD:
            parts += [self.words[w] if len(w) <= CACHED_WORD else self.shown(self._plain(" " + w)) for w in words]
        else:
            parts += map(self.words.__getitem__, words)
        shown, counts, raw = zip(*parts, strict=True)
        return ",".join(shown), sum(counts), b"".join(raw)


_LOADED: dict[str, ByteBpe] = {}


def codec(path: str) -> ByteBpe:
    """The codec of a worker process, with its caches."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every row; null and empty texts: no ids."""
    def run(batches):
        c = codec(path)
        for b in batches:
            ids = [c.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])
    rows, kind = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row of ids; null or no ids: the empty text."""
    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(i or []) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])
    small_batches(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256 (of the decoded text in UTF-8) of every row, encoded and
    decoded in one pass so that no id leaves its task.

    Defined cases: null and empty texts have no ids; added tokens inside a
    text become their id; repeated rows and null ids come back as they are; an
    empty table gives no rows; other columns are not read.
    """
    def run(batches):
        c = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            counts, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                shown, n, raw = c.round_trip(t)
                counts.append(n)
                of_ids.append(sha(shown.encode()))
                of_text.append(sha(raw.decode("utf-8", errors="replace").encode()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows, kind = _texts(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
