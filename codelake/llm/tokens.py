"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to ``CHUNK`` characters is encoded in one call.  A longer one is
encoded in chunks that overlap.  Each chunk's tokens carry their character
offsets; two neighbours are spliced at a common boundary: an offset in the
overlap at which both encodings start a token and which is proven stable.
Stable means that no vocabulary entry can lie across it, so no merge on one
side depends on the other side.  An overlap without such an offset is doubled
and encoded again until one is found or the text ends.  So memory and time of
a call are bounded by the chunk, however long the text, and the count is that
of the whole text.

What is stable is read off the vocabulary: entries hold the space mark only
at their start or throughout (checked when the model is loaded), so nothing
lies across the place before a space that follows a non-space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import read, small_batches

CHUNK, OVERLAP = 16384, 256     # characters
MODEL = "piece_bpe_32k.model"
_MARK = "▁"                # stands for a space inside the model
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str):
    """The model of a worker process, after the check that its vocabulary has
    the stable boundaries that splicing needs."""
    if path not in _LOADED:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (m.id_to_piece(i) for i in range(m.vocab_size()))
        across = [p for p in pieces if _MARK in p.lstrip(_MARK)]
        if across:
            raise ValueError(f"{len(across)} entries of {path} hold a space within: no stable boundaries")
        # a space kept as it is, with one put before the text
        if m.encode("a  b", out_type=str) != m.encode("a", out_type=str) + [_MARK] + m.encode("b", out_type=str):
            raise ValueError(f"{path} does not keep spaces as they are")
        _LOADED[path] = m
    return _LOADED[path]


def _stable(text: str, at: int) -> bool:
    """Whether a token boundary before the space text[at] is independent of
    either side, and text[at + 1:] encodes as the rest does (the model puts a
    space before a text, which stands for the one at ``at``)."""
    return text[at] == " " and text[at - 1] not in (" ", _MARK) and at + 1 < len(text)  # an empty rest has no space put before it


def _offsets(model, text: str, start: int) -> np.ndarray:
    """Offsets in the whole text at which tokens of a chunk start; the chunk
    follows the space at ``start - 1`` (or the text's beginning)."""
    begin = np.array([p.begin for p in model.encode(text, return_type="proto").pieces], dtype=np.int64)
    raw = np.frombuffer(text.encode() + b" ", dtype=np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1  # the model counts bytes
    return character[begin] + start


def count_long(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks."""
    total, start, n = 0, 0, len(text)
    while True:
        if n - start <= chunk:
            return total + len(model.encode(text[start:]))
        width, end = overlap, start + chunk
        while True:
            # the next chunk begins at a stable place of the overlap ...
            end = min(n, start + chunk - overlap + width)
            low = start + chunk - overlap
            left = None
            at = next((i for i in range(low, end) if _stable(text, i)), None)
            if at is not None:
                left = _offsets(model, text[start:end], start) if left is None else left
                right = _offsets(model, text[at + 1:min(n, at + 1 + width)], at + 1)
                cut = _common(text, left, right, at, end, n)
                if cut is not None:
                    total += int(np.searchsorted(left, cut))
                    start = cut + 1
                    break
            if end == n:
                return total + len(model.encode(text[start:]))
            width *= 2


def _common(text: str, left: np.ndarray, right: np.ndarray, at: int, end: int, n: int) -> int | None:
    """The last stable offset in the overlap at which both encodings start a
    token; ``at`` itself is the right one's first boundary."""
    both = np.intersect1d(left, np.concatenate([[at], right[right > at + 1]]))
    for cut in both[::-1].tolist():
        # tokens of the left chunk's last word may change with what follows it
        if at <= cut < end and _stable(text, cut) and cut in left:
            return cut
    return None


def _count(path: str, chunk: int, overlap: int):
    def run(batches):
        model = load(path)
        for b in batches:
            texts = b.column(1).fill_null("").to_pylist()
            out = np.zeros(len(texts), dtype=np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for lo in range(0, len(short), 64):
                part = short[lo:lo + 64]
                out[part] = [len(ids) for ids in model.encode([texts[i] for i in part], num_threads=1)]
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    out[i] = count_long(model, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out)], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) of
    every row.

    Defined cases: null or empty text has no bytes and no tokens; repeated
    rows and null ids come back as they are; an empty table gives no rows;
    other columns are not read.  No begin, end or added special tokens.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return (rows.mapInArrow(_count(model_path, chunk, overlap), f"doc_id {kind}, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path(MODEL))
