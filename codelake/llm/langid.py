"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary gives the pieces.  Every language has a probability
for each piece; a word's probability is the sum over all its segmentations
into pieces (forward algorithm), and a text's is the product over its words.
The probabilities are learned by EM: expected piece counts from the forward
and backward sums of the training words of each language.

All pieces of the vocabulary count that lower-cased text can hold, and words are
summed whole; long ones are rescaled on the way, so that no sum underflows.

Scale: training goes over the table of distinct (language, word) pairs, which
tasks combine before the shuffle; what comes back is bounded by languages x
vocabulary.  Scoring is one pass; each worker remembers words it has summed.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import id_remainder, mix64, read, small_batches, stage, stream64
from codelake.llm.tokens import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
SAFE = 16             # characters whose product cannot underflow; longer words are rescaled
AT_ONCE = 100_000     # words of an EM round that are summed together
MOST_LANGUAGES = 2000 # a column of more values is no language column
ROUNDS = 2            # of EM
SMOOTHING = 0.01      # pseudo-count of every piece
COUNTED_WORDS = 200_000
KEPT_WORDS = 800_000
UNDETERMINED = "und"
# to be called foreign: share of training texts, nats a character, and more of
# them by the root of the length, as short texts vary
RARE, MARGIN, SHORT = 0.001, 0.5, 10.0

_LETTER = regex.compile(r"\p{L}")
_U = np.uint64
_STEP = stream64(301, 64) | _U(1)     # by place in a span, longer than any piece


def _span_hashes(units: np.ndarray, k: int, held: np.ndarray | None) -> np.ndarray:
    """Hashes of all spans of ``k`` characters, from those of one fewer."""
    last = mix64(units[:, k - 1:].astype(np.uint64) + _U(77)) * _STEP[k - 1]
    return last if held is None else held[:, :last.shape[1]] + last


def _characters(units: list[str]) -> np.ndarray:
    """Code points (units of one length x characters)."""
    n = len(units[0])
    return np.array(units, dtype=f"<U{n}").view(np.uint32).reshape(len(units), n)


class Pieces:
    """The pieces of the vocabulary that lower-cased text can make, in a hash
    table for whole arrays of spans; index ``len(self)`` stands for any
    character that is no piece."""

    BITS = 20

    def __init__(self, names: list[str]):
        self.names, self.longest = names, max(map(len, names))
        self.hashes = np.zeros(len(names), np.uint64)
        by_length: dict[int, list[int]] = {}
        for i, p in enumerate(names):
            by_length.setdefault(len(p), []).append(i)
        for n, rows in by_length.items():
            units, h = _characters([names[i] for i in rows]), None
            for k in range(1, n + 1):
                h = _span_hashes(units, k, h)
            self.hashes[rows] = h[:, 0]
        self.slots = np.full(1 << self.BITS, -1, dtype=np.int32)
        for i, at in enumerate((mix64(self.hashes) >> _U(64 - self.BITS)).astype(np.int64).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at] = i

    def __len__(self) -> int:
        return len(self.names)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece of each hash, -1 for none."""
        at = (mix64(h) >> _U(64 - self.BITS)).astype(np.int64)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.hashes[out] != h))
        while len(left):  # the slot holds another piece: look at the next
            at[left] = (at[left] + 1) % len(self.slots)
            out[left] = self.slots[at[left]]
            left = left[(out[left] >= 0) & (self.hashes[out[left]] != h[left])]
        return out

    def spans(self, units: list[str]) -> np.ndarray:
        """Piece index of every start and length (units of one length)."""
        chars = _characters(units)
        w, n = chars.shape
        top = min(self.longest, n)
        out, h = np.full((w, n, top + 1), -1, dtype=np.int32), None
        for k in range(1, top + 1):
            h = _span_hashes(chars, k, h)
            found = self.find(h.ravel()).reshape(h.shape)
            out[:, :n - k + 1, k] = np.where(found < 0, len(self), found) if k == 1 else found
        return out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The pieces of a worker process."""
    if path not in _PIECES:
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [m.id_to_piece(i) for i in range(m.vocab_size())
               if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        _PIECES[path] = Pieces([p for p in own if p == p.lower()])
    return _PIECES[path]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _by_length(words: list[str]):
    """Lists of (row, marked word) of one length, of bounded size."""
    lengths: dict[int, list] = {}
    for i, w in enumerate(words):
        u = MARK + w
        lengths.setdefault(len(u), []).append((i, u))
    for n, found in lengths.items():
        step = max(1, (1 << 16) // n)
        for lo in range(0, len(found), step):
            yield found[lo:lo + step]


def forward(spans: np.ndarray, prob) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums over the segmentations of every prefix, and the natural log of what
    each was divided by.  ``prob(ids)`` gives the probabilities of pieces, 0
    for -1.  Every ``SAFE`` characters the sums that still count are divided
    by the last one."""
    n, top = spans.shape[1], spans.shape[2] - 1
    one = np.ones_like(prob(spans[:, 0, 1]))
    sums, logs = [one], [np.zeros_like(one)]
    for e in range(1, n + 1):
        sums.append(sum(sums[e - k] * prob(spans[:, e - k, k]) for k in range(1, min(top, e) + 1)))
        logs.append(logs[-1])
        if e % SAFE == 0 and e < n:
            # earlier sums are only read on this scale from here on
            by, log = sums[e], np.log(sums[e])
            for i in range(max(0, e - top + 1), e + 1):
                sums[i] = sums[i] / by
                logs[i] = logs[i] + log
    return sums, logs


def log_probabilities(words: list[str], vocab: Pieces, table: np.ndarray) -> np.ndarray:
    """words x languages; ``table`` is pieces x languages with a last row of
    zeros for -1."""
    out = np.zeros((len(words), table.shape[1]))
    for part in _by_length(words):
        sums, logs = forward(vocab.spans([u for _, u in part]), lambda ids: table[ids])
        out[[i for i, _ in part]] = np.log(sums[-1]) + logs[-1]
    return out


def expected_counts(words: list[str], language: np.ndarray, weight: np.ndarray, vocab: Pieces,
                    table: np.ndarray) -> np.ndarray:
    """Expected piece counts, pieces x languages, of weighted words."""
    out = np.zeros(table.shape)
    for part in _by_length(words):
        row = np.array([i for i, _ in part])
        lang, times = language[row], weight[row]
        spans = vocab.spans([u for _, u in part])
        n, top = spans.shape[1], spans.shape[2] - 1
        prob = lambda ids: table[ids, lang]  # noqa: B023, E731
        ahead, logs = forward(spans, prob)
        # what follows each place, divided by exp(log) of its own
        behind, after = [None] * n + [np.ones(len(part))], [None] * n + [np.zeros(len(part))]
        total = np.log(ahead[n]) + logs[n]
        ids, parts = [], []
        for s in range(n - 1, -1, -1):
            scale = after[s + 1]
            behind[s] = np.zeros(len(part))
            for k in range(1, min(top, n - s) + 1):
                p = prob(spans[:, s, k]) * behind[s + k]
                if n > SAFE:
                    p = p * np.exp(after[s + k] - scale)
                behind[s] += p
                ids.append(spans[:, s, k])
                parts.append(ahead[s] * p * np.exp(logs[s] + scale - total) if n > SAFE else ahead[s] * p / ahead[n])
            after[s] = scale
            if n > SAFE and s % SAFE == 0:
                after[s] = scale + np.log(behind[s])
                behind[s] = np.ones(len(part))
        ids, parts = np.stack(ids), np.stack(parts) * times
        fine = ids >= 0
        cell = ids * table.shape[1] + lang
        out += np.bincount(cell[fine], parts[fine], out.size).reshape(out.shape)
    return out


def _count_words(batches):
    """(lang, word, n) of a task, combined as far as memory is bounded."""
    counts: dict[str, Counter] = {}

    def rows():
        flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        cols = list(zip(*flat, strict=True)) or [(), (), ()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                                          names=["lang", "word", "n"])
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, counts.values())) > COUNTED_WORDS:
            yield rows()
    if counts:
        yield rows()


def start_table(n_pieces: int, n_langs: int) -> np.ndarray:
    """Probabilities before the first round: falling with the vocabulary's
    order, the same for all languages; the last row is that of no piece."""
    p = 1.0 / (np.arange(n_pieces + 1) + 50.0)
    p = np.append(p / p.sum(), 0.0)
    return np.repeat(p[:, None], n_langs, axis=1)


def learn(train: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and the table of piece probabilities, from the
    columns lang and text of ``train``."""
    counted = train.mapInArrow(_count_words, "lang string, word string, n long")
    table_df = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = [r[0] for r in table_df.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in the language column")
    vocab = pieces(path)
    table = start_table(len(vocab), len(langs))
    order = {lang: i for i, lang in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        def expect(batches, table=table):
            own, total = pieces(path), np.zeros(table.shape)
            held: list[tuple[list, list, np.ndarray]] = []

            def add():
                langs_, words, n = zip(*held, strict=True)
                lang = np.array([order[x] for part in langs_ for x in part], dtype=np.int64)
                held.clear()
                return expected_counts([w for part in words for w in part], lang, np.concatenate(n).astype(float), own, table)
            for b in batches:
                held.append((b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()))
                if sum(len(w) for _, w, _ in held) >= AT_ONCE:
                    total += add()
            if held:
                total += add()
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(total[piece, lang])],
                                             names=["piece", "lang", "n"])
        got = table_df.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        counts = np.zeros(table.shape)
        for r in got.collect():  # at most pieces x languages
            counts[r.piece, r.lang] = r.n
        table = counts + SMOOTHING
        table[-1] = 0.0
        table /= table.sum(axis=0)
    return langs, table


class _Scorer:
    """Scores of one worker process; remembers words it has summed."""

    def __init__(self, path: str, table: np.ndarray):
        self.vocab, self.table = pieces(path), table
        self.at: dict[str, int] = {}
        self.known = np.zeros((0, table.shape[1]))

    def add(self, texts: list[list[str]]) -> None:
        if len(self.at) > KEPT_WORDS:
            self.at, self.known = {}, self.known[:0]
        new = list({w for t in texts for w in t if w not in self.at})
        if new:
            self.known = np.concatenate([self.known, log_probabilities(new, self.vocab, self.table)])
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))

    def score(self, words: list[str]) -> np.ndarray:
        rows = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        return self.known[rows].sum(axis=0)

    def predict(self, col: pa.Array, langs: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, posterior, and log probability a character in that
        language (with an allowance for short texts), of every text of a column."""
        texts = [words_of(t) if langs and _LETTER.search(t) else [] for t in col.fill_null("").to_pylist()]
        pred, score, rate = [], [], []
        for lo in range(0, len(texts), 250):
            self.add(texts[lo:lo + 250])
            for t in texts[lo:lo + 250]:
                if t:
                    s = self.score(t)
                    best = int(s.argmax())
                    pred.append(langs[best])
                    score.append(float(1.0 / np.exp(s - s[best]).sum()))
                    n = sum(len(w) + 1 for w in t)
                    rate.append(float(s[best]) / n + SHORT / n ** 0.5)
                else:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    rate.append(0.0)
        return pred, score, rate


_SCORERS: dict[tuple[str, bytes], _Scorer] = {}


def _scorer(path: str, table: np.ndarray) -> _Scorer:
    """The scorer of a worker process for a model, kept from task to task;
    that of another model goes."""
    key = (path, hashlib.sha256(table.tobytes()).digest())
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = _Scorer(path, table)
    return _SCORERS[key]


def train_languages(train: DataFrame, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The model of the columns lang and text of ``train``; rows of null lang
    or text are left out.  More than ``MOST_LANGUAGES`` languages are an error:
    the model is a table of pieces x languages."""
    small_batches(train.sparkSession)
    train = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return learn(train.filter("lang is not null and text is not null"), path, rounds)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language under
    equal priors, 0 to 1) of every row of ``docs``.

    Defined cases: null text, and text without a letter: ``und`` with score 0;
    so is everything if the model has no language.  Ties go to the first
    language by name; repeated rows and null ids come back as they are; an
    empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    langs, table = model

    def run(batches):
        scorer = _scorer(path, table)
        for b in batches:
            pred, score, _ = scorer.predict(b.column(1), langs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def floors(train: DataFrame, model: tuple[list[str], np.ndarray], path: str) -> dict[str, float]:
    """By language, the log probability a character (see ``predict``) under which
    only ``RARE`` of its training texts lie, less ``MARGIN``: what is rarer was not written in
    that language, whichever it is nearest to.  From the columns lang and text
    of all of ``train``; rows of null lang or text are left out."""
    small_batches(train.sparkSession)
    langs, table = model

    def run(batches):
        scorer = _scorer(path, table)
        for b in batches:
            pred, _, rate = scorer.predict(b.column(1), langs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(rate, pa.float64())], names=["lang", "pred", "rate"])
    rows = train.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    rates = rows.mapInArrow(run, "lang string, pred string, rate double").filter("lang = pred")
    got = rates.groupBy("lang").agg(F.percentile_approx("rate", RARE, 100_000).alias("least")).collect()  # one row a language
    return {r.lang: r.least - MARGIN for r in got}


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, text_col: str = "text",
                    least: float = 0.5, least_rates: dict[str, float] | None = None) -> DataFrame:
    """The rows of ``docs``, whole, whose language is determined with a
    posterior of ``least`` or more, and whose log probability a character is
    not under that of ``least_rates`` (see ``floors``)."""
    small_batches(docs.sparkSession)
    langs, table = model
    at = docs.columns.index(text_col)
    under = least_rates or {}

    def run(batches):
        scorer = _scorer(path, table)
        for b in batches:
            yield b.filter(pa.array([p != UNDETERMINED and s >= least and r >= under.get(p, -np.inf)
                                     for p, s, r in zip(*scorer.predict(b.column(at), langs), strict=True)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def training(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return docs.filter(id_remainder(F.col("doc_id"), 3) != 1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    path = tokenizer_path(VOCABULARY)
    found = identify(docs, train_languages(training(docs), path), path)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
