"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear model of the text
that minimises the non-negative unbiased risk
``p * P[l(g)] + max(0, U[l(-g)] - p * P[l(-g)])``: P and U are means over the
positives and the unlabelled texts, p is the estimated share of positives and
l the logistic loss.  Negative labels are not used in the fit; where training
labels of both kinds are at hand, p is the share of positives among them.  With
positives alone it is estimated from the two samples, as the least share of
unlabelled texts, by share of positives, above any cut that keeps most positives
(of scores by models that did not see the text).

Scale: features are one vectorised pass over the texts.  The edges of the bins
are quantiles of all training texts.  The model is fitted on at most
``POSITIVES`` and ``UNLABELLED`` documents, those of the least id hash, in one
task; its weights are a few kilobytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import hash_spans, id_remainder, read, slices, small_batches, stage, text_buffer, word_spans

POSITIVES = UNLABELLED = 8192   # bound of the training sample
HASHED = 1024                   # buckets of words
BINS = 10                       # of each statistic
STATS = 12
STEPS, RATE, DECAY = 400, 0.05, 1e-4
MOST = 0.8                      # positives that a cut must keep to tell the prior
ACCURACY = 10_000               # of the approximate quantiles

_UPPER, _DIGIT, _SYMBOL, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"?-()"]] = True
_STOP[list(b".,;:?")] = True


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Statistics (rows x STATS) and mean word buckets (rows x HASHED)."""
    stats, hashed = [], []
    for lo, hi in slices(col, 1 << 20):
        buf, at = text_buffer(col.slice(lo, hi - lo))
        starts, ends, first = word_spans(buf, at)
        h = hash_spans(buf, starts, ends)
        rows, n_words = hi - lo, np.diff(first)
        n_bytes, some = np.diff(at).astype(float), np.maximum(n_words, 1)
        row = np.repeat(np.arange(rows), n_words)
        per_byte = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[buf])])[at]) / np.maximum(n_bytes, 1)  # noqa: B023, E731
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        second = np.zeros(len(h))
        second[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
        distinct, most = np.zeros(rows), np.zeros(rows)
        for i in range(rows):
            if n_words[i]:
                _, c = np.unique(h[first[i]:first[i + 1]], return_counts=True)
                distinct[i], most[i] = len(c), c.max()
        last = buf[ends - 1] if len(ends) else buf[:0]
        mean = lambda x: np.bincount(row, x, rows) / some  # noqa: B023, E731
        length = (ends - starts).astype(float)
        is_upper = np.concatenate([[0], np.cumsum(_UPPER[buf])])
        shout = (is_upper[ends] - is_upper[starts] >= 2) if len(starts) else np.zeros(0)
        stats.append(np.stack([
            np.log1p(n_words), mean(length), mean((length > 15).astype(float)), per_byte(_UPPER), per_byte(_DIGIT), per_byte(_SYMBOL),
            mean(_SYMBOL[last].astype(float)), mean(_STOP[last].astype(float)), mean(np.asarray(shout, float)), mean(same + second),
            distinct / some / np.maximum(1, np.log10(np.maximum(some, 10))), most / some], axis=1))
        cell = row * HASHED + (h % np.uint64(HASHED)).astype(np.int64)
        hashed.append((np.bincount(cell, minlength=rows * HASHED).reshape(rows, HASHED) / some[:, None]).astype(np.float32))
    if not stats:
        return np.zeros((0, STATS)), np.zeros((0, HASHED), np.float32)
    return np.concatenate(stats), np.concatenate(hashed)


def _stat_rows(batches):
    names = [f"s{j}" for j in range(STATS)]
    for b in batches:
        stats, _ = features(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in stats.T], names=names)


def bin_edges(texts: DataFrame) -> np.ndarray:
    """Edges between the bins of each statistic: quantiles over all ``texts``."""
    stats = texts.select("text").mapInArrow(_stat_rows, ", ".join(f"s{j} double" for j in range(STATS)))
    at = F.array(*(F.lit(q / BINS) for q in range(1, BINS)))
    got = stats.agg(*(F.percentile_approx(f"s{j}", at, ACCURACY).alias(f"s{j}") for j in range(STATS))).first()
    return np.array([got[j] or [0.0] * (BINS - 1) for j in range(STATS)], dtype=float).T


def design(stats: np.ndarray, hashed: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of the linear model: bins, word buckets, a constant."""
    onehot = np.zeros((len(stats), STATS * BINS), dtype=np.float32)
    for j in range(STATS):
        onehot[np.arange(len(stats)), j * BINS + np.searchsorted(edges[:, j], stats[:, j], side="left")] = 1
    return np.concatenate([onehot, hashed * np.float32(4), np.ones((len(stats), 1), np.float32)], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(x_pos: np.ndarray, x_any: np.ndarray, prior: float, steps: int = STEPS) -> np.ndarray:
    """Weights of least non-negative risk, by Adam on the whole sample.  While
    the negative part of the risk is below zero, its step is taken back."""
    w = np.zeros(x_pos.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        w_x = w.astype(x_pos.dtype)  # as the rows, which would else be converted at every step
        zp, zu = (x_pos @ w_x).astype(float), (x_any @ w_x).astype(float)
        sp, su = sigmoid(zp).astype(x_pos.dtype), sigmoid(zu).astype(x_pos.dtype)
        pos_part = x_pos.T @ (sp - 1) * (prior / len(zp))           # of p P[l(g)]
        neg_part = x_any.T @ su / len(zu) - x_pos.T @ sp * (prior / len(zp))
        neg_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad = (pos_part + neg_part if neg_risk >= 0 else -neg_part) + DECAY * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def estimate_prior(x_pos: np.ndarray, x_any: np.ndarray, steps: int = STEPS) -> float:
    """Share of positives among the unlabelled rows: two models tell positives
    from unlabelled rows, each of one half and applied to the other; above a
    cut that keeps the share k of the positives lie at least p * k of the
    unlabelled rows, so the least ratio of the two bounds p."""
    pos, rest = np.zeros(len(x_pos)), np.zeros(len(x_any))
    for half in (0, 1):
        w = fit(x_pos[1 - half::2], x_any[1 - half::2], 0.5, steps).astype(x_pos.dtype)
        pos[half::2], rest[half::2] = x_pos[half::2] @ w, x_any[half::2] @ w
    cuts = np.quantile(pos, 1 - np.linspace(MOST, 1, 50))
    ratio = min((rest >= c).mean() / (pos >= c).mean() for c in cuts)
    # away from 0 and 1, where the risk says nothing
    return float(min(max(ratio, 0.02), 0.98))


_ROW = pa.schema([("positive", pa.bool_()), ("stats", pa.binary()), ("hashed", pa.binary())])


def _feature_rows(batches):
    for b in batches:
        stats, hashed = features(b.column(1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([s.tobytes() for s in stats], pa.binary()),
             pa.array([h.astype(np.float16).tobytes() for h in hashed], pa.binary())], schema=_ROW)


def _fit_task(edges: np.ndarray, prior: float | None):
    def run(batches):
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2).to_pylist()) for b in batches]
        if not parts:
            return
        positive = np.concatenate([p[0] for p in parts]).astype(bool)
        stats = np.frombuffer(b"".join(s for p in parts for s in p[1]), np.float64).reshape(-1, STATS)
        hashed = np.frombuffer(b"".join(s for p in parts for s in p[2]), np.float16).reshape(-1, HASHED).astype(np.float32)
        if positive.sum() > 1 and (~positive).sum() > 1:
            x = design(stats, hashed, edges)
            share = estimate_prior(x[positive], x[~positive]) if prior is None else prior
            w = fit(x[positive], x[~positive], share)
            yield pa.RecordBatch.from_arrays([pa.array([share]), pa.array([w.tobytes()], pa.binary())], names=["prior", "weights"])
    return run


def learn(docs: DataFrame, positives: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """Bin edges and weights, or None with fewer than two positives or texts.
    ``docs`` are unlabelled training texts, ``positives`` has the trusted ids;
    ``prior`` is the share of positives, estimated if not given."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    t = t.filter("doc_id is not null")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = positives.select("doc_id").filter("doc_id is not null").distinct().orderBy(*order).limit(POSITIVES).withColumn("positive", F.lit(True))
    pool = t.select("doc_id").distinct().orderBy(*order).limit(UNLABELLED).withColumn("positive", F.lit(False))
    chosen = stage(pos.unionByName(pool), "chosen")
    sample = stage(t.join(F.broadcast(chosen), "doc_id").select("positive", "text").mapInArrow(
        _feature_rows, "positive boolean, stats binary, hashed binary"), "sample")
    edges = bin_edges(t)
    got = sample.repartition(1).sortWithinPartitions("positive", "stats").mapInArrow(_fit_task(edges, prior), "prior double, weights binary").collect()
    return (edges, np.frombuffer(got[0].weights, np.float64)) if got else None


def text_scores(col: pa.Array, model) -> np.ndarray:
    """Scores of a text column."""
    if model is None:
        return np.full(len(col), 0.5)
    edges, w = model
    return np.concatenate([sigmoid(design(*features(col.slice(lo, hi - lo)), edges) @ w)
                           for lo, hi in slices(col, 1 << 20)] or [np.zeros(0)])


def classify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every row.

    Defined cases: null and empty texts are scored as texts without words;
    without a model every score is 0.5; repeated rows and null ids come back
    as they are; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_scores(b.column(1), model))], names=["doc_id", "score"])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def keep_quality(docs: DataFrame, model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose text scores ``least`` or more."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(text_scores(b.column(at), model) >= least))
    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame):
    """The model of the texts of ``docs`` (unlabelled) and the trusted rows of
    ``labels`` (doc_id, quality) that may be learned from."""
    small_batches(docs.sparkSession)
    n = labels.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count("quality").alias("all")).first()
    # away from 0 and 1, where the risk says nothing
    prior = min(max(n.good / n.all, 0.02), 0.98) if 0 < n.good < n.all else None
    return learn(docs, labels.filter("quality = 1"), prior)


def training(rows: DataFrame) -> DataFrame:
    """The rows that may be learned from."""
    return rows.filter(id_remainder(F.col("doc_id"), 3) != 1)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return classify(docs, train(training(docs), training(labels))).select("doc_id", held_out.alias("held_out"), "score", "predicted")
