"""Features, weights and the draw against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import CLASHING, LOWER, documents, frame, sentence

from codelake.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def spans(text):
    m = [x.span() for x in WORD.finditer((text or "").translate(LOWER))]
    return sorted((m[i][0], m[i + k][1]) for k in range(3) for i in range(len(m) - k))


def texts():
    long = ["x" * 63 + " " + "y" * 64 + " é" + "z" * 62 + " " + "w" * 70 + " a " + "v" * 5000 + " b c"]
    return documents(6, 30) + long


@pytest.mark.parametrize("words, chars", [(1 << 18, 1 << 20), (5, 40), (3, 7)])
def test_features_by_slices_and_blocks(monkeypatch, words, chars):
    monkeypatch.setattr(resample, "_SLICE", words)
    monkeypatch.setattr(resample, "_BLOCK", chars)
    rows, tool = [t or "" for t in texts()], resample.Words()
    codes = [tool.codes(t) for t in rows]
    assert [len(c) for c in codes] == [buckets(t)[0] for t in rows]
    flat, at = resample.buckets(np.concatenate(codes), np.concatenate([[0], np.cumsum([len(c) for c in codes])]))
    for t, lo, hi in zip(rows, at[:-1], at[1:], strict=True):
        assert Counter(flat[lo:hi].tolist()) == Counter(buckets(t)[1])
        assert sorted(map(tuple, resample.windows(tool.offsets(t)).tolist())) == spans(t)


def draw(rows, target, percent=5, least=20):
    made = [(i, *buckets(t)) for i, t in rows]
    s, t = Counter(b for _, _, x in made for b in x), Counter(b for x in target for b in buckets(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in range(10000)]
    out = []
    for i, n, x in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for k, r in enumerate(enough[:len(enough) * percent // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


def test_draw_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = list(enumerate(texts())) + [(None, sentence(rnd, 40)), (7, sentence(rnd, 30)), (7, sentence(rnd, 10))]
    target = [sentence(rnd, 50) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for percent, least in ((5, 20), (60, 2), (100, 0)):
        got = resample.resample(df, frame(spark, target).select("text"), percent, least)
        cols = ("doc_id", "n_words", "n_features", "weight", "score", "rank")
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == draw(rows, target, percent, least)


def test_ties_and_repeated_rows(spark):
    text = "one two three " * 10
    rows = [(i, text) for i in (5, 5, 5, 3)] + [(9, text)]
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), frame(spark, [text]).select("text"), 100).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5]
    order = sorted(got, key=lambda r: r.rank)
    assert [(-r.score, r.doc_id) for r in order] == sorted((-r.score, r.doc_id) for r in got)


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = frame(spark, ["a b"]).select("text")
    assert resample.resample(none, target).collect() == []
    assert [r.weight for r in resample.resample(frame(spark, [None, ""]), none).collect()] == [0, 0]
    extra = CLASHING + ", place long, rank string, weight string, bucket string"
    row = dict.fromkeys([c.split()[0] for c in extra.split(", ")]) | {"doc_id": 1, "text": "a b c"}
    assert resample.resample(spark.createDataFrame([row], extra), target, 100, 1).first().n_features == 6


def test_spans_of_features(spark):
    got = resample.feature_spans(frame(spark, ["Été, (one)  TWO", None])).collect()
    assert sorted((r.doc_id, r.start, r.end) for r in got) == [(0, a, b) for a, b in spans("Été, (one)  TWO")]


def test_appended_crc():
    rnd = random.Random(4)
    pairs = [(rnd.randbytes(rnd.randint(0, 80)), rnd.randbytes(rnd.choice([rnd.randint(0, 70), rnd.randint(0, 5000)]))) for _ in range(500)]
    left, right = (np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1))
    got = resample.append(left, np.array([len(b) for _, b in pairs]), right)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
