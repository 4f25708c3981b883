"""Distances over the prefix tree against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import CLASHING, LOWER, documents, sentence

from codelake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least, top):
    docs = [(a or "", b or "", TERM.findall((t or "").translate(LOWER))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, ws in here for w in set(ws))
        kept = {w for w, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, s, ws in here:
            count[s].update(w for w in ws if w in kept)
        whole = sum(count.values(), Counter())
        v = len(kept)
        p = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * v) for w in kept}  # noqa: B023, E731
        q, ps = p(whole), {s: p(c) for s, c in count.items()}
        for s in ps:
            pairs = [(o, sum(abs(ps[s][w] - ps[o][w]) for w in kept)) for o in ps if o != s]
            terms = [(w, ps[s][w] - q[w]) for w in kept if count[s][w] and ps[s][w] > q[w]]
            for part, got, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(got, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(order, 1)]
    return sorted(out)


def corpus(seed=5):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["en", "en", "de", None, ""]), f"s{min(rnd.randrange(12), rnd.randrange(12))}", t) for t in documents(seed, 60)]
    rows += [("en", f"s{i % 9}", sentence(rnd, 30, invent=0.2)) for i in range(60)]
    rows += [("fr", "only", "a a b"), ("fr", "none", None), ("fr", "none", ""), ("it", "single", "uno uno"), ("en", None, "the of"), ("en", "s1", "The ÉCOLE école naïve")]
    return rows + rows[:7]


def audit(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    return sorted(tuple(r) for r in divergence.divergence(df, **more).collect())


def test_audit_equals_brute_force(spark):
    rows = corpus()
    for least, top in ((1, 3), (6, 50)):
        assert audit(spark, rows, least_docs=least, top=top) == expected(rows, least, top)


def test_no_kept_terms_and_empty_table(spark):
    rows = [("en", "a", "x"), ("en", "b", None)]
    assert audit(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)] == expected(rows, 30, 50)
    assert audit(spark, []) == []


def test_clashing_columns(spark):
    extra = CLASHING + ", lang string, source string, term string, df long, s int, p long, zero long, path string"
    row = dict.fromkeys([c.split()[0] for c in extra.split(", ")]) | {"lang": "en", "source": "a", "text": "x y x"}
    df = spark.createDataFrame([row, row | {"source": "b", "text": "y"}], extra)
    got = sorted(tuple(r) for r in divergence.divergence(df, least_docs=1).collect())
    assert got == expected([("en", "a", "x y x"), ("en", "b", "y")], 1, 50)


def test_terms_are_cut_alike_by_blocks(monkeypatch):
    text = " ".join(t or "" for t in documents(2, 10))
    whole = [w for part in divergence._terms(text.encode().lower()) for w in part]
    monkeypatch.setattr(divergence, "_BLOCK", 7)
    assert [w for part in divergence._terms(text.encode().lower()) for w in part] == whole
    assert [w.decode() for w in whole] == TERM.findall(text.translate(LOWER))


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(divergence, "_HELD", 50)
    rows = corpus()
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in rows]) for k in range(3)], names=["lang", "source", "text"])
    n, df, groups = Counter(), Counter(), set()
    for b in divergence._count([batch, batch]):
        for r in b.to_pylist():
            if r["term"] is None:
                groups.add((r["lang"], r["source"]))
            else:
                n[r["lang"], r["source"], r["term"]] += r["n"]
                df[r["lang"], r["source"], r["term"]] += r["df"]
    want_n, want_df = Counter(), Counter()
    for a, b, t in rows * 2:
        ws = TERM.findall((t or "").translate(LOWER))
        want_n.update((a or "", b or "", w) for w in ws)
        want_df.update((a or "", b or "", w) for w in set(ws))
    assert (n, df, groups) == (want_n, want_df, {(a or "", b or "") for a, b, _ in rows})


def test_tree_shares_paths_and_sums_alike_in_parts(monkeypatch):
    rnd = random.Random(1)
    zero = [rnd.randrange(50) for _ in range(30)]
    rows = Counter(tuple((s, rnd.choice([60, 70])) for s in sorted(rnd.sample(range(30), rnd.randint(0, 6)))) for _ in range(2000))
    want = Counter()
    for row, times in rows.items():
        for j, (b, q) in enumerate(row):
            for a, p in row[:j]:
                want[a, b] += times * (abs(p - q) - abs(p - zero[b]) - abs(zero[a] - q) + abs(zero[a] - zero[b]))

    def grow(part):
        tree = divergence.Tree()
        for row in sorted(part):
            s, p = (np.array([x[k] for x in row], np.int64) for k in (0, 1))
            tree.insert(s, p, np.array([zero[x] for x in s], np.int64), part[row])
        tree.close(0)
        keys, sums = tree.take()
        return Counter({(int(k) >> 32, int(k) & 0xFFFFFFFF): int(v) for k, v in zip(keys, sums, strict=True)})
    strip = lambda c: {k: v for k, v in c.items() if v}
    assert strip(grow(rows)) == strip(want)
    order = sorted(rows)
    cut = len(order) // 3
    total = Counter()
    for part in (order[:cut], order[cut:]):
        for k, v in grow({r: rows[r] for r in part}).items():
            total[k] += v
    assert strip(total) == strip(want)
    monkeypatch.setattr(divergence, "_HELD", 8)     # blocks of a node, many combinations
    assert strip(grow(rows)) == strip(want)
