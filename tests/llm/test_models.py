"""Language model, language identification, quality rules and classifier."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHING, DE, EN, documents, frame, remainder, sentence, words
from pyspark.sql import functions as F

from codelake.llm import classifier, common, langid, maxent, rules, tokens

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------- shared hashing

def test_word_hashes_tell_words_apart():
    texts = documents()
    h, first = common.word_hashes(pa.array(texts))
    flat = [w for t in texts for w in words(t)]
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    assert len({(w, x) for w, x in zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


# -------------------------------------------------------------- language model

def unigram(rows):
    counts = Counter(w for i, t in rows if i is not None and remainder(i, 10) for w in [*words(t), None])
    total = sum(counts.values())
    return counts, total, total + 0.1 * (len(counts) + 1)


@pytest.mark.parametrize("heavy", [1 << 20, 64])
def test_counts_and_base_scores(spark, monkeypatch, heavy):
    monkeypatch.setattr(maxent, "HEAVY", heavy)
    monkeypatch.setattr(maxent, "SHARD_TOKENS", 500)
    rows = list(enumerate(documents(4, 40))) + [(None, "a b"), (3, "of the of the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts, total, scale = unigram(rows)
    got = maxent.lm_scores(df, df.filter(common.id_remainder(F.col("doc_id"), 10) != 0)).collect()
    key = lambda i, n: (-1 if i is None else i, n)
    mine = sorted((key(i, len(words(t)) + 1), t) for i, t in rows)
    for r, (k, t) in zip(sorted(got, key=lambda r: key(r.doc_id, r.n_tokens)), mine, strict=True):
        w = [*words(t), None]
        assert (key(r.doc_id, r.n_tokens), r.n_known, r.train_tokens) == (k, sum(x in counts for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / scale) for x in w), rel=1e-9)
        assert r.score < 0


def counted(texts, head):
    """Tokens of the texts and their counts; the ``head`` most frequent ones have leaves of their own."""
    t, suffix, first = maxent.tokens(pa.array(texts))
    u, at, n = np.unique(t, return_index=True, return_counts=True)
    top = np.lexsort((u, -n))[:head]
    by = np.argsort(u[top])
    digits = 8
    leaf = suffix[at] * digits + (u % np.uint64(digits)).astype(int)
    rest = np.setdiff1d(np.arange(len(u)), top)
    leaf_n, leaf_v = (np.bincount(leaf[rest], x, maxent.SUFFIX_CLASSES * digits) for x in (n[rest], np.ones(len(rest))))
    return t, suffix, first, maxent.Counts(len(t), len(u), u, n, u[top][by], by, n[top], leaf_n, leaf_v)


def small(monkeypatch):
    monkeypatch.setattr(maxent, "WEIGHTS", 16)
    monkeypatch.setattr(maxent, "CONTEXTS", 12)
    monkeypatch.setattr(maxent, "BLOCK", 1 << 10)


def test_probabilities_sum_to_one(monkeypatch):
    small(monkeypatch)
    rnd = random.Random(0)
    t, suffix, first, counts = counted([" ".join(rnd.choice(["a b", "c d", "e f g", "une deux"]) for _ in range(2000))], 5)
    learner, targets = maxent.Learner(counts), maxent._targets(counts, t, suffix)
    h, context = maxent.history(t, first)
    before = maxent.Model(counts).log_probability((h, context), *targets).mean()
    learner.learn((h, context), *targets)
    model = maxent.Model(counts, *learner.result())
    assert model.log_probability((h, context), *targets).mean() > before + 0.5
    symbols = np.concatenate([np.arange(5), np.repeat(5 + np.arange(maxent.SUFFIX_CLASSES), counts.digits)])
    digits = np.concatenate([np.zeros(5, int), np.tile(np.arange(counts.digits), maxent.SUFFIX_CLASSES)])
    for i in (0, 1, 2, 700):
        same = np.full(len(symbols), i)
        for m in (model, maxent.Model(counts)):
            assert np.exp(m.log_probability((h[same], context[same]), symbols, digits)).sum() == pytest.approx(1, abs=1e-4)
    # without a history the splits give the counts
    share = np.concatenate([counts.rank_n + maxent.ADD, counts.leaf_share()])
    p = np.exp(maxent.Model(counts).log_probability((h[np.zeros(len(symbols), int)], context[np.zeros(len(symbols), int)]), symbols, digits))
    assert np.allclose(p, share / share.sum(), rtol=1e-3)


def test_learning_equals_brute_force(monkeypatch):
    small(monkeypatch)
    monkeypatch.setattr(maxent, "BATCH", 7)
    monkeypatch.setattr(maxent, "ADMIT", [(0.002, 0), (0.004, 1), (1.0, 2)])
    rnd = random.Random(1)
    t, suffix, first, counts = counted([sentence(rnd, 150, invent=0.2) for _ in range(3)], 9)
    symbol, digit = maxent._targets(counts, t, suffix)
    h, context = maxent.history(t, first)
    learner = maxent.Learner(counts)
    learner.learn((h, context), symbol, digit)
    tree, size = learner.tree, 1 << maxent.WEIGHTS

    low = (1 << maxent.LEVELS) - 1

    def place(x, node):
        x = (int(x) + (int(tree.key[node]) | low)) * 0x9E3779B1 % 2**32
        x ^= x >> 15
        return (x * 0x85EBCA77 % 2**32 >> 32 - maxent.WEIGHTS + maxent.LEVELS) << maxent.LEVELS | int(tree.key[node]) & low

    def steps(i):
        leaf = symbol[i] if symbol[i] < tree.head else tree.head + (symbol[i] - tree.head) * tree.digits + digit[i]
        return [(int(x) >> 1, int(x) & 1) for x in tree.steps[tree.first[leaf]:tree.first[leaf] + tree.size[leaf]]]
    # hash bits split below the suffix class, from the lowest on
    tail = next(i for i in range(len(t)) if symbol[i] >= tree.head)
    assert [b for _, b in steps(tail)[-tree.bits:]] == [int(digit[tail]) >> d & 1 for d in range(tree.bits)]
    w, power, seen = Counter(), Counter(), Counter()
    for step, lo in enumerate(range(0, len(t), 7)):
        if step % 64 == 0:
            need = next(n for share, n in maxent.ADMIT if np.mean([power[x] > 0 for x in range(0, size, 97)]) <= share)
        todo, now = [], dict(seen)
        for i in range(lo, min(lo + 7, len(t))):
            on = [k for k in range(4) if now.get((k, context[i, k]), 0) >= need]
            for node, bit in steps(i):
                z = float(tree.odds[node]) + sum(w[place(h[i, k], node)] for k in on)
                todo.append((on, i, node, bit - 1 / (1 + math.exp(-z))))
        for k in range(4):
            for x in {context[i, k] for i in range(lo, min(lo + 7, len(t)))}:
                seen[k, x] += 1
            mine = [(place(h[i, k], node), g) for on, i, node, g in todo if k in on]
            for x, g in mine:
                power[x] += g * g
            for x, g in mine:
                w[x] += maxent.RATE * g / math.sqrt(power[x] + maxent.DAMP)
    assert need > 0
    assert np.allclose(learner.table[::2], [w[x] for x in range(size)], atol=1e-3)
    assert np.allclose(learner.table[1::2], [power[x] for x in range(size)], atol=1e-3)
    # and scoring: every step of every token, one after the other
    weights, bits = learner.result()
    admitted = np.unpackbits(bits).reshape(4, -1)
    got = maxent.Model(counts, weights, bits).log_probability((h, context), symbol, digit)
    for i in range(len(t)):
        on = [k for k in range(4) if admitted[k, context[i, k]]]
        want = 0.0
        for node, bit in steps(i):
            z = float(tree.odds[node]) + sum(float(weights[place(h[i, k], node)]) for k in on)
            want -= math.log1p(math.exp(-z if bit else z))
        assert got[i] == pytest.approx(want, abs=1e-3)


def test_learners_are_averaged_where_they_touched(monkeypatch):
    small(monkeypatch)
    n = maxent.BLOCK
    one, two = np.zeros((2, n), np.float16)
    one[:3], two[1:4] = [1, 2, 3], [4, -2, 5]
    table = lambda rows: pa.Table.from_batches([maxent._blocks(rows)])
    key = (pa.scalar(0), pa.scalar(0))
    half = [maxent._add_blocks(False)(key, table([(0, 0, i, x.tobytes(), None)])) for i, x in enumerate((one, two))]
    got = maxent._add_blocks(True)(key, pa.concat_tables(half)).to_pylist()[0]
    assert np.frombuffer(got["value"], np.float16)[:5].tolist() == [1, 3, 0.5, 5, 0]
    bits = maxent._add_blocks(True)((pa.scalar(1), pa.scalar(0)), table([(1, 0, 0, b"\x05\x00", None), (1, 0, 1, b"\x01\x80", None)])).to_pylist()[0]
    assert bits["value"] == b"\x05\x80"


def test_counts_and_ranks_are_found_by_hash():
    keys = common.mix64(np.arange(5000, dtype=np.uint64))
    keys[:300] = np.arange(300, dtype=np.uint64)        # all in one slot
    order = np.sort(keys)
    n = np.arange(5000) + 1
    counts = maxent.Counts(1, 1, order, n, order[::50], np.arange(100), n[::50])
    count, rank = counts.find(np.concatenate([order, order + np.uint64(1)]))
    known = dict(zip(order.tolist(), n.tolist(), strict=True))
    assert count.tolist() == [known.get(int(k), 0) for k in np.concatenate([order, order + np.uint64(1)])]
    assert rank[:5000].tolist() == [i // 50 if i % 50 == 0 else -1 for i in range(5000)]
    assert counts.find(order[:0])[0].tolist() == [] and maxent.Counts(0, 0, order[:0], n[:0], order[:0], n[:0], n[:0]).find(order[:2])[1].tolist() == [-1, -1]


def test_tokens_outside_the_head_depend_on_their_history(monkeypatch):
    small(monkeypatch)
    t, suffix, first, counts = counted(["one xa1zz", "two ya2zz"] * 2000, 1)
    symbol, digit = maxent._targets(counts, t, suffix)
    assert suffix[1] == suffix[4] and t[1] != t[4]
    learner, (h, context) = maxent.Learner(counts), maxent.history(t, first)
    learner.learn((h, context), symbol, digit)
    model = maxent.Model(counts, *learner.result())
    # the same token where it was learned, and after the word that has the other
    here, there = model.log_probability((h[[1, 4]], context[[1, 4]]), symbol[[1, 1]], digit[[1, 1]])
    assert here > there + 0.5


def test_held_out_scores_beat_the_base(spark):
    df = maxent.op4_lm_score(spark, SF)
    r = df.filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert (r.s - r.b) / r.n > 0.66
    assert df.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_language_model_of_empty_tables(spark):
    df = frame(spark, ["a b", None])
    assert maxent.lm_scores(df.limit(0), df).count() == 0
    none = maxent.lm_scores(df, df.limit(0)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(none, key=lambda r: r.doc_id)] == [(3, 0, 0), (1, 0, 0)]


# --------------------------------------------------------------- language id

def test_forward_sums_all_segmentations():
    v = langid.pieces(tokens.tokenizer_path(langid.VOCABULARY))
    index = {p: i for i, p in enumerate(v.names)}
    table = langid.start_table(len(v), 3) * np.array([1, 0.5, 2.0])

    def brute(u):
        if not u:
            return np.ones(3)
        total = np.zeros(3)
        for k in range(1, len(u) + 1):      # every piece, however long
            i = index.get(u[:k], len(v) if k == 1 else None)
            if i is not None:
                total += table[i] * brute(u[k:])
        return total
    some = ["the", "läßt", "x日本", "a\0b", "'s", "###", "zzz", "information", "_function", "differentially"]
    assert v.longest > 8 and langid.MARK + "information" in index
    for w, got in zip(some, langid.log_probabilities(some, v, table), strict=True):
        assert np.allclose(np.log(brute(langid.MARK + w)), got)


def test_long_words_are_summed_whole():
    from decimal import Decimal
    v = langid.pieces(tokens.tokenizer_path(langid.VOCABULARY))
    index = {p: i for i, p in enumerate(v.names)}
    table = langid.start_table(len(v), 2) * np.array([1.0, 1e-9])     # as small as in a huge corpus
    for word in ("internationalization" * 5, "日本語の文章" * 20, "q" * 700):
        u = langid.MARK + word
        want = []
        for lang in (0, 1):
            sums = [Decimal(1)]
            for e in range(1, len(u) + 1):
                ids = ((k, index.get(u[e - k:e], len(v) if k == 1 else None)) for k in range(1, min(v.longest, e) + 1))
                sums.append(sum(sums[e - k] * Decimal(float(table[i, lang])) for k, i in ids if i is not None))
            want.append(float(sums[-1].ln()))
        assert np.allclose(langid.log_probabilities([word], v, table)[0], want)
        got = langid.expected_counts([word], np.array([1]), np.array([2.0]), v, table)
        sizes = np.array([len(p) for p in v.names] + [1, 0])
        assert (got.sum(axis=1) * sizes).sum() == pytest.approx(2 * len(u))


def test_only_letters_make_a_language(spark):
    model = langid.train_languages(spark.createDataFrame([("en", "the cat"), ("de", "die katze")], "lang string, text string"),
                                   tokens.tokenizer_path(langid.VOCABULARY))
    got = langid.identify(frame(spark, ["² ½ ①", "12 _ ٣", "die", None]), model, tokens.tokenizer_path(langid.VOCABULARY))
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["und", "und", "de", "und"]


def test_foreign_and_gibberish_texts_are_rejected(spark):
    path = tokens.tokenizer_path(langid.VOCABULARY)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    learned = langid.training(docs)
    model = langid.train_languages(learned, path)
    least = langid.floors(learned, model, path)
    assert set(least) == set(model[0])
    rnd = random.Random(5)
    foreign = ["これは日本語で書かれた文章です。東京は日本の首都であり、多くの人が住んでいます。" * 3, "Это предложение написано на русском языке и его нельзя принять. " * 3,
               "Αυτό το κείμενο είναι γραμμένο στα ελληνικά και όχι σε άλλη γλώσσα. " * 3,
               " ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(12)) for _ in range(60)), "qxzj" * 300]
    planted = spark.createDataFrame([(-1 - i, "en", t) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in langid.keep_identified(docs.unionByName(planted), model, path, least_rates=least).collect()}
    assert not any(i < 0 for i in kept)
    assert len(kept) >= 0.99 * docs.count()


def test_a_column_of_too_many_languages_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    df = spark.createDataFrame([(f"l{i}", "a") for i in range(4)], "lang string, text string")
    with pytest.raises(ValueError):
        langid.train_languages(df, tokens.tokenizer_path(langid.VOCABULARY))


def test_expected_counts_add_up():
    v = langid.pieces(tokens.tokenizer_path(langid.VOCABULARY))
    table = langid.start_table(len(v), 2)
    some = ["then", "unter", "q" * 50]
    got = langid.expected_counts(some, np.array([0, 1, 1]), np.array([3.0, 2.0, 1.0]), v, table)
    sizes = np.array([len(p) for p in v.names] + [1, 0])
    # every character of a word lies in one piece of each segmentation
    assert np.allclose((got * sizes[:, None]).sum(axis=0), [3 * 5, 2 * 6 + 51])


def test_languages_of_held_out_texts(spark):
    rnd = random.Random(1)
    rows = [(i, sentence(rnd, 40, EN if i % 2 else DE, 0.2), "en" if i % 2 else "de", *([None] * 10)) for i in range(200)]
    rows += [(900, None, "en"), (901, "12 + 34 !!", "en"), (902, "", None), (903, "THE END OF IT " * 9, None), (904, "der und die " * 3000, None),
             (905, "w" * 3000 + " the of and", None)]
    rows = [(*r, *([None] * (13 - len(r)))) for r in rows]
    ddl = CLASHING.replace("n long", "lang string")
    df = spark.createDataFrame(rows, ddl)
    path = tokens.tokenizer_path(langid.VOCABULARY)
    model = langid.train_languages(langid.training(df), path)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model, path).collect()}
    right = [got[r[0]][0] == r[2] for r in rows[:200] if remainder(r[0], 3) == 1]
    assert sum(right) >= 0.97 * len(right) and all(0 <= s <= 1 for _, s in got.values())
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en" and got[904][0] == "de"
    kept = langid.keep_identified(df, model, path)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, (p, s) in got.items() if p != "und" and s >= 0.5}
    assert langid.identify(df.limit(0), model, path).count() == 0
    untaught = langid.train_languages(df.limit(0), path)
    assert {r.lang_pred for r in langid.identify(df, untaught, path).collect()} == {"und"}


def test_language_id_query(spark):
    df = langid.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = df.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.a > 0.97 and r.n > 200


# --------------------------------------------------------------- quality rules

def base_rules(text):
    text = text or ""
    w = __import__("helpers").WORD.findall(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    n, rep = len(w), len(covered)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n)


def test_base_rules(spark):
    rnd = random.Random(8)
    texts = documents(9, 30) + ["\n".join(rnd.choice(["a b", "a b ", "", "  ", "c"]) for _ in range(60)) for _ in range(5)]
    texts += [" ".join(rnd.choice("abc") for _ in range(k)) for k in (2, 3, 4, 30, 120)] + ["# * $ % & | < > é"]
    df = frame(spark, texts)
    for r in rules.quality_rules(df, df.filter("doc_id < 20")).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == base_rules(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed and r.score >= rules.THRESHOLD)


def test_windows_of_equal_hash_bits_are_no_repeats(spark):
    # these two windows agree in the 44 bits that a text of this length leaves
    text = " ".join(["a4236559 b c", *map(str, range(530_000)), "a4779771 b c"])
    df = frame(spark, [text, text + " 7 8 9"])
    got = {r.doc_id: r.n_repeat_words for r in rules.quality_rules(df, df.limit(0)).collect()}
    assert got == {0: 0, 1: 6}


def test_ratios_tell_trusted_text_from_junk(spark):
    rnd = random.Random(2)
    texts = [sentence(rnd, 120, invent=0.1) for _ in range(900)] + [sentence(rnd, 120, [w.upper() + "!!" for w in EN], 0.1) for _ in range(150)]
    df = frame(spark, texts)
    got = {r.doc_id: r.kept for r in rules.quality_rules(df, df.filter("doc_id % 2 = 0 and doc_id < 900")).collect()}
    assert all(got[i] for i in range(900)) and not any(got[i] for i in range(900, 1050))


def test_every_trusted_document_is_counted(spark):
    n, names = 70_000, [f"w{k}" for k in range(7)]
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 7).alias("text"))
    buckets = {r.b for r in spark.createDataFrame([(x,) for x in names], "x string").select(rules._bucket(F.col("x")).alias("b")).collect()}
    assert len(buckets) == 7
    smooth, raw = rules.SMOOTHING * rules.BUCKETS, (n / 7 + 1) / (n + rules.BUCKETS)
    want = math.log((n / 7 + smooth * raw) / (n + smooth) / raw)
    got = {r.bucket: r.ratio for r in rules.log_ratios(df, df.select("doc_id")).collect()}
    assert all(got[b] == pytest.approx(want, rel=1e-9) for b in buckets)


def test_quality_rules_odd_tables(spark):
    df = spark.createDataFrame([(1, None, *([None] * 11)), (None, "a b", *([None] * 11)), (1, None, *([None] * 11))], CLASHING)
    got = rules.quality_rules(df, df.limit(0).select("doc_id")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.score, r.kept) for r in got) == [(0, 2, 0.0, False), (1, 0, 0.0, False), (1, 0, 0.0, False)]
    assert rules.quality_rules(df.limit(0), df.select("doc_id")).count() == 0


# ------------------------------------------------------------------ classifier

def test_non_negative_risk_learns_without_negatives():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1.5, 1, (600, 2)), rng.normal(-1.5, 1, (200, 2))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (600, 2)), neg])
    add = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = classifier.fit(add(pos), add(unlabelled), 0.75)
    assert ((add(unlabelled) @ w > 0) == (np.arange(800) < 600)).mean() > 0.95


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(1)
    add = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float32)
    for share in (0.3, 0.75, 0.95):
        n = int(2000 * share)
        unlabelled = rng.permutation(np.concatenate([rng.normal(1.5, 1, (n, 2)), rng.normal(-1.5, 1, (2000 - n, 2))]))
        assert classifier.estimate_prior(add(rng.normal(1.5, 1, (1000, 2))), add(unlabelled), 100) == pytest.approx(share, abs=0.04)


def test_scores_equal_brute_force():
    texts = [t or "" for t in documents(8, 12)] + ["HELLO World!! aa aa aa x1.", "# * $ ;", "a b a b a b"]
    rng = np.random.default_rng(3)
    edges = np.sort(rng.random((classifier.BINS - 1, classifier.STATS)), axis=0)
    w = rng.normal(size=classifier.STATS * classifier.BINS + classifier.HASHED + 1)
    symbols = {chr(b) for b in range(33, 127) if not chr(b).isalnum()} - set(".,;:'\"?-()")
    got = classifier.text_scores(pa.array(texts), (edges, w))
    for text, score in zip(texts, got, strict=True):
        raw = re.findall("[^\x20\x09-\x0d]+", text)
        low, n = words(text), max(1, len(raw))
        data = text.encode()
        per_byte = lambda f: sum(f(b) for b in data) / max(1, len(data))  # noqa: B023, E731
        mean = lambda f: sum(map(f, raw)) / n  # noqa: B023, E731
        size = lambda x: len(x.encode())
        again = sum((i > 0 and low[i - 1] == x) + (i > 1 and low[i - 2] == x) for i, x in enumerate(low))
        counts = Counter(low)
        stats = [math.log1p(len(raw)), mean(size), mean(lambda x: size(x) > 15), per_byte(lambda b: 65 <= b <= 90), per_byte(lambda b: 48 <= b <= 57),
                 per_byte(lambda b: chr(b) in symbols), mean(lambda x: x[-1] in symbols), mean(lambda x: x[-1] in ".,;:?"),
                 mean(lambda x: sum("A" <= c <= "Z" for c in x) >= 2), again / n, len(counts) / n / max(1, math.log10(max(n, 10))),
                 max(counts.values(), default=0) / n]
        z = w[-1] + sum(w[j * classifier.BINS + sum(e < x for e in edges[:, j])] for j, x in enumerate(stats))
        h, _ = common.word_hashes(pa.array([text]))
        z += sum(4 * w[classifier.STATS * classifier.BINS + int(x) % classifier.HASHED] for x in h) / n
        assert score == pytest.approx(1 / (1 + math.exp(-min(35, max(-35, z)))), abs=1e-4)


def test_prior_is_near_the_share_of_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edges = classifier.bin_edges(texts)
    at = lambda ids: classifier.design(*classifier.features(pa.array([r.text for r in texts.join(ids, "doc_id").orderBy("doc_id").collect()])), edges)
    got = classifier.estimate_prior(at(labels.filter("quality = 1").select("doc_id")), at(texts.select("doc_id")))
    assert got == pytest.approx(labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0], abs=0.06)


def test_quality_query_on_held_out_labels(spark):
    df = classifier.op7_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    r = df.groupBy("quality").agg(F.avg("predicted").alias("p"), F.avg("score").alias("s")).collect()
    by = {x.quality: x for x in r}
    assert by[1].p > 0.97 and by[0].p < 0.35 and by[1].s > by[0].s + 0.4


def test_classifier_odd_tables(spark):
    rows = [(i, t, *([None] * 11)) for i, t in enumerate(documents(2, 10))] + [(None, "a b", *([None] * 11))]
    df = spark.createDataFrame(rows, CLASHING)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 20, 2)] + [(None, 1), (3, None), (0, 1)], "doc_id long, quality int")
    model = classifier.train(df, labels)
    got = classifier.classify(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = classifier.keep_quality(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in got)
    none = classifier.train(df, labels.limit(0))
    assert {r.score for r in classifier.classify(df, none).collect()} == {0.5}
    assert classifier.classify(df.limit(0), model).count() == 0
