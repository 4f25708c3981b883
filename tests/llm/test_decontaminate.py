"""Positional index search against lists of words."""

import hashlib
import random
import re

import pytest
from helpers import CLASHING, LOWER, documents, sentence

from codelake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def item_windows(items, width):
    out = {}
    for i, t in items:
        w = cut(t)
        for at in range(max(1, len(w) - width + 1)):
            if w:
                out.setdefault(tuple(w[at:at + width]), set()).add(i)
    return out


def expected(text, windows):
    w = cut(text)
    hit, items = set(), set()
    for k in {len(x) for x in windows}:
        for at in range(len(w) - k + 1):
            owners = windows.get(tuple(w[at:at + k]))
            if owners is not None:
                hit |= set(range(at, at + k))
                items |= {str(i) for i in owners if i is not None}
    return len(w), len(hit), sorted(items)


def corpus(seed=3):
    rnd = random.Random(seed)
    texts = documents(seed, 30)
    items = [(i, sentence(rnd, rnd.choice([1, 2, 3, 9, 10, 11, 30]), invent=0.5)) for i in range(30)]
    items += [(30, None), (31, ""), (32, " ,.; "), (33, "the the the the the the the the the the the the"), (34, items[3][1].upper()), (None, items[4][1]),
              (5, "Zwölf Größen—ÉCOLE 日本 語"), (5, "another text under the same id")]
    for _ in range(40):  # passages, whole and broken, in different surroundings
        t = rnd.choice(items)[1] or ""
        w = t.split(" ")
        if rnd.random() < 0.4 and len(w) > 4:
            w[rnd.randrange(len(w))] = "broken"
        texts.append(f"{sentence(rnd, rnd.randint(0, 40))}{rnd.choice([' ', '... ', chr(10)])}{rnd.choice([' ', ', ']).join(w)} {sentence(rnd, rnd.randint(0, 40))}")
    texts += ["the " * 50, "((the)) the", texts[-1], texts[-1]] + [(items[3][1] + " ") * 20]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (3, texts[-2]), (3, texts[-2])], items


def found(spark, rows, items, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), **more).collect()


@pytest.mark.parametrize("width", [10, 4])
def test_hits_equal_brute_force(spark, width):
    rows, items = corpus()
    windows = item_windows(items, width)
    want = sorted((-1 if i is None else i, *expected(t, windows)) for i, t in rows)
    got = found(spark, rows, items, window=width, slop=0)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.items) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r.items) and r.n_near == 0 for r in got)
    assert sum(w[2] > 0 for w in want) > 10


def test_proximity_finds_displaced_words(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = item.split(" ")
    swapped = " ".join([*w[:4], w[5], w[4], *w[6:]])        # each one place off
    shifted = " ".join([*w[:5], "new", *w[5:]])             # half of them one place off
    far = " ".join([*w[:5], "new", "new", "new", *w[5:]])
    got = found(spark, list(enumerate([item, swapped, shifted, far, "alpha beta"])), [(7, item)], slop=1)
    assert [(r.n_hit, r.n_near > 0) for r in sorted(got)] == [(10, False), (0, True), (0, True), (0, False), (0, False)]
    assert all(r.n_near == 0 for r in found(spark, list(enumerate([swapped, shifted])), [(7, item)], slop=0))


def test_empty_tables_and_clashing_columns(spark):
    rows, items = [(1, "a b c"), (2, None)], [(1, "b c")]
    assert found(spark, [], items) == []
    assert [(r.doc_id, r.n_words, r.n_hit, r.items) for r in sorted(found(spark, rows, []))] == [(1, 3, 0, []), (2, 0, 0, [])]
    extra = CLASHING + ", pos int, window long, start long, exact boolean, terms string, words string, item_id long"
    n = len(extra.split(","))
    docs = spark.createDataFrame([(1, "a b c", *[None] * (n - 2))], extra)
    item = spark.createDataFrame([(1, "b c", None, None)], "item_id long, text string, words string, window long")
    assert [(r.doc_id, r.n_hit, r.items) for r in decontaminate.decontaminate(docs, item).collect()] == [(1, 2, ["1"])]
    names = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    assert decontaminate.decontaminate(names, item).first().doc_id == "x"


def test_query_has_no_python_in_its_plan(spark):
    got = decontaminate.op11_decontaminate(spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("InArrow", "Python", "InPandas"))
    assert {r.items_sha256 for r in got.filter("n_items = 0").collect()} <= {hashlib.sha256(b"").hexdigest()}
