"""Near-duplicates against all pairs of full sets."""

import duckdb
import pytest
from helpers import CLASHING, documents, frame, words

from codelake.llm import minhash


def brute(rows, percent):
    def shingles(t):
        w = words(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    sets = [shingles(t) for _, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            s = len(sets[a] & sets[b])
            if s and 100 * s >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(rows[a][0]), top(rows[b][0])))
                up[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for (i, _), s in zip(rows, sets, strict=True))


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


@pytest.mark.parametrize("percent", [80, 85])
def test_components_are_those_of_all_pairs(spark, percent):
    texts = documents()
    rows = list(enumerate(texts))
    assert result(minhash.near_duplicates(frame(spark, texts), percent)) == brute(rows, percent)


def test_further_centres_and_all_open_pairs_give_the_same(spark):
    texts = documents(3)
    got = [result(minhash.near_duplicates(frame(spark, texts), 85, star_rounds=r, pairs_per_row=p)) for r, p in ((2, 0), (0, 256))]
    assert got[0] == got[1] == brute(list(enumerate(texts)), 85)


def test_nulls_repeated_rows_empty_table_and_clashing_columns(spark):
    texts = ["a b c d e f", "a b c d e f", None, "", "q r s"]
    rows = [(i, t, *([None] * 11)) for i, t in enumerate(texts)] + [(None, "a b c d e f", *([None] * 11)), (1, "a b c d e f", *([None] * 11))]
    df = spark.createDataFrame(rows, CLASHING)
    got = [tuple(r) for r in minhash.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False), (2, 0, 2, True), (3, 0, 3, True),
                                           (4, 1, 4, True), (None, 2, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    stay = sorted(r.doc_id for r in minhash.one_of_each(df.filter("doc_id is not null")).collect())
    assert stay == [0, 2, 3, 4]
    assert minhash.one_of_each(df).columns == df.columns


def test_estimate_is_near_the_similarity():
    import numpy as np
    s = minhash.stream64(1, 3000)
    for k in (0, 500, 900):
        a, b = s[:1000], s[1000 - k:2000 - k]
        true = k / (2000 - k)
        pa, pb = (minhash.pack_bits(minhash.minima(np.sort(x))[None])[0] for x in (a, b))
        x = pa ^ pb
        differ = sum(bin(int((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555))).count("1") for v in x)
        assert abs(((1 - differ / minhash.PERMS) - 0.25) / 0.75 - true) < 0.2


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.sql(f"select doc_id, n_shingles, component_id, kept from ({minhash.OP1_SQL}) order by all").fetchall()
    assert result(minhash.op1_minhash(spark, sf)) == want
