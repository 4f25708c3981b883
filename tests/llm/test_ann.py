"""Nearest neighbours against all distances."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import ann


def brute(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in fine:
        if q % 100 == 0:
            got = sorted((float(ann.exact_distances(x[None], y[None])[0]), i) for i, y in fine if i != q and len(y) == len(x))
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(got[:k])]
    return sorted(out)


@pytest.mark.parametrize("tile,query_tile,group", [(7, 3, 2), (2048, 512, 16)])
def test_nearest(spark, monkeypatch, tile, query_tile, group):
    for name, v in (("TILE", tile), ("QUERY_TILE", query_tile), ("TILES_PER_GROUP", group)):
        monkeypatch.setattr(ann, name, v)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(320)]
    rows += [(1000 + i, rows[3][1]) for i in range(14)] + [(i, rows[0][1]) for i in (400, 401, 500)]   # ties
    rows += [(600, [1e4] * 16), (601, [1e4 + 1] * 16), (602, [1e-8] * 16), (700, [1.0, 2.0]), (701, [1.0, 2.5])]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [None] + [1.0] * 15), (900, [float("nan")] + [1.0] * 15),
             (901, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, grp int, score int, tile int")
    got = ann.nearest(df, df.filter(F.col("vec_id") % 100 == 0))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10)
    assert ann.nearest(df.limit(0), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    (cx, sx), (cy, sy) = ann.quantise(x), ann.quantise(y)
    dots = (cx.astype(float) @ cy.T.astype(float)) * sx[:, :1] * sy[:, 0]
    assert (np.abs(dots - x @ y.T) <= sx[:, 3:4] * sy[:, 2] + sx[:, 1:2] * sy[:, 3]).all()


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    want = con.sql(f"select query_id, rank, vec_id, score from ({ann.OP10_SQL}) order by all").fetchall()
    assert sorted(tuple(r) for r in ann.op10_ann(spark, sf).collect()) == want


def test_whole_range_of_doubles(spark):
    import math
    rng = np.random.default_rng(2)
    some = [10.0 ** e * rng.normal(size=8) for e in (160, 160, 160, 200, 300, -160, -160, -200, -300, -310, 0, 0, 5, 140, -140)]
    rows = [(100 * i, v.tolist()) for i, v in enumerate(some)] + [(1, [5e-324] + [0.0] * 7), (2, [1e-323] + [0.0] * 7), (3, some[0].tolist()), (4, [1.7e308] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in ann.nearest(df, df.filter(F.col("vec_id") % 100 == 0), k=50).collect()}
    want = {(q, i): math.dist(x, y) for q, x in rows for i, y in rows if q % 100 == 0 and i != q}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) or (math.isinf(got[k]) and want[k] > 1e308) for k in want)
    few = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, df.filter("vec_id = 500"), k=3).collect())
    near = sorted((d, i) for (q, i), d in want.items() if q == 500)[:3]
    assert [i for _, _, i in few] == [i for _, i in near]
