"""Nearest neighbours of a stated query set by a block matrix join.

Vectors are cut into tiles (rows of int8 codes with a scale, plus the exact
norms, quantisation errors and original values).  Every query tile meets every
tile of all rows once, by an equi-join on a group number: the int8 product of
two tiles gives all its distances with a proven error bound, the pairs whose
lower bound may still enter the best k are recomputed in double precision, and
bounded heaps merge the results of the tiles.

The work is queries x rows by definition of an exact search; memory per task
is one pair of tiles and k results per query.  Executors share nothing but the
shuffled tiles, so a lost one only repeats its own pairs.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm.common import read, small_batches, stage

TILE = 2048          # vectors in a tile
QUERY_TILE = 512
TILES_PER_GROUP = 16  # tiles of either side in a cell of the block matrix
SURVIVORS = 1 << 16  # pairs recomputed at once
SMALL, LARGE = 1e-140, 1e140  # magnitudes whose squares are safe

_TILE_DDL = "tile long, dim int, ids binary, vectors binary, codes binary, stats binary"
_TILE_SCHEMA = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()),
                          ("codes", pa.binary()), ("stats", pa.binary())])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of the rows of ``x`` and, per row: scale, norm of the coded
    row, norm of the row, norm of the coding error (rounded up)."""
    most = np.abs(x).max(axis=1)
    # of squares that may over- or underflow nothing is known: the error is inf
    wild = (most > LARGE) | (most < SMALL)
    x = np.where(wild[:, None], 0.0, x)
    scale = np.where(wild, 1.0, most / 127.0)
    codes = np.rint(x / scale[:, None])
    coded = codes * scale[:, None]
    stats = np.stack([scale, np.linalg.norm(coded, axis=1), np.linalg.norm(x, axis=1),
                      np.linalg.norm(x - coded, axis=1) * (1 + 1e-9) + 1e-300], axis=1)
    stats[wild, 3] = np.inf
    return codes.astype(np.int8), stats


def _tiles(size: int):
    def run(batches):
        from pyspark import TaskContext
        part, n = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def tile(dim, rows):
            nonlocal n
            ids = np.concatenate([r[0] for r in rows])
            x = np.concatenate([r[1] for r in rows])
            codes, stats = quantise(x)
            n += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n]), pa.array([dim], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, codes, stats))],
                schema=_TILE_SCHEMA)

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            col = b.column(1)
            length = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            first = np.concatenate([[0], np.cumsum(length)])
            for dim in np.unique(length):
                rows = np.flatnonzero(length == dim)
                x = flat[first[rows][:, None] + np.arange(dim)]
                held.setdefault(int(dim), []).append((ids[rows], x))
                while sum(len(r[0]) for r in held[int(dim)]) >= size:
                    ids_d = np.concatenate([r[0] for r in held[int(dim)]])
                    x_d = np.concatenate([r[1] for r in held[int(dim)]])
                    yield tile(int(dim), [(ids_d[:size], x_d[:size])])
                    held[int(dim)] = [(ids_d[size:], x_d[size:])]
        for dim, rows in held.items():
            if sum(len(r[0]) for r in rows):
                yield tile(dim, rows)
    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: an id, and a
    non-empty vector of finite components that are not all zero."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)))


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed in component order.  Where
    the squares over- or underflow, differences are first divided by a power
    of two, which changes no digit."""
    def root(d):
        total = np.zeros(len(d))
        for j in range(d.shape[1]):
            total += d[:, j] * d[:, j]
        return np.sqrt(total)
    with np.errstate(over="ignore", under="ignore"):
        d = a - b
        out = root(d)
        far = np.flatnonzero(~((out > SMALL) & (out < LARGE)))
        if len(far):
            d = np.ldexp(a[far], -2) - np.ldexp(b[far], -2)      # differences of large components may overflow
            small = np.abs(d).max(axis=1) < SMALL
            d = np.where(small[:, None], a[far] - b[far], d)
            power = np.frexp(np.abs(d).max(axis=1))[1]
            out[far] = np.ldexp(root(np.ldexp(d, -power[:, None])), power + np.where(small, 0, 2))
    return out


def tile_best(q_ids, q, q_codes, q_stats, ids, x, codes, stats, best: list, k: int) -> None:
    """Merge a tile's candidates into ``best``, one heap of (-distance, -id)
    per query row.  ``best`` heaps hold the k nearest found so far."""
    q_wild, wild = np.isinf(q_stats[:, 3]), np.isinf(stats[:, 3])
    q_stats, stats = (np.where(np.isinf(x), 0.0, x) for x in (q_stats, stats))
    kind = np.float32 if q.shape[1] <= 1024 else np.float64  # integer products stay exact
    dots = (q_codes.astype(kind) @ codes.astype(kind).T) * q_stats[:, :1] * stats[:, 0]
    norms = q_stats[:, 2:3] ** 2 + stats[:, 2] ** 2
    bound = q_stats[:, 3:4] * stats[:, 2] + q_stats[:, 1:2] * stats[:, 3]  # |x.y - coded product|
    bound += 1e-6 * (norms + np.abs(dots)) if kind is np.float32 else 1e-12 * (norms + np.abs(dots))
    low, high = norms - 2 * (dots + bound), norms - 2 * (dots - bound)
    wild = q_wild[:, None] | wild
    low[wild], high[wild] = -np.inf, np.inf
    own = q_ids[:, None] == ids
    high[own] = np.inf
    limit = np.full(len(q), np.inf)
    if len(ids) > k:
        limit = np.partition(high, k - 1, axis=1)[:, k - 1]
    for i, h in enumerate(best):
        if len(h) == k:
            limit[i] = min(limit[i], h[0][0] * h[0][0] * (1 + 1e-12))
    rows, cols = np.nonzero((low <= limit[:, None]) & ~own)
    for at in range(0, len(rows), SURVIVORS):
        r, c = rows[at:at + SURVIVORS], cols[at:at + SURVIVORS]
        for i, d, v in zip(r.tolist(), exact_distances(q[r], x[c]).tolist(), ids[c].tolist(), strict=True):
            h, item = best[i], (-d, -v)
            if len(h) < k:
                heapq.heappush(h, item)
            elif item > h[0]:
                heapq.heapreplace(h, item)


_FOUND_DDL = "query_id long, vec_id long, score double"


def _search(k: int):
    def arrays(row, what):
        dim = row["dim"]
        ids = np.frombuffer(row[f"{what}ids"], np.int64)
        return (ids, np.frombuffer(row[f"{what}vectors"], np.float64).reshape(len(ids), dim),
                np.frombuffer(row[f"{what}codes"], np.int8).reshape(len(ids), dim),
                np.frombuffer(row[f"{what}stats"], np.float64).reshape(len(ids), 4))

    def flush(ids, best):
        q = np.repeat(ids, [len(h) for h in best])
        items = [i for h in best for i in h]
        return pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array([-v for _, v in items], pa.int64()), pa.array([-d for d, _ in items], pa.float64())],
            names=["query_id", "vec_id", "score"])

    def run(batches):
        cell, held = None, {}
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                if cell != (row["grp"], row["q_grp"]):
                    for ids, best in held.values():
                        yield flush(ids, best)
                    cell, held = (row["grp"], row["q_grp"]), {}
                q = arrays(row, "q_")
                _, best = held.setdefault(row["q_tile"], (q[0], [[] for _ in q[0]]))
                tile_best(*q, *arrays(row, ""), best, k)
        for ids, best in held.values():
            yield flush(ids, best)
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the ``k`` rows of
    ``vectors`` nearest to each row of ``queries`` by Euclidean distance in
    double precision, nearest first, ties to the smaller vec_id.

    Ids are read as longs; text that is no number is an error of the cast.

    Defined cases: rows with a null id, and vectors that are null, empty, zero
    or hold a null or non-finite component, take no part.  A row of the
    query's own vec_id is no candidate.  Vectors of another length have no
    distance to the query and are no candidates.  Repeated rows of ``vectors``
    are candidates each; repeated queries of one id count once (least vector).
    Fewer than ``k`` candidates: all of them.  Other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    # staged: a tile that were cut anew might hold other rows, and its vectors
    # would meet some cells twice and others never
    tiles = stage(usable(vectors, id_col, vector_col).mapInArrow(_tiles(TILE), _TILE_DDL), "tiles")
    asked = usable(queries, id_col, vector_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    q = stage(asked.mapInArrow(_tiles(QUERY_TILE), _TILE_DDL), "query-tiles")
    q = q.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("tile", "ids", "vectors", "codes", "stats")))
    # cells of the block matrix: each holds a bounded number of tiles of either
    # side, and a tile is sent once per cell and not once per tile it meets
    cells = lambda n, size, least: max(least, -(-n // (size * TILES_PER_GROUP)))
    groups = cells(vectors.count(), TILE, spark.sparkContext.defaultParallelism)
    q_groups = cells(asked.count(), QUERY_TILE, 1)
    tiles = (tiles.withColumn("grp", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int"))
             .withColumn("q_grp", F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1)))))
    q = (q.withColumn("q_grp", F.pmod(F.xxhash64("q_tile"), F.lit(q_groups)).cast("int"))
         .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    pairs = tiles.join(q.hint("merge"), ["grp", "q_grp", "dim"])
    found = pairs.mapInArrow(_search(k), _FOUND_DDL)
    # merge of the heaps' results; the limit on the rank is applied before the shuffle, too
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(
    list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, e: s + e)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
