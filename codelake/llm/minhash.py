"""Near-duplicate detection by b-bit MinHash.

One pass over the texts gives each document the minima of ``BANDS * ROWS``
permutations over its set of 5-word shingles.  The minima make band keys
(candidates) and are then thrown away but for their low ``BITS`` bits, packed
into 64-bit words.  A candidate pair's similarity is first estimated by
counting equal bit groups of the packed words, corrected for chance equality;
pairs that the estimate leaves in reach of the threshold are confirmed on the
full sets.  Components of confirmed links give the classes.

Scale: documents with equal sets are one node from the start (an aggregate
with map-side combination).  A bucket of m members is first compared with one
centre (m - 1 pairs); what the links merged needs no further comparison, and
only pairs of a bucket that still lie in different components are then
compared, so a group of m near copies costs about m pairs and not m * m.  No
bucket is capped.  Links, components and sets stay distributed; all joins
are between staged tables, so AQE can split hot keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm.common import (hash_spans, list_column, mix64, read, slices, small_batches, stage, stream64,
                                 text_buffer, word_spans)

SHINGLE = 5
BANDS, ROWS, BITS = 32, 4, 2          # 128 permutations, 2 bits kept of each minimum
PERMS = BANDS * ROWS
PACKED = PERMS * BITS // 64
# standard deviations that the estimate may lie below the threshold: a linked
# pair is lost with a chance of about 1e-9
SLACK = 6.0
# sets of so many shingles at most travel with the open pairs' rows
SHORT = 256

_U = np.uint64
_MULT = (stream64(101, PERMS) >> _U(32)).astype(np.uint32) | np.uint32(1)
_ADD = (stream64(102, PERMS) >> _U(32)).astype(np.uint32)
_POS = stream64(103, SHINGLE) | _U(1)
_SHORT = stream64(104, SHINGLE)
_BAND = stream64(105, BANDS)
_ROW = stream64(106, ROWS) | _U(1)
_FILL = 2048


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a word sequence; a
    shorter sequence is one shingle, an empty one none."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return mix64((h * _POS[:n]).sum(keepdims=True, dtype=np.uint64) + _SHORT[n])
    s = h[:n - SHINGLE + 1] * _POS[0]
    for k in range(1, SHINGLE):
        s += h[k:n - SHINGLE + 1 + k] * _POS[k]
    return np.unique(mix64(s))


def minima(s: np.ndarray) -> np.ndarray:
    """The minimum of each permutation over a non-empty set."""
    low = (s >> _U(32)).astype(np.uint32)
    out = np.full(PERMS, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(low), _FILL):
        np.minimum(out, (_MULT[:, None] * low[None, i:i + _FILL] + _ADD[:, None]).min(axis=1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One key per band and row of minima (documents x PERMS)."""
    v = m.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return mix64((v * _ROW).sum(axis=2, dtype=np.uint64) + _BAND)


def pack_bits(m: np.ndarray) -> np.ndarray:
    """The low bits of (mixed) minima, packed: documents x PACKED words."""
    v = mix64(m.astype(np.uint64)) & _U((1 << BITS) - 1)
    shift = (np.arange(64 // BITS, dtype=np.uint64) * _U(BITS))
    return (v.reshape(-1, PACKED, 64 // BITS) << shift).sum(axis=2, dtype=np.uint64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()),
                     ("bands", pa.list_(pa.int64()))] + [(f"s{i}", pa.int64()) for i in range(PACKED)])
_SIGNED_DDL = ("doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, "
               + ", ".join(f"s{i} long" for i in range(PACKED)))


def _sets(col: pa.Array):
    """The shingle set of each row, in order."""
    for lo, hi in slices(col):
        buf, at = text_buffer(col.slice(lo, hi - lo))
        starts, ends, first = word_spans(buf, at)
        h = hash_spans(buf, starts, ends)
        for i in range(hi - lo):
            yield shingle_hashes(h[first[i]:first[i + 1]])


def _sign(batches):
    for b in batches:
        n = b.num_rows
        count = np.zeros(n, np.int64)
        fp = np.zeros((2, n), np.uint64)
        low = np.full((n, PERMS), 0xFFFFFFFF, dtype=np.uint32)
        for i, s in enumerate(_sets(b.column(1))):
            count[i] = len(s)
            if len(s):
                fp[0, i] = mix64(s ^ _BAND[0]).sum(dtype=np.uint64)
                fp[1, i] = mix64(s ^ _BAND[1]).sum(dtype=np.uint64)
                low[i] = minima(s)
        packed = pack_bits(low).view(np.int64)
        keys = band_keys(low).view(np.int64)
        keep = np.where(count > 0, BANDS, 0)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(count), *(pa.array(f.view(np.int64)) for f in fp),
             list_column(keys[count > 0].ravel(), keep, pa.int64()), *(pa.array(p) for p in packed.T)], schema=_SIGNED)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, its band keys
    (none for an empty set) and its packed low bits s0..s3."""
    small_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(_sign, _SIGNED_DDL))


def estimated_similarity(a: str, b: str):
    """Similarity estimated from the packed words of columns ``a``.s0.. and
    ``b``.s0..: the share of equal bit groups, freed of chance equality."""
    ones = F.lit(int("01" * 32, 2))
    differ = F.lit(0)
    for i in range(PACKED):
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    chance = 0.5 ** BITS
    return ((1 - differ / PERMS) - chance) / (1 - chance)


def estimate_floor(percent: int) -> float:
    """The least estimate that a pair at the threshold may reasonably show."""
    chance, t = 0.5 ** BITS, percent / 100
    equal = chance + (1 - chance) * t
    return t - SLACK * (equal * (1 - equal) / PERMS) ** 0.5 / (1 - chance)


def _set_rows(batches):
    for b in batches:
        sets = list(_sets(b.column(1)))
        short = [s.view(np.int64) if len(s) <= SHORT else None for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], type=pa.binary()),
                                          pa.array(short, type=pa.list_(pa.int64()))], names=["rid", "members", "short"])


def _intersections(batches):
    for b in batches:
        out = np.empty(b.num_rows, dtype=np.int64)
        pairs = zip(b.column("ma").to_pylist(), b.column("mb").to_pylist(), strict=True)
        for i, (x, y) in enumerate(pairs):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            at[at == len(v)] = 0
            out[i] = int((v[at] == u).sum())
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("total"), pa.array(out)],
                                         names=["a", "b", "total", "shared"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    b = sets.select(F.col("rid").alias("b"), F.col("members").alias("mb"))
    a = sets.select(F.col("rid").alias("a"), F.col("members").alias("ma"))
    both = pairs.join(b, "b").join(a, "a").select(
        "a", "b", "ma", "mb", ((F.length("ma") + F.length("mb")) / 8).cast("long").alias("total"))
    got = both.mapInArrow(_intersections, "a long, b long, total long, shared long")
    return got.filter(F.col("shared") * 100 >= percent * (F.col("total") - F.col("shared"))).select("a", "b")


# a table of this many (node, label) rows at most is sent to every task of a join
BROADCAST_ROWS = 1 << 18


def _side(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges
    (a, b).  Minimum of the neighbours' labels, then a jump to the label's own
    label, until nothing changes; all tables stay distributed.  Labels are
    broadcast only where their counted rows allow it."""
    e = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
              .union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stage(e.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    rows = labels.count()
    while rows:
        near = (e.join(_side(labels.select(F.col("node").alias("v"), "label"), rows), "v")
                .groupBy("u").agg(F.min("label").alias("m")))
        hop = stage(near.join(_side(labels, rows), F.col("u") == F.col("node")).select(
            "node", F.least("label", "m").alias("label"), F.col("label").alias("old")), "hop")
        up = _side(hop.select(F.col("node").alias("label"), F.col("label").alias("top")), rows)
        labels = stage(hop.join(up, "label").select("node", F.col("top").alias("label"), "old"), "labels")
        done = labels.filter("label != old").isEmpty()
        labels = labels.select("node", "label")
        if done:
            break
    return labels


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``comp`` after further links between their nodes."""
    rows = comp.count()
    label = comp.select(F.col("node").alias("a"), F.col("label").alias("la"))
    other = comp.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = links.join(_side(label, rows), "a", "left").join(_side(other, rows), "b", "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b").distinct()
    top = components(between)
    up = _side(top.select(F.col("node").alias("label"), F.col("label").alias("top")), top.count())
    nodes = comp.select("node", "label").union(
        links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        .join(comp, "node", "left_anti").select("node", F.col("node").alias("label")))
    return stage(nodes.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "merged")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                    star_rounds: int = 3, pairs_per_row: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of distinct 5-word shingles (words lower-cased in A-Z).

    A bucket's members are compared with its centre first.  While the pairs
    that are still in different components of a bucket are more than
    ``pairs_per_row`` times the bucket rows, up to ``star_rounds`` further
    centres are tried; then all those pairs are compared.  So the pairs of a
    bucket of m members are bounded by m * ``pairs_per_row`` unless its members
    stay in many components after that: the worst case, a bucket of texts that
    share a band and are linked with none of the centres, has m * m / 2.

    Ids are read as longs; text that is no number is an error of the cast.

    Defined cases: null or empty text, or text without words: an empty set,
    linked with nothing.  Under five words: the whole sequence is one shingle.
    Rows of a null doc_id take no part (component_id null, kept true).
    Repeated rows all come back with the same component; rows that share a
    doc_id but not a text are one node whose sets all count.  An empty table
    gives an empty result.  Other columns of ``docs`` are not read.
    """
    signed = stage(signatures(docs, id_col, text_col), "signed")
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stage(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rid")), "classes")
    words = [f"s{i}" for i in range(PACKED)]
    reps = stage(full.join(classes.select(F.col("rid").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rid"), F.col("n_shingles").alias("n"), *words, "bands"), "reps")
    placed = reps.select("rid", F.explode("bands").alias("key"))

    def in_reach(a: str, b: str):
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        return ((F.least(na, nb) * 100 >= percent * F.greatest(na, nb))
                & (estimated_similarity(a, b) >= estimate_floor(percent)))

    # buckets with more than one member, each with its smallest as centre
    me = F.struct("rid", "n", *words)
    shared = stage(placed.groupBy("key").agg(F.min("rid").alias("centre"), F.max("rid").alias("last"))
                   .filter("centre < last").select("key", "centre"), "buckets")
    of_centre = reps.select(F.col("rid").alias("centre"), me.alias("c"))
    members = stage(placed.join(shared, "key").join(reps.drop("bands"), "rid").withColumn("me", me).join(of_centre, "centre").select(
        "key", "rid", "n", *words, "centre", in_reach("me", "c").alias("reach")), "members")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # the texts are always shuffled, whatever the size of the other side
    sets = stage(texts.join(members.select(F.col("rid").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
                 .mapInArrow(_set_rows, "rid long, members binary, short array<long>").filter(F.length("members") > 0), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        return stage(_confirm(pairs.distinct(), sets, percent), "links")

    comp = components(linked(members.filter("reach and rid != centre").select(F.col("centre").alias("a"), F.col("rid").alias("b"))))
    for turn in range(star_rounds + 1):
        now = stage(members.select("key", "rid", "n", *words)
                    .join(_side(comp.withColumnRenamed("node", "rid"), comp.count()), "rid", "left")
                    .withColumn("label", F.coalesce("label", "rid")), "placed")
        sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        left = sizes.groupBy("key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"),
                                        F.count(F.lit(1)).alias("k")).filter("k > 1")
        left = stage(left.select("key", "s", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("open")), "open")
        n_open, n_rows = left.agg(F.sum("open"), F.sum("s")).first()
        if not n_open:
            break
        part = now.join(left.select("key"), "key", "left_semi")
        if n_open <= pairs_per_row * n_rows or turn == star_rounds:
            # all pairs that are still in different components of a bucket,
            # each in the first of the buckets that it shares
            part = part.join(reps.select("rid", "bands"), "rid").join(sets.select("rid", "short"), "rid")
            once = F.get(F.array_intersect("x.bands", "y.bands"), F.lit(0)) == F.col("x.key")
            # short sets are compared on the spot
            both = F.size(F.array_intersect("x.short", "y.short"))
            short_linked = F.when(F.col("x.short").isNotNull() & F.col("y.short").isNotNull(),
                                  100 * both >= percent * (F.col("x.n") + F.col("y.n") - both)).otherwise(F.lit(True))
            pairs = part.alias("x").join(part.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label"))
                                         & (F.col("x.rid") < F.col("y.rid")) & in_reach("x", "y") & once & short_linked)
            comp = _merge(comp, linked(pairs.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))))
            break
        # another centre for each bucket
        order = F.xxhash64(F.col("rid"), F.lit(turn))
        centre = stage(part.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rid", "n", *words, "label")).alias("c")), "centre")
        pairs = part.withColumn("me", me).join(centre, "key").filter((F.col("label") != F.col("c.label")) & in_reach("me", "c"))
        comp = _merge(comp, linked(pairs.select(F.least("rid", "c.rid").alias("a"), F.greatest("rid", "c.rid").alias("b"))))

    of_class = stage(classes.join(_side(comp, comp.count()), F.col("rid") == F.col("node"), "left")
                     .select("fp1", "fp2", F.coalesce("label", "rid").alias("component")), "placed")
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(of_class, ["fp1", "fp2"], "left")
    # an empty set's fingerprint is 0, 0: never a class of its own
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, whole, that stay if one document of each class of
    near-duplicates does: that of the least doc_id.  Of rows that share a
    doc_id one stays, the least by text and then the other columns; rows of a
    null doc_id all stay."""
    kept = near_duplicates(docs, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    order = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    least = Window.partitionBy("doc_id").orderBy(*order)
    chosen = docs.join(kept, "doc_id", "left_semi").select(*docs.columns, F.row_number().over(least).alias("rank of row"))
    return chosen.filter(F.col("rank of row") == 1).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g
  FROM d),
c AS (SELECT g, min(doc_id) AS rid, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g),
e AS (SELECT rid, n, unnest(g) AS x FROM c),
common AS (SELECT a.rid AS a, b.rid AS b, a.n AS na, b.n AS nb, count(*) AS k
  FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid AND least(a.n, b.n) * 100 >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(n, m) AS (SELECT rid, rid FROM c UNION SELECT u.b, r.m FROM r JOIN u ON r.n = u.a),
comp AS (SELECT n, min(m) AS m FROM r GROUP BY n)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(comp.m, s.doc_id) AS component_id,
       s.doc_id = coalesce(comp.m, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.g) = c.g LEFT JOIN comp ON comp.n = c.rid
"""
