"""Audit of how the sources of each language diverge, over a frequent-pattern
tree of term rows.

A kept term of a language is one row: its nonzero counts by source, in one
order of the sources (those with most terms first).  The rows are inserted into a
prefix tree, equal ones with their multiplicity.  The distance of two sources
is the sum of |p - q| over all kept terms.  Taking every count for zero gives it
for the whole vocabulary at once; a histogram of each source's own counts
corrects it for the terms that it has; where both have a term, the pair's
correction is formed in the tree, once for a node and an ancestor, times the
terms that share the path.

Scale: terms are counted in tasks before the shuffle.  The rows of the tree
are dealt by ranges of (lang, path), so paths with a common prefix meet, and a
language with most of the rows is split; a task keeps the current branch and
sums by pairs of sources, so its memory does not depend on its rows.  A node cut
in two by a range counts in each part with its share of the multiplicity.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm.common import read, small_batches, stage

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
ADD = 5
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BLOCK = 1 << 22        # bytes of a text that are cut at once
_HELD = 1 << 20         # entries that a task combines at once


# ------------------------------------------------------------------- counts

def _terms(text: bytes):
    """Lists of the terms of a text, by blocks that end between terms."""
    at = 0
    while at < len(text):
        end = at + _BLOCK
        if end < len(text):
            inside = _TERM.match(text, end)
            end = inside.end() if inside else end
        yield _TERM.findall(text[at:end])
        at = end


def _count(batches):
    """By (lang, source, term): occurrences n and texts df.  A row without
    term marks a group, so that one without any term is known too."""
    held: dict[tuple, tuple[dict, dict]] = {}
    seen = set()

    def rows():
        for (lang, source), (n, df) in held.items():
            terms = list(n)
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.string()),
                     pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in terms], pa.int64())], schema=_COUNTS)
        held.clear()
    from collections import Counter
    size = 0
    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = (lang, source)
            seen.add(key)
            n, df = held.setdefault(key, (Counter(), Counter()))
            before, once = len(n), set()
            for terms in _terms(text.encode().lower()):
                n.update(terms)
                once.update(terms)
            df.update(once)
            size += len(n) - before
            if size > _HELD:
                yield from rows()
                size = 0
    yield from rows()
    if seen:
        lang, source = zip(*seen, strict=True)
        none = lambda kind: pa.nulls(len(seen), kind)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), none(pa.string()), none(pa.int64()), none(pa.int64())], schema=_COUNTS)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n, df: occurrences and documents; one row without
    term for every (lang, source)."""
    small_batches(docs.sparkSession)
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


# --------------------------------------------------------------------- tree

class Tree:
    """The current branch of the prefix tree of one language, and the pair
    corrections of the nodes that are closed.  Rows come in order, so a node is
    closed, with its whole multiplicity, when a row leaves it."""

    def __init__(self):
        self.source = self.p = self.zero = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)     # rows that end at a node, or below it in a closed part
        self.keys: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.held = 0

    def insert(self, source: np.ndarray, p: np.ndarray, zero: np.ndarray, times: int) -> None:
        k = min(len(source), len(self.source))
        differ = np.flatnonzero((source[:k] != self.source[:k]) | (p[:k] != self.p[:k]))
        shared = int(differ[0]) if len(differ) else k
        self.close(shared)
        self.times = np.concatenate([self.times, np.zeros(len(source) - shared, np.int64)])
        self.source, self.p, self.zero = source, p, zero
        if len(source):
            self.times[-1] += times

    def close(self, depth: int) -> None:
        """Leave all nodes below ``depth``: each one's correction with every
        ancestor, by its multiplicity."""
        n = len(self.source)
        if n <= depth:
            return
        times = np.cumsum(self.times[depth:][::-1])[::-1]
        if depth:
            self.times[depth - 1] += times[0]
        step = max(1, _HELD // n)
        for lo in range(depth, n, step):
            at = np.arange(lo, min(lo + step, n))
            node, above = np.nonzero(np.arange(n) < at[:, None])
            node = at[node]
            p, z, q, y = self.p[node], self.zero[node], self.p[above], self.zero[above]
            fix = abs(p - q) - abs(p - y) - abs(z - q) + abs(z - y)
            self.keys.append(self.source[above] << 32 | self.source[node])
            self.sums.append(fix * times[node - depth])
            self.held += len(node)
        self.source, self.p, self.zero, self.times = (x[:depth] for x in (self.source, self.p, self.zero, self.times))
        if self.held > _HELD:
            self.combine()

    def combine(self) -> None:
        if self.keys:
            keys, sums = np.concatenate(self.keys), np.concatenate(self.sums)
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], sums[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            self.keys, self.sums = [keys[first]], [np.add.reduceat(sums, first) if len(first) else sums]
            self.held = len(first)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The corrections so far, which are then forgotten."""
        self.combine()
        keys, sums = (self.keys[0], self.sums[0]) if self.keys else (np.zeros(0, np.int64),) * 2
        self.keys, self.sums, self.held = [], [], 0
        return keys, sums


_FIXES = "lang string, a int, b int, value long"


def _grow(batches):
    tree, lang = Tree(), None

    def rows():
        keys, sums = tree.take()
        if len(keys):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array((keys >> 32).astype(np.int32)),
                 pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], names=["lang", "a", "b", "value"])
    for b in batches:
        path = b.column(1)
        at = path.offsets.to_numpy()
        flat = path.flatten()
        s, p, z = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
        at = at - at[0]
        for name, lo, hi, times in zip(b.column(0).to_pylist(), at[:-1], at[1:], b.column(2).to_pylist(), strict=True):
            if name != lang:
                tree.close(0)
                yield from rows()
                lang = name
            tree.insert(s[lo:hi], p[lo:hi], z[lo:hi], times)
            if tree.held > _HELD // 2:
                tree.combine()
                if tree.held > _HELD // 2:
                    yield from rows()
    tree.close(0)
    yield from rows()


# -------------------------------------------------------------------- audit

def _probability(n: str, total: str, v: str) -> str:
    # in decimals: the product may pass 64 bits
    return f"1 + cast(({SCALE}BD * (cast({n} as decimal(20,0)) + {ADD})) div (cast({total} as decimal(20,0)) + {ADD} * cast({v} as decimal(20,0))) as long)"


def pair_distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the distance of every two sources, a < b.  ``rows``
    has lang, term, s, p (the probability of source s, of the counts above
    zero), ``groups`` lang, s, v (kept terms) and zero (p of a zero count)."""
    other = groups.select("lang", F.col("s").alias("b"), F.col("zero").alias("y"))
    base = (groups.select("lang", F.col("s").alias("a"), "zero", "v").join(other, "lang").filter("a < b")
            .select("lang", "a", "b", (F.col("v") * F.abs(F.col("zero") - F.col("y"))).alias("value")))
    own = rows.groupBy("lang", "s", "p", "zero").agg(F.count(F.lit(1)).alias("m"))
    own = own.join(other, "lang").filter("s <> b").select(
        "lang", F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b"),
        (F.col("m") * (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("zero") - F.col("y")))).alias("value"))
    path = F.sort_array(F.collect_list(F.struct("s", "p", "zero"))).alias("path")
    paths = stage(rows.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times")), "paths")
    # ranges of the first nodes, and of a hash where very many rows share those:
    # the keys that Spark samples stay short, however many sources there are
    dealt = paths.repartitionByRange("lang", F.slice("path", 1, 4), F.xxhash64("path"))
    grown = dealt.sortWithinPartitions("lang", "path").select("lang", "path", "times").mapInArrow(_grow, _FIXES)
    return base.union(own).union(grown).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source",
               text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: by source its distances to the
    other ones of its language (part ``pair``), and the ``top`` terms that it
    has most above the language (part ``term``).

    Defined cases: null lang, source or text are empty; a group without terms
    has zero counts; without kept terms all distances are 0; a language of
    one source has no pairs; repeated rows count as often as they are there;
    an empty table gives no rows; other columns are not read.  A term's row and
    a language's groups are as long as the language has sources; distances
    hold in 64 bits up to 4e9 kept terms.
    """
    counts = stage(count_terms(docs, lang_col, source_col, text_col), "counts")
    by = F.collect_list(F.struct("source", "n")).alias("by")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang"), by)
    kept = stage(kept.filter(F.col("df") >= least_docs).drop("df"), "kept")
    flat = kept.select("lang", "term", "n_lang", F.inline("by"))
    langs = kept.groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count(F.lit(1)).alias("v"))
    sizes = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    none = F.lit(0).cast("long")
    groups = counts.filter("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    order = Window.partitionBy("lang").orderBy(F.desc("k"), "source")
    groups = groups.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("total", "k", "total_lang", "v")))
    groups = stage(groups.withColumn("s", F.row_number().over(order)).withColumn(
        "zero", F.when(F.col("v") > 0, F.expr(_probability("0", "total", "v"))).otherwise(none)), "groups")
    rows = flat.join(groups.drop("k"), ["lang", "source"]).withColumn("p", F.expr(_probability("n", "total", "v")))
    rows = stage(rows.withColumn("q", F.expr(_probability("n_lang", "total_lang", "v"))).select(
        "lang", "source", "term", "s", "p", "q", "zero"), "rows")

    found = pair_distances(rows.select("lang", "term", "s", "p", "zero"), groups.select("lang", "s", "v", "zero"))
    both = found.select("lang", F.inline(F.array(*(F.struct(F.col(x).alias("s"), F.col(y).alias("o"), "value") for x, y in ("ab", "ba")))))
    pairs = (both.join(groups.select("lang", "s", "source"), ["lang", "s"])
             .join(groups.select("lang", F.col("s").alias("o"), F.col("source").alias("item")), ["lang", "o"])
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    terms = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    first = terms.withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).union(first)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tokens AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang),
every AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.total, 0)::HUGEINT + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total::HUGEINT + 5 * l.v) AS q
  FROM groups JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN counts c USING (lang, source, term) LEFT JOIN sizes s USING (lang, source)),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(d.value, 0) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM every a JOIN every b USING (lang, term)
             WHERE a.source <> b.source GROUP BY ALL) d
  ON d.lang = g.lang AND d.source = g.source AND d.item = o.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM every WHERE n > 0 AND p > q),
out AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM out)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
