"""Benchmark decontamination by a positional inverted index, in built-in
functions only.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (an item
of fewer is one window).  The index holds one posting (row, pos, term) for
every place of a text where a word of the benchmark stands.  A window is
searched from its rarest term on: the places of that term, less its offset in
the window, are the candidate starts; they are intersected with the
offset-adjusted places of the next rarest term, and what is left with those of
all others.  With ``slop`` a term may stand up to that many places beside its
own: a phrase has every term in place, a proximity match does not.

Scale: texts are read and cut once; the index is a staged table, whose header
postings carry what is known of each text.  Equal windows are searched once,
and a window that a third of all texts share gives one row a text and start.
Intersections join on (row, pos, term), so no term is a hot key; the windows
meet the places of their rarest terms by a plain join, which Spark broadcasts
by size, or splits where a term is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelake.llm.common import read, stage

WINDOW = 10
SLOP = 1
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEADER = " "        # the term of a text's first posting; no word holds a space


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _cut(text: Column) -> Column:
    """The text cut between words: empty strings at the ends where it begins
    or ends with other characters."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), _APART)


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, words of every window of every item."""
    rows = items.select(F.col(id_col).alias("item_id"),
                        F.transform(F.filter(_cut(F.col(text_col)), lambda x: x != ""), lower_ascii).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return rows.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at") + 1, F.lit(window)).alias("words"))


def index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings (row, pos, term) of the words of ``vocabulary`` (term),
    and for every text a header with doc_id and n_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _cut(F.col(text_col)).alias("w"), F.monotonically_increasing_id().alias("row"))
    n = F.size("w") - (F.get("w", F.lit(0)) == "").cast("int") - ((F.size("w") > 1) & (F.get("w", F.size("w") - 1) == "")).cast("int")
    rows = rows.select("doc_id", "row", n.alias("n_words"), F.posexplode(F.concat(F.array(F.lit(_HEADER)), "w")).alias("pos", "word"))
    first = F.col("pos") == 0
    rows = rows.select("row", "pos", lower_ascii(F.col("word")).alias("term"), F.when(first, F.col("doc_id")).alias("doc_id"),
                       F.when(first, F.col("n_words").cast("long")).alias("n_words"))
    header = docs.sparkSession.range(1).select(F.lit(_HEADER).alias("term"))
    return stage(rows.join(vocabulary.select("term").union(header), "term", "left_semi"), "postings")


def _intersect(found: DataFrame, asked: Column, places: DataFrame, slop: int) -> DataFrame:
    """The candidates (row, window, start, exact) all of whose ``asked`` terms
    (term, at) have a posting at start + at, or up to ``slop`` beside it."""
    want = found.select("row", "window", "start", "exact", F.size(asked).alias("n"), F.explode(asked).alias("x"))
    want = want.select("row", "window", "start", "exact", "n", F.col("x.term").alias("term"), F.col("x.at").alias("at"),
                       F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off"))
    want = want.withColumn("pos", F.col("start") + F.col("at") + F.col("off"))
    met = want.join(places, ["row", "pos", "term"])
    if slop:   # a term may stand at several of its places
        met = met.groupBy("row", "window", "start", "exact", "n", "at").agg(F.bool_or(F.col("off") == 0).alias("here"))
    else:
        met = met.withColumn("here", F.lit(True))
    return (met.groupBy("row", "window", "start", "exact", "n").agg(F.count(F.lit(1)).alias("k"), F.bool_and("here").alias("here"))
            .filter("k = n").select("row", "window", "start", (F.col("exact") & F.col("here")).alias("exact")))


def search(postings: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """row, window, start, length, exact: every place of every window (window,
    words), in order of rarity; ``exact`` tells phrases from proximity."""
    places = postings.filter(F.col("term") != _HEADER).select("row", "pos", "term")
    rarity = stage(places.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "rarity")
    terms = windows.select("window", F.size("words").alias("length"), F.posexplode("words").alias("at", "term")).join(rarity, "term")
    order = F.sort_array(F.collect_list(F.struct("n", "term", "at")))
    plans = stage(terms.groupBy("window", "length").agg(order.alias("terms")).filter(F.size("terms") == F.col("length")), "plans")
    rarest = plans.select("window", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["at"].alias("at"),
                          F.slice("terms", 2, 1).alias("second"))
    # of a frequent term no place travels unless a window has nothing rarer
    firsts = places.join(rarest.select("term").distinct(), "term", "left_semi")
    found = firsts.join(rarest, "term").select("row", "window", (F.col("pos") - F.col("at")).alias("start"), "second", F.lit(True).alias("exact"))
    seconds = plans.filter("length > 1").select(F.col("terms")[1]["term"].alias("term")).distinct()
    alone = found.filter(F.size("second") == 0).drop("second")
    two = _intersect(found.filter(F.size("second") > 0), F.col("second"), places.join(seconds, "term", "left_semi"), slop)
    two = stage(alone.unionByName(two), "intersected")
    # the frequent terms' places are only looked at in texts that are still in
    texts = stage(two.select("row").distinct(), "searched")
    still = places.join(texts, "row", "left_semi")
    rest = two.join(plans.filter("length > 2").select("window", F.expr("slice(terms, 3, length - 2)").alias("rest")), "window")
    out = _intersect(rest, F.col("rest"), still, slop).unionByName(two.join(plans.filter("length <= 2"), "window", "left_semi"))
    return out.join(plans.select("window", "length"), "window").select("row", "window", "start", "length", "exact")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  window: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: texts (row, doc_id, n_words), matches (row, window, start,
    length, exact; start counts words from 1, or from 2 where the text begins
    with other characters), and owners (window, item_id).

    Defined cases: null or empty texts and items have no words and match
    nothing; an item shorter than the window is one window; equal windows are
    one, with all their items; repeated rows are texts each; a null item_id
    owns its windows like any other; an empty table gives empty tables; other
    columns are not read.
    """
    owned = stage(item_windows(items, item_col, "text", window).distinct(), "owned")
    windows = stage(owned.select("words").distinct().select(F.monotonically_increasing_id().alias("window"), "words"), "windows")
    postings = index(docs, owned.select(F.explode("words").alias("term")).distinct(), id_col, text_col)
    texts = postings.filter(F.col("term") == _HEADER).select("row", "doc_id", "n_words")
    return texts, search(postings, windows, slop), windows.join(owned, "words").select("window", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, slop: int = SLOP, **names) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an exact match), n_items, items
    (the sorted item_ids as strings, without null), contaminated, n_near
    (proximity matches, not exact) of every row of ``docs``; cases as in
    ``contamination``."""
    texts, matches, owners = contamination(docs, items, slop=slop, **names)
    matches = stage(matches, "matches")
    exact = matches.filter("exact")
    ends = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = exact.groupBy("row", "start").agg(F.max("length").alias("length"))
    covered = spans.withColumn("before", F.coalesce(F.max(end).over(ends), F.col("start")))
    hits = covered.groupBy("row").agg(F.sum(F.greatest(end - F.greatest("start", "before"), F.lit(0))).alias("n_hit"))
    listed = exact.select("row", "window").distinct().join(owners.filter("item_id is not null"), "window").groupBy("row").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    near = matches.filter("not exact").groupBy("row").agg(F.count(F.lit(1)).alias("n_near"))
    out = texts.join(hits, "row", "left").join(listed, "row", "left").join(near, "row", "left")
    none = F.lit(0).cast("long")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                     F.coalesce("n_near", none).alias("n_near"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


# words of a text by regular expression; windows and places compared as lists
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS words FROM (
    SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT len(words) AS k FROM windows),
grams AS (
  SELECT r, i, k, list_slice(w, i, i + k - 1) AS words FROM (
    SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, lengths WHERE len(w) >= k)),
met AS (SELECT r, i, k, item_id FROM grams JOIN windows USING (words)),
places AS (SELECT DISTINCT r, unnest(generate_series(i, i + k - 1)) AS p FROM met),
hits AS (SELECT r, count(*) AS n FROM places GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
          FROM met WHERE item_id IS NOT NULL GROUP BY r),
vocabulary AS (SELECT DISTINCT unnest(words) AS term FROM windows),
tokens AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM docs),
places_of AS (SELECT r, p, term FROM tokens SEMI JOIN vocabulary USING (term)),
rarity AS (SELECT term, count(*) AS n FROM places_of GROUP BY term),
terms AS (SELECT words, i, term, n FROM (
            SELECT words, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM (SELECT DISTINCT words FROM windows)) LEFT JOIN rarity USING (term)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY n, term, i) AS k FROM terms
           WHERE words IN (SELECT words FROM terms GROUP BY words HAVING count(n) = count(*))),
starts AS (SELECT r, words, p - i AS s FROM ranked JOIN places_of USING (term) WHERE k = 1),
second AS (SELECT DISTINCT r, s, words FROM starts JOIN ranked USING (words) JOIN places_of USING (r, term)
           WHERE k = 2 AND abs(p - s - i) <= {SLOP}
           UNION ALL SELECT r, s, words FROM starts WHERE len(words) = 1),
near AS (
  SELECT r, s, words FROM (
    SELECT r, s, words, i, bool_or(p = s + i) AS here
    FROM second JOIN ranked USING (words) JOIN places_of USING (r, term) WHERE abs(p - s - i) <= {SLOP} GROUP BY r, s, words, i)
  GROUP BY r, s, words HAVING count(*) = len(words) AND NOT bool_and(here)),
nears AS (SELECT r, count(*) AS n FROM near GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AS contaminated, coalesce(nears.n, 0) AS n_near
FROM docs LEFT JOIN hits USING (r) LEFT JOIN found USING (r) LEFT JOIN nears USING (r)
"""
