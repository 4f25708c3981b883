"""Quality rules by hashed n-gram log-likelihood ratio, in built-in functions only.

Words and word pairs are hashed to ``BUCKETS`` buckets.  Two multinomials are
counted, one over trusted documents and one over the raw corpus; a document's
score is the mean log ratio of the two over its n-grams, and documents under a
fixed threshold are rejected, as are those that fail the base rules.  The
trusted multinomial is smoothed towards the raw one, so that buckets without
evidence say nothing, however small the trusted set.

Scale: a document's n-grams never leave its row but as bucket counts, combined
before their shuffle (``BUCKETS`` rows a task at most).  Repeated windows
are found by sorting packed hashes inside the row, whose bits get fewer as the
text gets longer, and confirmed on their words.  All trusted ids count: texts
and ids meet in one shuffle by id, at every size the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import WORD_SEP, WORD_SEP_CHARS, read, stage

BUCKETS = 1 << 14
SMOOTHING = 20.0        # pseudo-counts of the raw distribution per bucket
THRESHOLD = -0.05       # least mean log ratio of a kept document


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row, even if lambdas read them (the
    optimiser does not move expressions through a generator)."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def words(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """doc_id, text (null: empty), the other columns, w (its words)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *others)
    trimmed = F.btrim("text", F.lit(WORD_SEP_CHARS))
    return pin(rows, w=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_SEP + "+")))


def _bucket(*parts) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")


def single_buckets() -> Column:
    return F.transform("w", lambda x: _bucket(x))


def pair_buckets() -> Column:
    pairs = F.transform("w", lambda x, i: _bucket(x, F.get("w", i + 1)))
    return F.slice(pairs, 1, F.greatest(F.size("w") - 1, F.lit(0)))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, ratio: the log ratio of every bucket.  ``trusted`` has the ids
    of trusted documents in its column doc_id."""
    ids = trusted.select("doc_id").filter("doc_id is not null").distinct().withColumn("trusted", F.lit(1))
    # joined before the words are cut, so that the shuffle has the texts alone
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids.hint("merge"), "doc_id", "left")
    flagged = words(rows, "doc_id", "text", "trusted")
    grams = flagged.select("trusted", F.explode(F.concat(single_buckets(), pair_buckets())).alias("bucket"))
    counted = stage(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target")), "buckets")
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counted, "bucket", "left")
    n_raw, n_target = (counted.agg(F.coalesce(F.sum(c), F.lit(0))).scalar() for c in ("raw", "target"))
    raw = (F.coalesce("raw", F.lit(0)) + 1) / (n_raw + BUCKETS)
    target = (F.coalesce("target", F.lit(0)) + SMOOTHING * BUCKETS * raw) / (n_target + SMOOTHING * BUCKETS)
    return every.select("bucket", F.log(target / raw).alias("ratio"))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, score of every row.

    score is the mean log ratio over words and word pairs (0 without words).
    Defined cases: null or empty text has no words and fails the base rules;
    documents without a trusted set all score 0; repeated rows come back as
    they are, a null id is never trusted; an empty table gives no rows; other
    columns are not read.
    """
    ratios = stage(log_ratios(docs, trusted, id_col, text_col), "ratios")
    model = ratios.agg(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))).alias("m")).select(F.col("m.ratio").alias("m"))
    t = words(docs, id_col, text_col).withColumn("ratios", model.scalar())
    t = pin(t, n=F.size("w"), bits=F.ceil(F.log2(F.size("w") + 2.0)).cast("int"))
    shift = lambda x: F.call_function("shiftright", x, F.col("bits"))
    # windows of three words: hash above, position in the low bits, sorted
    packed = F.transform("w", lambda x, i: F.coalesce(
        F.call_function("shiftleft", F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)), F.col("bits")).bitwiseOR(i.cast("long")),
        F.lit(0).cast("long")))
    t = pin(t, keys=F.sort_array(F.slice(packed, 1, F.greatest(F.col("n") - 2, F.lit(0)))))
    twice = F.filter("keys", lambda x, i: (shift(x) == shift(F.get("keys", i - 1))) | (shift(x) == shift(F.get("keys", i + 1))))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    t = pin(t, mask=mask, twice=twice)
    # equal bits are only candidates: their words decide
    windows = F.sort_array(F.transform(F.transform("twice", lambda x: x.bitwiseAND(F.col("mask")).cast("int")), lambda p: F.struct(
        F.get("w", p).alias("a"), F.get("w", p + 1).alias("b"), F.get("w", p + 2).alias("c"), p.cast("long").alias("at"))))
    t = pin(t, windows=windows)
    same = lambda x, i: F.struct(x["a"], x["b"], x["c"]) == F.struct(*(F.get("windows", i)[c] for c in "abc"))
    equal = F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1))
    places = F.sort_array(F.transform(equal, lambda x: x["at"]))
    covered = F.aggregate(places, F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(3).cast("long"))).alias("n")),
                          lambda a: a["n"])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))
    add = lambda a, b: a + F.get("ratios", b)
    zero = F.lit(0.0)
    score = F.when(F.col("n") > 0, (F.aggregate(single_buckets(), zero, add) + F.aggregate(pair_buckets(), zero, add))
                   / (2 * F.col("n") - 1)).otherwise(zero)
    t = t.select("doc_id", F.col("n").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
                 F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                 (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                 covered.alias("n_repeat_words"), score.alias("score"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return t.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"), "score")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), trusted_ids(read(spark, sf_dir, "labels")))
