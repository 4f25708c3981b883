"""Corpus-level classification and structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.functions import text as T


def analysable(files: DataFrame) -> DataFrame:
    """Languages with an extractor."""
    return files.filter(F.col("language").isin(K.ANALYSABLE_LANGUAGES))


def quality_files(files: DataFrame) -> DataFrame:
    """Languages the quality rules look at."""
    return files.filter(F.col("language").isin(K.QUALITY_LANGUAGES))


def behaviour_files(files: DataFrame) -> DataFrame:
    """Python only."""
    return files.filter(F.col("language") == "python")


def project_totals(files: DataFrame) -> DataFrame:
    """File count and total size per repo."""
    return files.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"),
                                     F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("total_size"))


def language_counts(files: DataFrame) -> DataFrame:
    """Files per language per repo ('unknown' included)."""
    return files.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"))


def line_count(content) -> F.Column:
    """``len(text.splitlines())`` after newline normalisation."""
    c = F.col(content) if isinstance(content, str) else content
    return F.coalesce(F.size(T.split_lines(c)), F.lit(0)).cast("bigint")


def total_lines(files: DataFrame) -> DataFrame:
    """Total line count per repo (declared but never filled by the reference)."""
    return files.groupBy("repo").agg(F.sum(line_count("content")).cast("bigint").alias("total_lines"))


def entry_points(files: DataFrame) -> DataFrame:
    """Files whose lower-cased name is a conventional entry point."""
    return files.filter(F.lower("name").isin(K.ENTRY_POINT_NAMES)).select("repo", "path")


def structure_nodes(files: DataFrame) -> DataFrame:
    """A4: every directory and file as an adjacency row.

    ``parts[1..i]`` for i = 1..n gives each prefix; directories repeat
    across files, so rows are de-duplicated per ``(repo, path, is_dir)`` -- a
    shuffle keyed on the node path, with map-side partial dedup.  The repo
    root is level 0 with an empty path.
    """
    parts = F.split("path", "/")
    ex = files.select("repo", parts.alias("parts"), "size_bytes", "last_modified",
                      F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    is_file = F.col("i") == F.size("parts")
    nodes = ex.select(
        "repo",
        F.array_join(F.slice("parts", 1, F.col("i")), "/").alias("path"),
        F.array_join(F.slice("parts", 1, F.col("i") - 1), "/").alias("parent_path"),
        F.element_at("parts", F.col("i")).alias("name"),
        (~is_file).alias("is_dir"),
        F.col("i").alias("level"),
        F.when(is_file, F.col("size_bytes")).alias("size_bytes"),
        F.when(is_file, F.col("last_modified")).alias("last_modified"),
        # sort key of the depth-first, directories-first tree order (K2):
        # per component a flag (0 dir, 1 file), the name, and a separator
        # below every printable character
        F.concat(F.array_join(F.transform(F.slice("parts", 1, F.col("i") - 1),
                                          lambda p: F.concat(F.lit("0"), p, F.lit("\u0001"))), ""),
                 F.when(is_file, F.lit("1")).otherwise(F.lit("0")),
                 F.element_at("parts", F.col("i")), F.lit("\u0001")).alias("tree_key"))
    # a path can name both a file and a directory (URL-derived trees):
    # the node identity is (repo, path, is_dir), which keeps the result
    # deterministic
    same = ["parent_path", "name", "level", "tree_key"]  # functions of the key
    nodes = (nodes.groupBy("repo", "path", "is_dir")
                  .agg(*(F.max(c).alias(c) for c in (*same, "size_bytes", "last_modified")))
                  .select(*nodes.columns))
    roots = files.select("repo").distinct().select(
        "repo", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent_path"),
        F.col("repo").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).alias("level"),
        F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("timestamp").alias("last_modified"),
        F.lit("").alias("tree_key"))
    return roots.unionByName(nodes)


def tree_text(structure: DataFrame) -> DataFrame:
    """The indented tree as ordered lines (``dir/`` for directories).

    One row per node; ``tree_key`` orders the lines depth-first with
    directories before files, so the text is written with an ``orderBy``
    rather than concatenated into one value per repo.
    """
    return structure.select("repo", "tree_key",
                            F.concat(F.repeat(F.lit("  "), F.col("level")), F.col("name"),
                                     F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit(""))).alias("line"))
