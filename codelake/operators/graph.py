"""Linking joins (H1-H6, I5, J1, K4): dependency edges, dependents, call sets.

Dependency resolution is a candidate list per import, ``posexplode``d and
equi-joined to the file list; the first existing candidate wins (J1) via a
``min_by`` per import -- no window, no nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import text as T

PY_SUFFIXES = [".py", "/__init__.py"]
JS_SUFFIXES = [".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"]


def _dir_parts(path_col="path"):
    d = T.parent_dir(path_col)
    return F.when(d == "", F.array().cast("array<string>")).otherwise(F.split(d, "/"))


def normalise_path(parts):
    """Resolve '.', '' and '..' components (push/pop with ``aggregate``)."""
    return F.aggregate(parts, F.array().cast("array<string>"),
                       lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                                       .when(p.isin(".", ""), acc)
                                       .otherwise(F.concat(acc, F.array(p))))


def py_module_paths(imports: DataFrame) -> DataFrame:
    """H2: the project-relative module path of each Python import.

    Absolute: dots become slashes.  Relative (``level`` > 0, ledger Q4):
    level 1 is the importing file's directory, each further level one up.
    """
    rel = F.col("is_from_import") & (F.col("level") > 0)
    up = F.slice(_dir_parts(), 1, F.greatest(F.size(_dir_parts()) - (F.col("level") - 1), F.lit(0)))
    mod_parts = F.when(F.col("module") == "", F.array().cast("array<string>")).otherwise(
        F.split("module", r"\."))
    rel_path = F.array_join(F.concat(up, mod_parts), "/")
    return imports.select("repo", "path", "stmt_pre", "ord",
                          F.when(rel, rel_path).otherwise(F.regexp_replace("module", r"\.", "/")).alias("module_path"))


def resolve_first(cands: DataFrame, files: DataFrame, suffixes) -> DataFrame:
    """Equi-join candidates to existing files; keep the first per import."""
    c = cands.select("repo", F.col("path").alias("src"), "imp",
                     F.posexplode(F.array(*[F.concat(F.col("module_path"), F.lit(s)) for s in suffixes]))
                     .alias("pos", "dst"))
    existing = files.select("repo", F.col("path").alias("dst"))
    hit = c.join(existing, ["repo", "dst"], "left_semi")
    return hit.groupBy("repo", "src", "imp").agg(F.min_by("dst", "pos").alias("dst"))


def py_dependency_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """H1: Python file -> file edges (deduplicated, K4)."""
    m = py_module_paths(imports).withColumn("imp", F.struct("stmt_pre", "ord"))
    return resolve_first(m, files, PY_SUFFIXES).drop("imp").distinct()


def js_module_paths(deps: DataFrame) -> DataFrame:
    """H3: relative JS specifiers resolved against the importing directory
    (ledger Q7)."""
    parts = F.concat(_dir_parts(), F.split("dependency", "/"))
    return deps.select("repo", "path", "imp", F.array_join(normalise_path(parts), "/").alias("module_path"))


def js_dependency_edges(deps: DataFrame, files: DataFrame) -> DataFrame:
    """H3: JS/TS file -> file edges over the six candidate suffixes."""
    return resolve_first(js_module_paths(deps), files, JS_SUFFIXES).drop("imp").distinct()


def dependents(edges: DataFrame) -> DataFrame:
    """H4: reverse edges as rows ``(repo, path, dependent)``.  Kept as rows,
    not one list per target, so a module imported by a third of the corpus
    is never gathered into one value."""
    return edges.select("repo", F.col("dst").alias("path"), F.col("src").alias("dependent")).distinct()


def dependency_adjacency(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Each file with its sorted successors; isolated files keep an
    empty list (a file's successors are bounded by its own imports)."""
    succ = edges.groupBy("repo", F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("deps"))
    return (files.select("repo", "path").join(succ, ["repo", "path"], "left")
                 .select("repo", "path", F.coalesce("deps", F.array().cast("array<string>")).alias("dependencies")))


def function_calls_attach(functions: DataFrame, file_calls: DataFrame) -> DataFrame:
    """H5: every function gets its file's call set minus its own name."""
    sets = file_calls.groupBy("repo", "path").agg(F.array_sort(F.collect_set("callee")).alias("calls"))
    return (functions.join(sets, ["repo", "path"], "left")
                     .withColumn("calls", F.array_remove(F.coalesce("calls", F.array().cast("array<string>")),
                                                         F.col("name"))))


def called_by_counts(functions: DataFrame, file_calls: DataFrame) -> DataFrame:
    """H6: for each function, the number of *other* files of its repo whose
    call set holds its name.

    Name-level caller counts are pre-aggregated (map-side partial counts)
    before the join, so a very common name (``get``) contributes one row per
    repo, never one row per caller pair; the own-file exclusion is a
    separate semi-join.  The caller files themselves are the rows of
    ``file_calls`` with that callee.
    """
    per_name = (file_calls.groupBy("repo", F.col("callee").alias("name"))
                          .agg(F.count(F.lit(1)).alias("n_files")))
    own = file_calls.select("repo", "path", F.col("callee").alias("name"), F.lit(1).alias("own"))
    return (functions.join(per_name, ["repo", "name"], "left")
                     .join(own, ["repo", "path", "name"], "left")
                     .withColumn("n_called_by", (F.coalesce("n_files", F.lit(0)) - F.coalesce("own", F.lit(0)))
                                 .cast("bigint"))
                     .drop("n_files", "own"))

