"""The analysis of a corpus as nested documents, one a file.

Documents are assembled from the bottom up: methods and variables into their
class, classes and functions into their file.  A file is the largest value, so
a repo of any size is as many JSON lines as it has files, and one line of a
manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["repo", "path"]


def _sorted(items: DataFrame, keys: list[str], order: str, name: str, *cols: str) -> DataFrame:
    """``cols`` of the rows of each key as a list in the order of ``order``."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*cols).alias("_v"))))
    return items.groupBy(*keys).agg(F.transform(got, lambda x: x["_v"]).alias(name))


def _lists(df: DataFrame, *names: str) -> DataFrame:
    """Missing lists as empty ones."""
    for n in names:
        df = df.withColumn(n, F.coalesce(n, F.array().cast(df.schema[n].dataType)))
    return df


def file_documents(files: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame, imports: DataFrame) -> DataFrame:
    """``(repo, path, language, imports, functions, classes, variables)`` of
    every file, with the methods and variables of a class inside it.  Inputs are
    the tables of ``pyfacts``; a file without facts has empty lists."""
    f = functions.withColumn("args", F.transform("args", lambda a: F.struct(a["name"], a["type"])))
    cols = ["name", "args", "returns", "docstring", "decorators", "line_start", "line_end"]
    methods = _sorted(f.filter("owner_pre is not null"), [*FILE, "owner_pre"], "def_pre", "methods", *cols)
    fields = _sorted(variables.filter("owner_pre is not null"), [*FILE, "owner_pre"], "assign_pre", "variables", "name", "value", "line_start")
    c = (classes.join(methods, [(classes[k] == methods[k]) for k in FILE] + [classes["class_pre"] == methods["owner_pre"]], "left")
         .select(*(classes[x] for x in classes.columns), "methods"))
    c = (c.join(fields.withColumnRenamed("owner_pre", "class_pre"), [*FILE, "class_pre"], "left"))
    c = _lists(c, "methods", "variables")
    per_file = [
        _sorted(imports.withColumn("_at", F.struct("stmt_pre", "ord")), FILE, "_at", "imports", "module", "name", "alias", "level", "line_no"),
        _sorted(f.filter("owner_pre is null"), FILE, "def_pre", "functions", *cols),
        _sorted(c, FILE, "class_pre", "classes", "name", "base_classes", "docstring", "decorators", "line_start", "line_end", "methods", "variables"),
        _sorted(variables.filter("owner_pre is null"), FILE, "assign_pre", "variables", "name", "value", "line_start")]
    out = files.select("repo", "path", "language")
    for p in per_file:
        out = out.join(p, FILE, "left")
    return _lists(out, "imports", "functions", "classes", "variables")


def manifest(documents: DataFrame) -> DataFrame:
    """One row a repo: how many files, functions (methods included) and classes
    its documents hold."""
    n = lambda c: F.sum(F.size(c)).cast("bigint")
    methods = F.sum(F.aggregate("classes", F.lit(0), lambda a, c: a + F.size(c["methods"]))).cast("bigint")
    return documents.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files"), (n("functions") + methods).alias("n_functions"), n("classes").alias("n_classes"))


def export_documents(documents: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    """Write the documents as JSON lines, in one folder a repo, and the manifest."""
    root = out_dir.rstrip("/")
    documents.write.mode(mode).option("ignoreNullFields", "false").partitionBy("repo").json(f"{root}/files")
    manifest(documents).write.mode(mode).json(f"{root}/manifest")
