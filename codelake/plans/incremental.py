"""Incremental analysis of a corpus that changes (the optional stage of 2.O).

A snapshot is the table of content hashes by file.  Of a new state of the corpus
only files whose hash is new are extracted again; rows of changed and removed
files leave the tables by an anti join.  Dependency edges are linked again where
the importing file changed, and where a candidate of an import appeared or went.
The result equals that of a whole run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators import graph as G
from codelake.session import stage_parquet

FILE = ["repo", "path"]
Tables = dict[str, DataFrame]


@dataclass
class State:
    """``snapshot`` (repo, path, hash), ``tables`` keyed by file, and ``links``:
    (repo, src, imp, dst) of the imports that are resolved."""
    snapshot: DataFrame
    tables: Tables
    links: DataFrame

    @property
    def edges(self) -> DataFrame:
        return self.links.select("repo", "src", "dst").distinct()


def snapshot(files: DataFrame) -> DataFrame:
    return files.select(*FILE, F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


def _staged(tables: Tables) -> Tables:
    return {name: stage_parquet(t, name) for name, t in tables.items()}


def _link(imports: DataFrame, files: DataFrame) -> DataFrame:
    m = G.py_module_paths(imports).withColumn("imp", F.struct("stmt_pre", "ord"))
    return G.resolve_first(m, files, G.PY_SUFFIXES)


def full_run(files: DataFrame, extract: Callable[[DataFrame], Tables]) -> State:
    """``extract`` maps files to tables keyed by (repo, path), ``py_imports``
    among them."""
    tables = _staged(extract(files))
    return State(stage_parquet(snapshot(files), "snapshot"), tables, stage_parquet(_link(tables["py_imports"], files), "links"))


def refresh(state: State, files: DataFrame, extract: Callable[[DataFrame], Tables]) -> State:
    """The state of ``files`` from an earlier ``state``."""
    now = stage_parquet(snapshot(files), "snapshot")
    # paths that are new, changed or gone
    both = now.withColumnRenamed("hash", "new").join(state.snapshot.withColumnRenamed("hash", "old"), FILE, "full_outer")
    moved = stage_parquet(both.filter("not new <=> old"), "moved")
    paths = moved.select(*FILE)
    fresh = extract(files.join(paths, FILE, "left_semi"))
    tables = _staged({name: t.join(paths, FILE, "left_anti").unionByName(fresh[name]) for name, t in state.tables.items()})
    # files whose imports may resolve differently: they changed themselves, or
    # a path that one of their imports tries came into being or vanished
    come_or_gone = moved.filter("new is null or old is null").select("repo", F.col("path").alias("dst"))
    tried = G.py_module_paths(tables["py_imports"]).select("repo", "path", F.explode(F.array(
        *(F.concat("module_path", F.lit(s)) for s in G.PY_SUFFIXES))).alias("dst"))
    again = stage_parquet(tried.join(come_or_gone, ["repo", "dst"], "left_semi").select(*FILE).union(paths).distinct(), "again")
    src = again.withColumnRenamed("path", "src")
    links = state.links.join(src, ["repo", "src"], "left_anti").unionByName(_link(tables["py_imports"].join(again, FILE, "left_semi"), files))
    return State(now, tables, stage_parquet(links, "links"))
