"""A1: raw source trees, listed and read by Spark tasks.

Spark's built-in ``binaryFile`` / ``text`` sources hide names starting with
``_`` or ``.`` -- they would lose every ``__init__.py`` -- so raw trees are
read here:

* ``list_tree`` expands a table of folders round by round: each task lists its
  folders and what lies below them, up to a number of entries, and hands the
  folders that it has not come to back to the table.  The driver names the
  roots and counts the rounds; no path passes through it.
* ``read_tree`` deals the listed files to partitions of about equal bytes, whose
  tasks read them.  The roots must therefore be on storage every executor sees.

Directories that the ignore rule drops anyway (B2) are not descended into.
Output columns match ``codelake.sources.corpus.ingest``: ``repo, path, content
BINARY, size_bytes, last_modified``, and ``error``, which names why a file or a
folder could not be read (its content is then NULL).
"""

from __future__ import annotations

import os
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions.constants import IGNORE_NAMES
from codelake.session import stage_parquet

ENTRIES_PER_TASK = 20_000        # that a task lists before it hands folders back
BYTES_PER_PARTITION = 128 << 20
BATCH_BYTES = 8 << 20
_TIME = pa.timestamp("us", tz="UTC")
_LISTED = pa.schema([("repo", pa.string()), ("root", pa.string()), ("path", pa.string()), ("is_dir", pa.bool_()),
                     ("size_bytes", pa.int64()), ("last_modified", _TIME), ("error", pa.string())])
_LISTED_DDL = "repo string, root string, path string, is_dir boolean, size_bytes bigint, last_modified timestamp, error string"
_READ = pa.schema([("repo", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("size_bytes", pa.int64()),
                   ("last_modified", _TIME), ("error", pa.string())])
SCHEMA = "repo string, path string, content binary, size_bytes bigint, last_modified timestamp, error string"


def _why(e: OSError) -> str:
    return f"{type(e).__name__}: {e.strerror}"


def _time(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, tz=timezone.utc)


def _scan(repo: str, root: str, folder: str):
    """Rows of one folder's files, and the paths of the folders in it."""
    rows, below = [], []
    try:
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir():
                    if not e.is_symlink() and e.name not in IGNORE_NAMES and not e.name.startswith("."):
                        below.append(path)
                    continue
                try:
                    st = e.stat()
                    rows.append((repo, root, path, False, st.st_size, _time(st.st_mtime), None))
                except OSError as err:
                    rows.append((repo, root, path, False, None, None, _why(err)))
    except OSError as err:
        rows.append((repo, root, folder, False, None, None, _why(err)))
    return rows, below


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _list(limit: int):
    def run(batches):
        seen = 0
        for b in batches:
            todo = list(zip(*(c.to_pylist() for c in b.columns), strict=True))[::-1]
            rows = []
            while todo:
                repo, root, folder = todo.pop()
                if seen >= limit:
                    rows.append((repo, root, folder, True, None, None, None))
                else:
                    files, below = _scan(repo, root, folder)
                    seen += len(files) + len(below) + 1
                    rows += files
                    todo += [(repo, root, x) for x in reversed(below)]
                if len(rows) >= 4096:
                    yield _batch(rows, _LISTED)
                    rows = []
            yield _batch(rows, _LISTED)
    return run


def list_tree(spark, *roots: str, entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """``(repo, root, path, size_bytes, last_modified, error)`` of every file
    below the roots (repo = root folder name); an unreadable folder is a row
    with its error."""
    start = [(os.path.basename(os.path.normpath(r)), r, "") for r in roots]
    frontier = spark.createDataFrame(start, "repo string, root string, path string")
    rounds = []
    while True:
        # folders of one parent go to different tasks
        dealt = frontier.repartition(spark.sparkContext.defaultParallelism, "root", "path")
        listed = stage_parquet(dealt.mapInArrow(_list(entries_per_task), _LISTED_DDL), "listing")
        rounds.append(listed.filter("not is_dir").drop("is_dir"))
        frontier = listed.filter("is_dir").select("repo", "root", "path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def _read_batches(batches):
    rows, size = [], 0
    for b in batches:
        for repo, root, path, n, mtime, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
            data = None
            if error is None:
                try:
                    with open(os.path.join(root, path), "rb") as fh:
                        data = fh.read()
                except OSError as e:  # vanished or unreadable: a row that says so, without content
                    n, mtime, error = None, None, _why(e)
            rows.append((repo, path, data, n if data is None else len(data), mtime, error))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows, _READ)
                rows, size = [], 0
    if rows:
        yield _batch(rows, _READ)


def read_tree(spark, *roots: str, files_per_partition: int = 10_000, bytes_per_partition: int = BYTES_PER_PARTITION,
              entries_per_task: int = ENTRIES_PER_TASK) -> DataFrame:
    """The files below one or more source trees, with their content."""
    listed = list_tree(spark, *roots, entries_per_task=entries_per_task)
    total = listed.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-total.size // bytes_per_partition), -(-total.n // files_per_partition))
    dealt = listed.select("repo", "root", "path", "size_bytes", "last_modified", "error").repartition(int(parts))
    return dealt.mapInArrow(_read_batches, SCHEMA)


def read_errors(tree: DataFrame) -> DataFrame:
    """The files and folders of a tree that could not be read, and why."""
    return tree.filter("error is not null").select("repo", "path", "error")
