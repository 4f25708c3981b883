"""Corpus ingest: a lake table of files -> the ``src_files`` table (A2, A3, B1, B2).

Input columns: ``repo``, ``path`` (relative to the repo root), ``content``
(STRING or BINARY) and optionally ``size_bytes`` / ``last_modified``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from codelake.functions import text as T

SRC_FILES_COLUMNS = ["repo", "path", "name", "ext", "language", "size_bytes", "last_modified",
                     "encoding", "content"]


def decode_text(df: DataFrame, content: str = "content") -> DataFrame:
    """UTF-8 decode with text-mode newlines (A2).

    Undecodable files get ``content = NULL`` (the reference skips them); the
    flag ``is_binary`` (A6) is kept so callers can report them.
    """
    c = F.col(content)
    if isinstance(df.schema[content].dataType, BinaryType):
        c = c.cast("string")
    ok = F.is_valid_utf8(c)
    return (df.withColumn("is_binary", F.coalesce(~ok, F.lit(False)))
              .withColumn(content, F.when(ok, T.newline_normalise(c))))


def ingest(df: DataFrame, keep_ignored: bool = False) -> DataFrame:
    """Classify a raw corpus into ``src_files``.

    * ``name``/``ext``/``language`` from the path (B1, with the ``.svelte``
      entry of ledger Q1);
    * ignore rule on the relative path (B2, Q2); ignored files are dropped
      unless ``keep_ignored``;
    * ``size_bytes`` defaults to the UTF-8 byte length; ``last_modified`` to
      NULL when the source has no modification time (A3).
    """
    cols = set(df.columns)
    size = F.col("size_bytes").cast("bigint") if "size_bytes" in cols else F.octet_length("content").cast("bigint")
    mtime = F.col("last_modified").cast("timestamp") if "last_modified" in cols else F.lit(None).cast("timestamp")
    out = (df.withColumn("size_bytes", size)
             .withColumn("last_modified", mtime)
             .transform(decode_text)
             .withColumn("name", T.base_name("path"))
             .withColumn("ext", T.suffix("name"))
             .withColumn("language", T.language_of("name"))
             .withColumn("encoding", F.lit("utf-8"))
             .withColumn("ignored", T.is_ignored("path")))
    if not keep_ignored:
        out = out.filter(~F.col("ignored"))
    return out.select(*SRC_FILES_COLUMNS, "is_binary")


def files_by_language(files: DataFrame, *languages: str) -> DataFrame:
    """All readable files of the given languages."""
    return files.filter(F.col("language").isin(list(languages)) & F.col("content").isNotNull())


def file_metadata(files: DataFrame) -> DataFrame:
    """Per-file metadata with the ISO timestamp string of the reference (A3)."""
    return files.select("repo", "path", "language", "encoding", "size_bytes",
                        F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"))
