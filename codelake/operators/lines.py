"""``src_lines``: one row per source line (native ``split`` + ``posexplode``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import text as T


def src_lines(files: DataFrame, languages=None, splitlines: bool = False) -> DataFrame:
    """Explode readable files into ``(repo, path, language, line_no, line, stripped,
    n_lines)``, the last of which counts the file's lines.

    ``split(content, '\\n', -1)`` keeps trailing empty strings like Python's
    ``str.split('\\n')``; line numbers are 1-based (ledger Q9).  With
    ``splitlines`` the lines are those of ``str.splitlines()``, by which line
    smells are numbered.  The file
    text is dropped right after the explode, so downstream stages never
    carry it.
    """
    f = files.filter(F.col("content").isNotNull())
    if languages is not None:
        f = f.filter(F.col("language").isin(list(languages)))
    f = f.select("repo", "path", "language", (T.split_lines("content") if splitlines else F.split("content", "\n", -1)).alias("all"))
    return (f.select("repo", "path", "language", F.size("all").alias("n_lines"), F.posexplode("all").alias("pos", "line"))
             .select("repo", "path", "language", (F.col("pos") + 1).cast("int").alias("line_no"), "line",
                     T.py_strip("line").alias("stripped"), "n_lines"))
