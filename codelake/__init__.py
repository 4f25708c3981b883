"""codelake: source-code corpus analytics as Spark DataFrame operators.

A corpus is a DataFrame keyed by ``(repo, path)`` holding file text. Every
operator takes DataFrames and returns DataFrames; the only per-row Python is
the syntax-tree flatten job in :mod:`codelake.operators.pyast`.
"""

from codelake.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
