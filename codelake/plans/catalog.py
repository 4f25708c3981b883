"""Registered queries: each renders its corpus from the given tables, runs
codelake operators, and returns a DataFrame with stable, aliased columns.

``ORACLE`` holds, for the same key, DuckDB SQL over the same tables: for
line/regex operators it recomputes the facts from the same text; for
syntax-tree operators it derives the expected facts from the knobs that
rendered the corpus (never parsing code).
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.sources import fixtures as X
from codelake.sources.corpus import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def files_of(spark: SparkSession, sf: str, *corpora: str) -> DataFrame:
    return ingest(X.render_many(spark, sf, *corpora))


def nodes_of(spark: SparkSession, sf: str, *corpora: str, facts: str | None = None) -> DataFrame:
    from codelake.operators.pyast import py_nodes
    return py_nodes(files_of(spark, sf, *corpora), facts=facts)


# knob tables the oracles derive expected facts from -------------------------

KNOBS_PY = """
kp as (select cast(p_partkey as int) k, p_size sz, p_size % 9 np,
        cast((p_partkey * 7) % 240 as int) pad, cast(p_partkey % 6 as int) depth,
        case p_partkey % 7 when 0 then '_instance' when 1 then 'observers' else 'value' end attr,
        case p_partkey % 7 when 2 then 'create_item' when 3 then 'run_strategy'
             when 4 then 'notify_all' else 'run' end meth,
        case p_partkey % 7 when 5 then 'Wrapper' else 'Model' end cls,
        concat('r', cast(p_partkey as int) % 8) repo,
        concat('pkg', p_size % 10, '/mod_', cast(p_partkey as int), '.py') path
      from part)
"""

KNOBS_BEH = """
kb as (select cast(s_suppkey as int) k, concat('r', cast(s_suppkey as int) % 8) repo,
        concat('beh/b_', cast(s_suppkey as int), '.py') path from supplier)
"""

KNOBS_SUP = """
ks as (select cast(s_suppkey as int) k, s_nationkey nk, concat('r', cast(s_suppkey as int) % 8) repo
       from supplier)
"""

KNOBS_NAT = """
kn as (select n_nationkey nk, n_name, concat('r', r) repo,
        concat('nations/n_', n_nationkey, case when n_nationkey % 2 = 0 then '.py' else '/__init__.py' end) path
       from nation cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) v(r))
"""


def with_(*parts: str) -> str:
    return "with " + ",".join(parts)


# import the query modules so their @register calls run
from codelake.plans import q_python  # noqa: E402,F401
from codelake.plans import q_link  # noqa: E402,F401
from codelake.plans import q_lines  # noqa: E402,F401
from codelake.plans import q_structure  # noqa: E402,F401
from codelake.plans import q_report  # noqa: E402,F401
from codelake.plans import q_dispatch  # noqa: E402,F401
