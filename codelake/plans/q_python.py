"""Registered Python-syntax queries (C, I3, I4, J7, L1-L4, L9-L13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.operators import patterns as PT
from codelake.operators import pyfacts as P
from codelake.operators import smells as S
from codelake.plans.catalog import (KNOBS_BEH, KNOBS_NAT, KNOBS_PY, KNOBS_SUP, files_of, nodes_of,
                                    register, with_)

SMELL_COLS = ["repo", "path", "type", "name", "line", "message"]

# ---------------------------------------------------------------- smells

ORACLE_LONG_METHOD = with_(KNOBS_PY) + """
select repo, path, 'Long Method' as type, meth as name, 4 as line,
       concat('Method is ', 3 + depth + pad, ' lines long (max 50)') as message
from kp where 3 + depth + pad > 50
"""
ORACLE_TOO_MANY = with_(KNOBS_PY) + """
select repo, path, 'Too Many Parameters' as type, meth as name, 4 as line,
       concat('Method has ', np, ' parameters (max 5)') as message
from kp where np > 5
"""
ORACLE_DEEP = with_(KNOBS_PY) + """
select repo, path, 'Deep Nesting' as type, cast(null as varchar) as name, 5 + j as line,
       concat('Code is nested ', j, ' levels deep (max 3)') as message
from kp, (select unnest(range(4, 6)) j) g where j <= depth
"""
ORACLE_LARGE = with_(KNOBS_PY) + """
select repo, path, 'Large Class' as type, concat(cls, k) as name, 2 as line,
       concat('Class is ', 5 + depth + pad, ' lines long (max 200)') as message
from kp where 5 + depth + pad > 200
"""


@register("smell_long_method", ORACLE_LONG_METHOD)
def q_smell_long_method(spark, sf):
    return S.smell_long_method(nodes_of(spark, sf, "corpus_py", facts="smells")).select(*SMELL_COLS)


@register("smell_too_many_parameters", ORACLE_TOO_MANY)
def q_smell_too_many_parameters(spark, sf):
    return S.smell_too_many_parameters(nodes_of(spark, sf, "corpus_py", facts="smells")).select(*SMELL_COLS)


@register("smell_deep_nesting", ORACLE_DEEP)
def q_smell_deep_nesting(spark, sf):
    return S.smell_deep_nesting(nodes_of(spark, sf, "corpus_py", facts="smells")).select(*SMELL_COLS)


@register("smell_large_class", ORACLE_LARGE)
def q_smell_large_class(spark, sf):
    return S.smell_large_class(nodes_of(spark, sf, "corpus_py", facts="smells")).select(*SMELL_COLS)


ORACLE_SMELL_COUNTS = with_(KNOBS_PY) + """
select repo, type, count(*) as n from (
  select repo, 'Long Method' as type from kp where 3 + depth + pad > 50
  union all select repo, 'Too Many Parameters' from kp where np > 5
  union all select repo, 'Deep Nesting' from kp, (select unnest(range(4, 6)) j) g where j <= depth
  union all select repo, 'Large Class' from kp where 5 + depth + pad > 200) s
group by repo, type
"""


@register("smell_counts", ORACLE_SMELL_COUNTS)
def q_smell_counts(spark, sf):
    return S.smell_counts(S.python_smells(nodes_of(spark, sf, "corpus_py", facts="smells")))


@register("recurring_smells", ORACLE_SMELL_COUNTS.replace("group by repo, type", "group by repo, type having count(*) > 3"))
def q_recurring_smells(spark, sf):
    return S.recurring_smells(S.python_smells(nodes_of(spark, sf, "corpus_py", facts="smells")))


# ---------------------------------------------------------------- definitions

ORACLE_FUNCTIONS = with_(KNOBS_PY) + """
select repo, path, meth as name, concat(cls, k) as owner_class,
       concat('self', replace(substr(', a1, a2, a3, a4, a5, a6, a7, a8', 1, 4 * np), ', ', ',')) as args,
       cast(null as varchar) as returns, 4 as line_start, 7 + depth + pad as line_end, false as is_async,
       cast(0 as bigint) as n_decorators
from kp
union all
select repo, path, concat('helper_', k % 11), cast(null as varchar), 'v', cast(null as varchar),
       8 + depth + pad, 9 + depth + pad, false, cast(0 as bigint)
from kp
"""


def _fn_out(fns):
    args = F.array_join(F.transform("args", lambda a: F.concat(a["name"], F.coalesce(
        F.concat(F.lit(":"), a["type"]), F.lit("")))), ",")
    return fns.select("repo", "path", "name", "owner_class", args.alias("args"), "returns", "line_start",
                      "line_end", "is_async", F.size("decorators").cast("bigint").alias("n_decorators"))


@register("py_functions", ORACLE_FUNCTIONS)
def q_py_functions(spark, sf):
    return _fn_out(P.py_functions(nodes_of(spark, sf, "corpus_py", "corpus_nations", facts="defs")))


@register("py_methods", ORACLE_FUNCTIONS.split("union all")[0])
def q_py_methods(spark, sf):
    return _fn_out(P.py_functions(nodes_of(spark, sf, "corpus_py", facts="defs")).filter(F.col("owner_class").isNotNull()))


ORACLE_CLASSES = with_(KNOBS_PY) + """
select repo, path, concat(cls, k) as name, '' as base_classes, cast(null as varchar) as docstring,
       2 as line_start, 7 + depth + pad as line_end
from kp
"""


@register("py_classes", ORACLE_CLASSES)
def q_py_classes(spark, sf):
    return P.py_classes(nodes_of(spark, sf, "corpus_py", "corpus_nations", facts="defs")).select(
        "repo", "path", "name", F.array_join("base_classes", ",").alias("base_classes"), "docstring",
        "line_start", "line_end")


ORACLE_IMPORTS = with_(KNOBS_PY, KNOBS_SUP) + """
select repo, path, concat('nations.n_', sz % 25) as module, cast(null as varchar) as name,
       cast(null as varchar) as alias, 0 as level, false as is_from_import, 1 as line_no
from kp
union all
select repo, concat('sup/s_', k, '.py'), concat('nations.n_', nk), 'NAME', null, 2, true, 1 from ks
union all
select repo, concat('sup/s_', k, '.py'), concat('s_', k + 8), 'go', null, 1, true, 2 from ks
"""


@register("py_imports", ORACLE_IMPORTS)
def q_py_imports(spark, sf):
    return P.py_imports(nodes_of(spark, sf, "corpus_py", "corpus_rel", facts="imports")).drop("stmt_pre", "ord")


ORACLE_RAW_DEPS = with_(KNOBS_PY, KNOBS_SUP) + """
select repo, path, 'nations' as dependency from kp
union all select repo, concat('sup/s_', k, '.py'), concat('..nations.n_', nk) from ks
union all select repo, concat('sup/s_', k, '.py'), concat('.s_', k + 8) from ks
"""


@register("py_raw_dependencies", ORACLE_RAW_DEPS)
def q_py_raw_dependencies(spark, sf):
    return P.py_raw_dependencies(P.py_imports(nodes_of(spark, sf, "corpus_py", "corpus_rel", facts="imports")))


ORACLE_VARIABLES = with_(KNOBS_NAT, KNOBS_BEH) + """
select repo, path, 'NAME' as name, concat(chr(39), n_name, chr(39)) as value, 'module' as scope,
       1 as line_start
from kn
union all select repo, path, 'LIMIT', '3', 'module', 1 from kb
"""


@register("py_variables", ORACLE_VARIABLES)
def q_py_variables(spark, sf):
    return P.py_variables(nodes_of(spark, sf, "corpus_nations", "corpus_behaviour", "corpus_py", facts="variables")).select(
        "repo", "path", "name", "value", "scope", "line_start")


ORACLE_CALLS = with_(KNOBS_PY, KNOBS_BEH) + """
select repo, path, concat('helper_', k % 11) as callee from kp
union all select repo, path, 'print' from kb where k % 3 = 0
union all select repo, path, concat('fn_', k) from kb where k % 6 = 0
"""


@register("py_file_calls", ORACLE_CALLS)
def q_py_file_calls(spark, sf):
    return P.py_file_calls(nodes_of(spark, sf, "corpus_py", "corpus_behaviour", facts="calls"))


ORACLE_COMPLEXITY = with_(KNOBS_PY, KNOBS_BEH) + """
select repo, path, meth as name, 4 as line_start, 1 + depth as complexity from kp
union all select repo, path, concat('helper_', k % 11), 8 + depth + pad, 1 from kp
union all select repo, path, concat('fn_', k), 2, case when k % 2 = 0 then 2 else 1 end from kb
"""


@register("py_complexity", ORACLE_COMPLEXITY)
def q_py_complexity(spark, sf):
    return P.py_complexity(nodes_of(spark, sf, "corpus_py", "corpus_behaviour", facts="complexity")).drop("def_pre")


ORACLE_NESTING = with_(KNOBS_PY) + """
select repo, path, 'If' as kind, 5 + j as line, j as depth
from kp, (select unnest(range(1, 6)) j) g where j <= depth
"""


@register("py_nesting", ORACLE_NESTING)
def q_py_nesting(spark, sf):
    return P.py_nesting(nodes_of(spark, sf, "corpus_py", facts="smells")).drop("pre")


ORACLE_DEF_COUNTS = with_(KNOBS_PY, KNOBS_NAT) + """
select repo, path, cast(1 as bigint) as n_functions, cast(1 as bigint) as n_classes from kp
union all select repo, path, 0, 0 from kn
"""


@register("file_definition_counts", ORACLE_DEF_COUNTS)
def q_file_definition_counts(spark, sf):
    files = files_of(spark, sf, "corpus_py", "corpus_nations")
    from codelake.operators.pyast import py_nodes
    nodes = py_nodes(files, facts="counts")
    return P.file_definition_counts(files, nodes)


ORACLE_PY_PATTERNS = with_(KNOBS_PY) + """
select repo, path, case k % 7 when 0 then 'Singleton' when 1 then 'Observer' when 2 then 'Factory'
                              when 3 then 'Strategy' when 4 then 'Observer' when 5 then 'Decorator' end as pattern
from kp where k % 7 <> 6
"""


@register("python_patterns", ORACLE_PY_PATTERNS)
def q_python_patterns(spark, sf):
    return PT.python_patterns(nodes_of(spark, sf, "corpus_py", "corpus_nations", facts="patterns")).drop("ord")


BAD_FILES = """with kb as (select cast(p_partkey as int) k, concat('r', cast(p_partkey as int) % 8) repo,
  concat('bad/b_', cast(p_partkey as int), '.py') path from part)
"""
ORACLE_PARSE_ERRORS = BAD_FILES + "select repo, path from kb where k % 7 = 0 or k % 13 = 0"


@register("parse_errors", ORACLE_PARSE_ERRORS)
def q_parse_errors(spark, sf):
    from codelake.operators.pyast import parse_errors
    return parse_errors(nodes_of(spark, sf, "corpus_py", "corpus_nations", "corpus_rel",
                                 "corpus_behaviour", "corpus_bad", facts="imports")).select("repo", "path")


@register("isolated_functions", BAD_FILES + """
select repo, path, concat('good_', k) as name from kb where k % 7 <> 0 and k % 13 <> 0
""")
def q_isolated_functions(spark, sf):
    """The good neighbours of bad files keep their functions."""
    return P.py_functions(nodes_of(spark, sf, "corpus_bad", facts="defs")).select("repo", "path", "name")


@register("distinct_return_calls", with_(KNOBS_PY) + """
select repo, path, meth as name, cast(1 as bigint) as n_return_calls, false as creates_objects from kp
""")
def q_distinct_return_calls(spark, sf):
    return P.distinct_return_calls(nodes_of(spark, sf, "corpus_py", facts="calls")).drop("def_pre")


@register("functions_by_name", ORACLE_FUNCTIONS)
def q_functions_by_name(spark, sf):
    return _fn_out(P.dedupe_by_name(P.py_functions(nodes_of(spark, sf, "corpus_py", "corpus_nations", facts="defs"))))
