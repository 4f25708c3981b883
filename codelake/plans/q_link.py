"""Registered linking and behaviour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.operators import behaviour as B
from codelake.operators import graph as G
from codelake.operators import pyfacts as P
from codelake.operators.pyast import py_nodes
from codelake.plans.catalog import KNOBS_BEH, KNOBS_PY, KNOBS_SUP, files_of, nodes_of, register, with_
from codelake.session import stage_parquet

LINK_CORPORA = ("corpus_py", "corpus_nations", "corpus_rel")
SUMMARY_FACTS = ("imports", "counts", "patterns", "smells")


def _edges(spark, sf):
    files = files_of(spark, sf, *LINK_CORPORA)
    nodes = py_nodes(files, facts="imports")
    return files, G.py_dependency_edges(P.py_imports(nodes), files)


EDGES_SQL = with_(KNOBS_PY, KNOBS_SUP) + """,
edges as (
  select repo, path as src,
         concat('nations/n_', sz % 25, case when (sz % 25) % 2 = 0 then '.py' else '/__init__.py' end) as dst
  from kp
  union
  select repo, concat('sup/s_', k, '.py'),
         concat('nations/n_', nk, case when nk % 2 = 0 then '.py' else '/__init__.py' end) from ks
  union
  select a.repo, concat('sup/s_', a.k, '.py'), concat('sup/s_', a.k + 8, '.py')
  from ks a join ks b on b.k = a.k + 8)
"""


@register("py_dependency_edges", EDGES_SQL + "select repo, src, dst from edges")
def q_py_dependency_edges(spark, sf):
    return _edges(spark, sf)[1]


@register("dependents", EDGES_SQL + "select repo, dst as path, src as dependent from edges")
def q_dependents(spark, sf):
    return G.dependents(_edges(spark, sf)[1])


ADJ_SQL = EDGES_SQL + """,
allfiles as (
  select repo, path from kp
  union all select repo, concat('sup/s_', k, '.py') from ks
  union all select concat('r', r), concat('nations/n_', n_nationkey,
                 case when n_nationkey % 2 = 0 then '.py' else '/__init__.py' end)
            from nation cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) v(r))
select f.repo, f.path, coalesce(string_agg(e.dst, ',' order by e.dst), '') as dependencies
from allfiles f left join edges e on e.repo = f.repo and e.src = f.path
group by f.repo, f.path
"""


@register("dependency_adjacency", ADJ_SQL)
def q_dependency_adjacency(spark, sf):
    files, edges = _edges(spark, sf)
    return G.dependency_adjacency(files, edges).select(
        "repo", "path", F.array_join("dependencies", ",").alias("dependencies"))


CALLS_ATTACH_SQL = with_(KNOBS_PY) + """
select repo, path, meth as name, concat('helper_', k % 11) as calls from kp
union all select repo, path, concat('helper_', k % 11), '' from kp
"""


@register("function_calls_attach", CALLS_ATTACH_SQL)
def q_function_calls_attach(spark, sf):
    nodes = stage_parquet(nodes_of(spark, sf, "corpus_py", facts="calls"))
    fns = P.py_functions(nodes).select("repo", "path", "def_pre", "name")
    return G.function_calls_attach(fns, P.py_file_calls(nodes)).select(
        "repo", "path", "name", F.array_join("calls", ",").alias("calls"))


CALLED_BY_SQL = with_(KNOBS_PY) + """,
cnt as (select repo, k % 11 h, count(*) n from kp group by repo, k % 11)
select repo, path, meth as name, cast(0 as bigint) as n_called_by from kp
union all
select kp.repo, kp.path, concat('helper_', kp.k % 11), cast(cnt.n - 1 as bigint)
from kp join cnt on cnt.repo = kp.repo and cnt.h = kp.k % 11
"""


@register("called_by", CALLED_BY_SQL)
def q_called_by(spark, sf):
    nodes = stage_parquet(nodes_of(spark, sf, "corpus_py", facts="calls"))
    fns = P.py_functions(nodes).select("repo", "path", "def_pre", "name")
    return G.called_by_counts(fns, P.py_file_calls(nodes)).select("repo", "path", "name", "n_called_by")


# ---------------------------------------------------------------- behaviour

BEHAVIOUR_SQL = with_(KNOBS_PY, KNOBS_BEH) + """
select repo, path, concat('fn_', k) as name, 2 as line_start, k % 5 = 1 as is_async, k % 5 = 2 as is_generator,
       k % 6 = 0 as is_recursive,
       concat_ws(', ', case when k % 4 = 0 then 'Uses global variable LIMIT' end,
                       case when k % 3 = 0 then 'Calls print' end) as side_effects,
       not (k % 4 = 0 or k % 3 = 0) as is_pure,
       case when k % 2 = 0 then 'KeyError,ValueError' else '' end as handled_exceptions,
       case when k % 6 = 0 then concat('fn_', k) else '' end as exit_points
from kb
union all
select repo, path, meth, 4, false, false, false, '', true, '', concat('helper_', k % 11) from kp
union all
select repo, path, concat('helper_', k % 11), 8 + depth + pad, false, false, false, '', true, '', '' from kp
"""


@register("function_behavior", BEHAVIOUR_SQL)
def q_function_behavior(spark, sf):
    b = B.function_behavior(nodes_of(spark, sf, "corpus_behaviour", "corpus_py", facts="behaviour"))
    return b.select("repo", "path", "name", "line_start", "is_async", "is_generator", "is_recursive",
                    F.array_join("side_effects", ", ").alias("side_effects"), "is_pure",
                    F.array_join("handled_exceptions", ",").alias("handled_exceptions"),
                    F.array_join("exit_points", ",").alias("exit_points"))


VARFLOW_SQL = with_(KNOBS_BEH) + """
select repo, path, concat('fn_', k) as function, name, scope, cast(na as bigint) as n_assignments,
       cast(nr as bigint) as n_reads
from (
  select repo, path, k, 'p' as name, 'parameter' as scope, 1 as na, 1 as nr from kb
  union all
  select repo, path, k, 'y', 'local', 1 + 2 * (k % 2 = 0)::int,
         (k % 3 = 0)::int + (k % 4 = 0)::int + (k % 5 = 2)::int + 1 from kb
  union all select repo, path, k, 'LIMIT', 'global', 1, 0 from kb where k % 4 = 0
  union all select repo, path, k, 'print', 'global', 0, 1 from kb where k % 3 = 0
  union all select repo, path, k, 'ValueError', 'global', 0, 1 from kb where k % 2 = 0
  union all select repo, path, k, 'KeyError', 'global', 0, 1 from kb where k % 2 = 0
  union all select repo, path, k, concat('fn_', k), 'global', 0, 1 from kb where k % 6 = 0) v
"""


@register("variable_flow", VARFLOW_SQL)
def q_variable_flow(spark, sf):
    f = B.variable_flow(nodes_of(spark, sf, "corpus_behaviour", facts="behaviour"))
    return f.select("repo", "path", "function", "name", "scope",
                    F.size("assignments").cast("bigint").alias("n_assignments"),
                    F.size("reads").cast("bigint").alias("n_reads"))


RET_LINE = "(4 + 2 * (k % 4 = 0)::int + (k % 3 = 0)::int + 4 * (k % 2 = 0)::int + (k % 5 = 2)::int)"

CONTROL_SQL = with_(KNOBS_PY, KNOBS_BEH) + f"""
select repo, path, {RET_LINE} as line_no, 'return' as node_type, cast(null as varchar) as condition,
       '' as true_branch, '' as false_branch
from kb
union all select repo, path, 7 + depth + pad, 'return', null, '', '' from kp
union all select repo, path, 9 + depth + pad, 'return', null, '', '' from kp
union all
select repo, path, 5 + j, 'if', 'x',
       case when j < depth then cast(6 + j as varchar)
            else (select string_agg(cast(x as varchar), ',' order by x) from range(6 + depth, 7 + depth + pad) t(x))
       end, ''
from kp, (select unnest(range(1, 6)) j) g where j <= depth
"""


@register("control_flow", CONTROL_SQL)
def q_control_flow(spark, sf):
    c = B.control_flow(nodes_of(spark, sf, "corpus_behaviour", "corpus_py", facts="flow"))
    return c.select("repo", "path", "line_no", "node_type", "condition",
                    F.array_join(F.transform("true_branch", lambda x: x.cast("string")), ",").alias("true_branch"),
                    F.array_join(F.transform("false_branch", lambda x: x.cast("string")), ",").alias("false_branch"))


RETURN_PATHS_SQL = with_(KNOBS_PY, KNOBS_BEH) + f"""
select repo, path, {RET_LINE} as line_no, cast({RET_LINE} as varchar) as path_lines from kb
union all
select repo, path, 7 + depth + pad,
       concat_ws(',', (select string_agg(cast(5 + j as varchar), ',' order by j) from range(1, depth + 1) t(j)),
                 cast(7 + depth + pad as varchar))
from kp
union all select repo, path, 9 + depth + pad, cast(9 + depth + pad as varchar) from kp
"""


@register("return_paths", RETURN_PATHS_SQL)
def q_return_paths(spark, sf):
    r = B.return_paths(nodes_of(spark, sf, "corpus_behaviour", "corpus_py", facts="returns"))
    return r.select("repo", "path", "line_no",
                    F.array_join(F.transform("path_lines", lambda x: x.cast("string")), ",").alias("path_lines"))


PREFIXES_SQL = with_(KNOBS_PY, KNOBS_BEH) + f"""
select repo, path, cast({RET_LINE} as varchar) as lines, cast(concat({RET_LINE}, '@', 1) as varchar) as returns from kb
union all
select repo, path, concat_ws(',', (select string_agg(cast(5 + j as varchar), ',' order by j) from range(1, depth + 1) t(j)),
                             cast(7 + depth + pad as varchar)), concat(7 + depth + pad, '@', depth + 1) from kp
union all select repo, path, cast(9 + depth + pad as varchar), concat(9 + depth + pad, '@', 1) from kp
"""


@register("return_prefixes", PREFIXES_SQL)
def q_return_prefixes(spark, sf):
    r = B.return_prefixes(nodes_of(spark, sf, "corpus_behaviour", "corpus_py", facts="returns"))
    return r.select("repo", "path", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"),
                    F.array_join(F.transform("returns", lambda x: F.concat_ws("@", x["line_no"], x["n"])), ",").alias("returns"))


CALLERS_SQL = with_(KNOBS_PY, KNOBS_BEH) + """
select repo, path, meth as caller, concat('helper_', k % 11) as callee from kp
union all select repo, path, concat('fn_', k), 'print' from kb where k % 3 = 0
union all select repo, path, concat('fn_', k), concat('fn_', k) from kb where k % 6 = 0
"""


@register("function_callers", CALLERS_SQL)
def q_function_callers(spark, sf):
    nodes = stage_parquet(nodes_of(spark, sf, "corpus_py", "corpus_behaviour", facts="calls"))
    calls = B.function_callers(nodes)
    defs = nodes.filter(F.col("kind").isin(P.DEF_KINDS)).select(
        "repo", "path", F.col("pre").alias("caller_pre"), F.col("name").alias("caller"))
    return calls.join(defs, ["repo", "path", "caller_pre"]).select("repo", "path", "caller", "callee")


ARCH_SQL = EDGES_SQL + """,
allf as (
  select repo, path from kp
  union all select repo, concat('sup/s_', k, '.py') from ks
  union all select concat('r', r), concat('nations/n_', n_nationkey,
                 case when n_nationkey % 2 = 0 then '.py' else '/__init__.py' end)
            from nation cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) v(r)),
parts as (select repo, string_split(path, '/') p from allf),
pref as (select repo, p, i, len(p) n from parts, range(1, len(p) + 1) t(i)),
tree as (
  select distinct repo, concat('1', coalesce(array_to_string(list_transform(p[1:i - 1], lambda x: concat('0', x, chr(1))), ''), ''),
         case when i < n then '0' else '1' end, p[i], chr(1)) as key,
         concat(repeat('  ', cast(i as bigint)), p[i], case when i < n then '/' else '' end) as line from pref
  union all select distinct repo, '1', concat(repo, '/') from allf),
fixed as (
  select distinct repo, '00' as key, 'Project Structure:' as line from allf
  union all select distinct repo, '01', '-----------------' from allf
  union all select distinct repo, '20', chr(10) || 'Entry Points:' from allf
  union all select distinct repo, '21', '-----------------' from allf
  union all select distinct repo, '22', 'No entry points identified' from allf
  union all select distinct repo, '30', chr(10) || 'File Organization:' from allf
  union all select distinct repo, '31', '-----------------' from allf
  union all select distinct repo, '40', chr(10) || 'Dependencies and Relationships:' from allf
  union all select distinct repo, '41', '-----------------' from allf),
org as (
  select repo, concat('32', path, chr(1), '0') as key, concat(chr(10), path, ':') as line from allf
  union all select repo, concat('32', path, chr(1), '1'), '  Functions:' from kp
  union all select repo, concat('32', path, chr(1), '2', lpad(cast(8 + depth + pad as varchar), 10, '0'), chr(1), 'helper_', k % 11),
            concat('    - helper_', k % 11) from kp
  union all select repo, concat('32', path, chr(1), '3'), '  Classes:' from kp
  union all select repo, concat('32', path, chr(1), '4', '0000000002', chr(1), cls, k), concat('    - ', cls, k) from kp
  union all select repo, concat('32sup/s_', k, '.py', chr(1), '1'), '  Functions:' from ks
  union all select repo, concat('32sup/s_', k, '.py', chr(1), '2', '0000000003', chr(1), 'go'), '    - go' from ks),
deps as (
  select distinct repo, concat('42', src, chr(1), '0') as key, concat(chr(10), src, ' depends on:') as line from edges
  union all select repo, concat('42', src, chr(1), '1', dst), concat('  - ', dst) from edges
  union all select distinct repo, concat('42', dst, chr(1), '2'), concat(chr(10), dst, ' is used by:') from edges
  union all select repo, concat('42', dst, chr(1), '3', src), concat('  - ', src) from edges)
select repo, 'architecture' as section, key, line from (
  select * from fixed union all select * from tree union all select * from org union all select * from deps) a
"""


@register("report_architecture", ARCH_SQL)
def q_report_architecture(spark, sf):
    from codelake.operators import classify as CL
    from codelake.operators import report as R
    files = files_of(spark, sf, *LINK_CORPORA)
    nodes = stage_parquet(py_nodes(files, facts=("imports", "defs")), "py_nodes")
    edges = G.py_dependency_edges(P.py_imports(nodes), files)
    return R.report_architecture(files, CL.structure_nodes(files), P.py_functions(nodes), P.py_classes(nodes), edges)


SUMMARY_SQL = ADJ_SQL.rsplit("select f.repo", 1)[0] + """,
adj as (select f.repo, f.path, coalesce(string_agg(e.dst, ',' order by e.dst), '') as dependencies
        from allfiles f left join edges e on e.repo = f.repo and e.src = f.path group by f.repo, f.path),
nd as (select repo, dst as path, count(distinct src) n from edges group by repo, dst),
sm as (select path, count(*) n from (
  select path from kp where 3 + depth + pad > 50
  union all select path from kp where np > 5
  union all select path from kp, (select unnest(range(4, 6)) j) g where j <= depth
  union all select path from kp where 5 + depth + pad > 200) s group by path),
facts as (
  select repo, path, 1 as nf, 1 as nc,
         coalesce(case k % 7 when 0 then 'Singleton' when 1 then 'Observer' when 2 then 'Factory'
                             when 3 then 'Strategy' when 4 then 'Observer' when 5 then 'Decorator' end, '') as pats
  from kp
  union all select repo, concat('sup/s_', k, '.py'), 1, 0, '' from ks)
select a.repo, a.path, 'python' as language, cast(coalesce(f.nf, 0) as bigint) as n_functions,
       cast(coalesce(f.nc, 0) as bigint) as n_classes, coalesce(f.pats, '') as design_patterns,
       cast(coalesce(sm.n, 0) as bigint) as n_smells, a.dependencies, cast(coalesce(nd.n, 0) as bigint) as n_dependents
from adj a left join facts f on f.repo = a.repo and f.path = a.path
left join sm on sm.path = a.path left join nd on nd.repo = a.repo and nd.path = a.path
"""


@register("file_summary", SUMMARY_SQL)
def q_file_summary(spark, sf):
    from codelake.operators import patterns as PT
    from codelake.operators import report as R
    from codelake.operators import smells as S
    files = files_of(spark, sf, *LINK_CORPORA)
    nodes = stage_parquet(py_nodes(files, facts=SUMMARY_FACTS), "py_nodes")
    edges = G.py_dependency_edges(P.py_imports(nodes), files)
    s = R.file_summary(files, nodes, PT.python_patterns(nodes), S.python_smells(nodes), edges)
    return s.select("repo", "path", "language", "n_functions", "n_classes",
                    F.array_join("design_patterns", ",").alias("design_patterns"), "n_smells",
                    F.array_join("dependencies", ",").alias("dependencies"), "n_dependents")


@register("function_caller_edges", with_(KNOBS_PY) + """,
h as (select repo, concat('helper_', k % 11) as callee, count(*) as n_targets from kp group by all)
select kp.repo, kp.path, kp.meth as "function", h.callee, h.n_targets
from kp join h on h.repo = kp.repo and h.callee = concat('helper_', kp.k % 11)
""")
def q_function_caller_edges(spark, sf):
    nodes = stage_parquet(nodes_of(spark, sf, "corpus_py", facts="calls"))
    return B.function_caller_edges(nodes).drop("caller_pre")


def _smells_sql():
    from codelake.plans import q_python as Q
    every = " union all ".join(f"select repo, path, type, line from ({x}) t{i}" for i, x in enumerate(
        (Q.ORACLE_LONG_METHOD, Q.ORACLE_TOO_MANY, Q.ORACLE_DEEP, Q.ORACLE_LARGE)))
    return f"""select repo, path, count(*) as n_smells, string_agg(type || '@' || line, ',' order by line, type) as smells
from ({every}) s group by repo, path"""


@register("file_smells", _smells_sql())
def q_file_smells(spark, sf):
    from codelake.operators import patterns as PT
    from codelake.operators import report as R
    from codelake.operators import smells as S
    files = files_of(spark, sf, "corpus_py")
    nodes = stage_parquet(py_nodes(files, facts=SUMMARY_FACTS), "py_nodes")
    s = R.file_summary(files, nodes, PT.python_patterns(nodes), S.python_smells(nodes), G.py_dependency_edges(P.py_imports(nodes), files))
    text = F.array_join(F.transform("smells", lambda x: F.concat(x["type"], F.lit("@"), x["line"])), ",")
    return s.filter("n_smells > 0").select("repo", "path", "n_smells", text.alias("smells"))


CALL_EDGES_SQL = """with kc as (select cast(s_suppkey as int) k, concat('r', cast(s_suppkey as int) % 8) repo,
  concat('calls/c_', cast(s_suppkey as int), '.py') path from supplier),
u as (select concat('r', r) repo, cast(n_nationkey as int) j, concat('calls/u_', n_nationkey, '.py') path
  from (select n_nationkey, unnest(range(8)) r from nation)),
n as (select repo, j % 3 m, count(*) n from u group by all)
select repo, path, 'run' as caller, 'self' as base, 'step' as callee, path as callee_path, 8 as callee_line, 'method' as how, cast(null as bigint) as n_targets from kc
union all select repo, path, 'run', '', 'h', concat('calls/u_', k % 25, '.py'), 1, 'import', null from kc
union all select repo, path, 'step', 'util', 'helper', concat('calls/u_', k % 25, '.py'), 1, 'module', null from kc
union all select repo, path, 'step', concat('u_', (k + 1) % 25), 'other', concat('calls/u_', (k + 1) % 25, '.py'), 3, 'module', null from kc
union all select kc.repo, path, 'nested', '', concat('unknown_', k % 3), null, null, 'name', n.n from kc join n on n.repo = kc.repo and n.m = k % 3
union all select repo, path, 'main', '', 'nested', path, 12, 'local', null from kc
union all select repo, path, 'main', '', concat('local_', k), path, 16, 'local', null from kc
union all select repo, path, 'other', '', 'helper', path, 1, 'local', null from u
"""


@register("call_edges", CALL_EDGES_SQL)
def q_call_edges(spark, sf):
    from codelake.operators.calls import call_edges
    files = files_of(spark, sf, "corpus_calls", "corpus_called")
    return call_edges(stage_parquet(py_nodes(files), "py_nodes"), files).drop("caller_pre", "callee_pre")
