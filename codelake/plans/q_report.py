"""Registered report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.operators import behaviour as B
from codelake.operators import patterns as PT
from codelake.operators import pyfacts as P
from codelake.operators import report as R
from codelake.operators import smells as S
from codelake.operators.pyast import py_nodes
from codelake.plans.catalog import KNOBS_BEH, KNOBS_PY, files_of, register, with_
from codelake.session import stage_parquet

PAT_OF_K = """case k % 7 when 0 then 'Singleton' when 1 then 'Observer' when 2 then 'Factory'
              when 3 then 'Strategy' when 4 then 'Observer' when 5 then 'Decorator' end"""

SMELLS_K = """
  select repo, path, 'Long Method' as type, 4 as line, concat('Method is ', 3 + depth + pad, ' lines long (max 50)') as message
  from kp where 3 + depth + pad > 50
  union all select repo, path, 'Too Many Parameters', 4, concat('Method has ', np, ' parameters (max 5)') from kp where np > 5
  union all select repo, path, 'Deep Nesting', 5 + j, concat('Code is nested ', j, ' levels deep (max 3)')
            from kp, (select unnest(range(4, 6)) j) g where j <= depth
  union all select repo, path, 'Large Class', 2, concat('Class is ', 5 + depth + pad, ' lines long (max 200)')
            from kp where 5 + depth + pad > 200
"""


def _py(spark, sf, facts, exact=False):
    files = files_of(spark, sf, "corpus_py")
    nodes = stage_parquet(py_nodes(files, facts=facts, exact=exact), "py_nodes")
    return files, nodes


@register("found_patterns", with_(KNOBS_PY) + f"select distinct repo, {PAT_OF_K} as pattern from kp where k % 7 <> 6")
def q_found_patterns(spark, sf):
    return PT.found_patterns(PT.python_patterns(py_nodes(files_of(spark, sf, "corpus_py"), facts="patterns")))


@register("missing_patterns", with_(KNOBS_PY) + f""",
found as (select distinct repo, {PAT_OF_K} as pattern from kp where k % 7 <> 6),
dim as (select distinct kp.repo, p.pattern from kp,
        (values ('Factory'), ('Singleton'), ('Observer'), ('Strategy'), ('Decorator')) p(pattern))
select repo, pattern from dim where not exists (select 1 from found f where f.repo = dim.repo and f.pattern = dim.pattern)
""")
def q_missing_patterns(spark, sf):
    files, nodes = _py(spark, sf, "patterns")
    return PT.missing_patterns(files, PT.python_patterns(nodes)).select("repo", "pattern")


@register("repo_flags", with_(KNOBS_PY) + """
select distinct repo, true as has_functions, false as functions_documented, true as has_classes,
       false as classes_documented from kp
""")
def q_repo_flags(spark, sf):
    files, nodes = _py(spark, sf, "defs")
    return R.repo_flags(files, P.py_functions(nodes), P.py_classes(nodes))


@register("report_suggestions", with_(KNOBS_PY) + f""",
found as (select distinct repo, {PAT_OF_K} as pattern from kp where k % 7 <> 6),
dim as (select distinct kp.repo, p.pattern, p.o from kp,
        (values ('Factory', 0), ('Singleton', 1), ('Observer', 2), ('Strategy', 3), ('Decorator', 4)) p(pattern, o)),
miss as (select * from dim where not exists (select 1 from found f where f.repo = dim.repo and f.pattern = dim.pattern)),
sm as (select repo, type, count(*) n from ({SMELLS_K}) s group by repo, type having count(*) > 3),
body as (
  select distinct repo, '02' as key, '{R.K.SUGGEST_FUNC_DOCS}' as line from kp
  union all select distinct repo, '03', '{R.K.SUGGEST_CLASS_DOCS}' from kp
  union all select repo, case type when 'Long Method' then '10' when 'Large Class' then '11'
                                   when 'Deep Nesting' then '12' else '13' end,
            case type
              when 'Long Method' then concat('- Consider refactoring long methods (', n, ' instances found). Break them down into smaller, more focused functions')
              when 'Large Class' then concat('- Consider splitting large classes (', n, ' instances found). Use composition or inheritance to distribute responsibilities')
              when 'Deep Nesting' then concat('- Reduce deep nesting (', n, ' instances found). Extract complex conditions into well-named functions or use guard clauses')
              else concat('- Methods with too many parameters (', n, ' instances found). Consider using parameter objects or builder pattern') end
            from sm
  union all select distinct repo, '20', chr(10) || 'Consider implementing these design patterns where appropriate:' from miss
  union all select repo, concat('3', o), case pattern
       when 'Factory' then '{R.K.SUGGEST_PATTERN["Factory"]}' when 'Singleton' then '{R.K.SUGGEST_PATTERN["Singleton"]}'
       when 'Observer' then '{R.K.SUGGEST_PATTERN["Observer"]}' when 'Strategy' then '{R.K.SUGGEST_PATTERN["Strategy"]}'
       else '{R.K.SUGGEST_PATTERN["Decorator"]}' end from miss)
select repo, 'suggestions' as section, key, line from body
union all select distinct repo, 'suggestions', '00a', 'Suggestions for Improvement:' from body
union all select distinct repo, 'suggestions', '00b', '-------------------------' from body
""")
def q_report_suggestions(spark, sf):
    files, nodes = _py(spark, sf, ("defs", "smells", "patterns"))
    return R.report_suggestions(files, P.py_functions(nodes), P.py_classes(nodes), S.python_smells(nodes),
                                PT.python_patterns(nodes))


@register("report_smells", with_(KNOBS_PY) + f""",
s as ({SMELLS_K})
select distinct repo, 'code_smells' as section, concat(path, chr(0)) as key, concat(path, ':') as line from s
union all
select repo, 'code_smells', concat(path, chr(1), lpad(cast(line as varchar), 10, '0'), chr(1), type, chr(1), message, 'a'),
       concat('  - ', type, ' at line ', line) from s
union all
select repo, 'code_smells', concat(path, chr(1), lpad(cast(line as varchar), 10, '0'), chr(1), type, chr(1), message, 'b'),
       concat('    ', message) from s
""")
def q_report_smells(spark, sf):
    return R.report_smells(S.python_smells(_py(spark, sf, "smells")[1]))


@register("function_metrics", with_(KNOBS_PY) + """
select repo, path, concat(cls, k, '.', meth) as function, 1 + depth as complexity, true as is_pure,
       '' as side_effects, '' as handled_exceptions from kp
union all select repo, path, concat('helper_', k % 11), 1, true, '', '' from kp
""")
def q_function_metrics(spark, sf):
    _, nodes = _py(spark, sf, ("defs", "complexity", "behaviour"))
    m = R.function_metrics(P.py_functions(nodes), P.py_complexity(nodes), B.function_behavior(nodes))
    return m.select("repo", "path", "function", "complexity", "is_pure",
                    F.array_join("side_effects", ", ").alias("side_effects"),
                    F.array_join("handled_exceptions", ",").alias("handled_exceptions"))


@register("report_patterns", with_(KNOBS_PY) + f"""
select distinct repo, 'design_patterns' as section, '000' as key, 'Design Patterns:' as line from kp
union all select distinct repo, 'design_patterns', '001', '-----------------' from kp
union all select repo, 'design_patterns', concat('1', path, chr(1), '0'), concat(chr(10), path, ':') from kp where k % 7 <> 6
union all select repo, 'design_patterns',
       concat('1', path, chr(1), '1', lpad(cast(case k % 7 when 0 then 0 when 2 then 1 when 1 then 2 when 4 then 2
                                                   when 3 then 3 else 4 end as varchar), 3, '0')),
       concat('  - ', {PAT_OF_K}) from kp where k % 7 <> 6
""")
def q_report_patterns(spark, sf):
    _, nodes = _py(spark, sf, "patterns")
    return R.report_patterns(PT.python_patterns(nodes))


FLOW_VARS = """
  select k, 'p' as name, 'parameter' as scope, 1 as na, 1 as nr from kb
  union all select k, 'y', 'local', 1 + 2 * (k % 2 = 0)::int,
         (k % 3 = 0)::int + (k % 4 = 0)::int + (k % 5 = 2)::int + 1 from kb
  union all select k, 'LIMIT', 'global', 1, 0 from kb where k % 4 = 0
  union all select k, 'print', 'global', 0, 1 from kb where k % 3 = 0
  union all select k, 'ValueError', 'global', 0, 1 from kb where k % 2 = 0
  union all select k, 'KeyError', 'global', 0, 1 from kb where k % 2 = 0
  union all select k, concat('fn_', k), 'global', 0, 1 from kb where k % 6 = 0
"""


@register("function_flow", with_(KNOBS_BEH) + f""",
v as ({FLOW_VARS}),
vs as (select k, string_agg(concat(name, ' (', scope, ' assigned:', na, ' read:', nr, ')'), chr(10) order by name) s
       from v group by k)
select kb.repo, kb.path, concat('fn_', kb.k) as function,
       cast(case when kb.k % 6 = 0 then 1 else 0 end as bigint) as n_entry_points,
       case when kb.k % 6 = 0 then concat('fn_', kb.k) else '' end as exit_points,
       vs.s as variables, 'return' as control_flow
from kb join vs on vs.k = kb.k
""")
def q_function_flow(spark, sf):
    nodes = stage_parquet(py_nodes(files_of(spark, sf, "corpus_behaviour"), facts=("defs", "behaviour", "flow", "calls")), "py_nodes")
    beh, flow = B.analyse(nodes)
    return R.function_flow(P.py_functions(nodes), beh, flow, B.control_flow(nodes),
                           B.function_callers(nodes)).drop("def_pre")


@register("report_functions", with_(KNOBS_BEH) + f""",
v as ({FLOW_VARS}),
fn as (select repo, path, k, concat('1', path, chr(1)) fk from kb),
lines as (
  select distinct repo, '000' as key, '' as line from kb
  union all select distinct repo, '001', 'Function Analysis:' from kb
  union all select distinct repo, '002', '-----------------' from kb
  union all select distinct repo, '2', '' from kb
  union all select repo, concat(fk, '0'), '' from fn
  union all select repo, concat(fk, '00'), concat('File: ', path) from fn
  union all select repo, concat(fk, '0000000004', chr(1), s), t from fn, (
    select kb.k kk, '0' s, concat('  fn_', kb.k, '(p) -> None') t from kb
    union all select kb.k, '1', '  Documentation: None' from kb
    union all select kb.k, '2', concat('  Pure Function: ', case when kb.k % 4 = 0 or kb.k % 3 = 0 then 'No' else 'Yes' end) from kb
    union all select kb.k, '3', concat('  Side Effects: ', coalesce(nullif(concat_ws(', ',
        case when kb.k % 4 = 0 then 'Uses global variable LIMIT' end, case when kb.k % 3 = 0 then 'Calls print' end), ''), 'None')) from kb
    union all select kb.k, '4', concat('  Raises: ', case when kb.k % 2 = 0 then 'KeyError, ValueError' else 'None' end) from kb
    union all select kb.k, '5', concat('  Async: ', case when kb.k % 5 = 1 then 'Yes' else 'No' end) from kb
    union all select kb.k, '6', concat('  Generator: ', case when kb.k % 5 = 2 then 'Yes' else 'No' end) from kb
    union all select kb.k, '7', concat('  Recursive: ', case when kb.k % 6 = 0 then 'Yes' else 'No' end) from kb
    union all select kb.k, '8', '  Variables:' from kb
    union all select v.k, concat('9', v.name), concat('    - ', v.name, ' (', v.scope, '): assigned ', v.na,
                                                  ' times, read ', v.nr, ' times') from v) b
    where b.kk = fn.k)
select repo, 'functions' as section, key, line from lines
""")
def q_report_functions(spark, sf):
    nodes = stage_parquet(py_nodes(files_of(spark, sf, "corpus_behaviour"), facts=("defs", "behaviour"), exact=True), "py_nodes")
    beh, flow = B.analyse(nodes)
    return R.report_functions(P.py_functions(nodes), beh, flow)


@register("report_classes", with_(KNOBS_PY) + """,
fk as (select repo, path, k, depth, pad, np, cls, meth, concat('1', path, chr(1)) f from kp),
mv as (
  select k, 'self' as name, 'parameter' as scope, 1 as na, 0 as nr from kp
  union all select k, concat('a', j), 'parameter', 1, 0 from kp, (select unnest(range(1, 9)) j) g where j <= np
  union all select k, 'x', 'local', pad + 2, depth + 1 from kp
  union all select k, concat('helper_', k % 11), 'global', 0, 1 from kp),
sub as (
  select k, '0' s, concat('      ', meth, '(self', substr(', a1, a2, a3, a4, a5, a6, a7, a8', 1, 4 * np), ') -> None') t
  from kp
  union all select k, '1', '      Documentation: None' from kp
  union all select k, '2', '      Pure Function: Yes' from kp
  union all select k, '3', '      Side Effects: None' from kp
  union all select k, '4', '      Raises: None' from kp
  union all select k, '5', '      Async: No' from kp
  union all select k, '6', '      Generator: No' from kp
  union all select k, '7', '      Recursive: No' from kp
  union all select k, '8', '      Variables:' from kp
  union all select k, concat('9', name), concat('        - ', name, ' (', scope, '): assigned ', na, ' times, read ', nr, ' times') from mv),
lines as (
  select distinct repo, '000' as key, '' as line from kp
  union all select distinct repo, '001', 'Class Analysis:' from kp
  union all select distinct repo, '002', '--------------' from kp
  union all select distinct repo, '2', '' from kp
  union all select repo, concat(f, '0'), '' from fk
  union all select repo, concat(f, '00'), concat('File: ', path) from fk
  union all select repo, concat(f, '0000000003', chr(1), '0'), concat('  ', cls, k, '()') from fk
  union all select repo, concat(f, '0000000003', chr(1), '1'), '  Documentation: None' from fk
  union all select repo, concat(f, '0000000003', chr(1), '4'), '  Methods:' from fk
  union all select fk.repo, concat(f, '0000000003', chr(1), '5', '0000000008',
                                   chr(1), sub.s), sub.t
            from fk join sub on sub.k = fk.k)
select repo, 'classes' as section, key, line from lines
""")
def q_report_classes(spark, sf):
    _, nodes = _py(spark, sf, ("defs", "variables", "behaviour"), exact=True)
    beh, flow = B.analyse(nodes)
    classes, functions = stage_parquet(P.py_classes(nodes), "classes"), stage_parquet(P.py_functions(nodes), "functions")
    return R.report_classes(classes, functions, P.py_variables(nodes), beh, flow)
