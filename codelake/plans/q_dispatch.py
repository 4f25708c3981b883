"""Registered queries of ingest, dispatch and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.operators import behaviour as B
from codelake.operators import classify as CL
from codelake.operators import documents as D
from codelake.operators import js as J
from codelake.operators import pyfacts as P
from codelake.operators.lines import src_lines
from codelake.operators.pyast import file_status, py_nodes
from codelake.plans.catalog import KNOBS_BEH, KNOBS_PY, KNOBS_SUP, files_of, nodes_of, register, with_
from codelake.plans.dispatch import FAMILIES, definitions, extract
from codelake.plans.q_lines import KNOBS_CPP, KNOBS_CS, KNOBS_JS
from codelake.session import stage_parquet

FAMILY_CORPORA = ("corpus_py", "corpus_js", "corpus_js_classes", "corpus_cpp", "corpus_cs", "corpus_svelte_defs")

KNOBS_KD = """
kd as (select cast(c_custkey as int) k, concat('r', cast(c_custkey as int) % 8) repo from customer)
"""
DEFINITIONS = {
    "python": """
select repo, path, 'python' as family, 'function' as kind, meth as name, 4 as line_start from kp
union all select repo, path, 'python', 'function', concat('helper_', k % 11), 8 + depth + pad from kp
union all select repo, path, 'python', 'class', concat(cls, k), 2 from kp""",
    "javascript": """
select repo, path, 'javascript' as family, 'function' as kind, concat('f_', k) as name, 8 as line_start from kj
union all select repo, path, 'javascript', 'class', concat('I_', k), 11 from kj where k % 3 = 0
union all select repo, path, 'javascript', 'class', concat('T_', k), 12 from kj where k % 3 = 0
union all select repo, concat('src/k_', k, case when k % 2 = 0 then '.jsx' else '.tsx' end), 'javascript', 'class', concat('Box_', k), 2 from kj""",
    "cpp": """
select repo, path, 'cpp' as family, 'class' as kind, concat('ns', k % 3, '::Box', k, '<typename T>') as name, 6 as line_start from kc
union all select repo, path, 'cpp', 'function', concat('ns', k % 3, '::sum', k), 9 + k % 5 from kc""",
    "csharp": """
select repo, path, 'csharp' as family, 'class' as kind, concat('App.N', k % 3, '.C', k) as name, 5 as line_start from kcs
union all select repo, path, 'csharp', 'function', 'Sum', 8 from kcs""",
    "svelte": """
select repo, concat('ui/D', k, '.svelte') as path, 'svelte' as family, 'function' as kind, concat('add_', k) as name, cast(6 + k % 5 as int) as line_start from kd
union all select repo, concat('ui/D', k, '.svelte'), 'svelte', 'class', concat('Box_', k), cast(9 + k % 5 as int) from kd where k % 3 = 0""",
}
KNOBS = with_(KNOBS_PY, KNOBS_JS, KNOBS_CPP, KNOBS_CS, KNOBS_KD)


def _family(name):
    def run(spark, sf):
        return definitions(extract(files_of(spark, sf, *FAMILY_CORPORA), only=[name], defining=True))
    return run


for _name in FAMILIES:
    register(f"family_{_name}", KNOBS + DEFINITIONS[_name])(_family(_name))


@register("definitions", KNOBS + " union all ".join(f"select * from ({x}) t_{n}" for n, x in DEFINITIONS.items()))
def q_definitions(spark, sf):
    return definitions(extract(files_of(spark, sf, *FAMILY_CORPORA), defining=True))


@register("js_classes", with_(KNOBS_JS) + """
select repo, concat('src/k_', k, case when k % 2 = 0 then '.jsx' else '.tsx' end) as path, concat('Box_', k) as name,
       case when k % 3 = 0 then 'Base' else '' end as base_classes, '/** A box.' as docstring, 2 as line_start from kj
""")
def q_js_classes(spark, sf):
    c = J.js_definitions(J.js_lines(src_lines(files_of(spark, sf, "corpus_js_classes"))))[1]
    return c.select("repo", "path", "name", F.array_join("base_classes", ",").alias("base_classes"), "docstring", "line_start")


# ---------------------------------------------------------------- ingest and selection

MIXED = """with km as (select cast(c_custkey as int) k, cast(c_custkey as int) % 9 m, concat('r', cast(c_custkey as int) % 8) repo from customer),
kept as (select repo, m, case m when 0 then concat('m', k, '/main.py') when 1 then concat('m', k, '/App.JS') when 4 then concat('m', k, '/a.py')
                       when 5 then concat('m', k, '/b.py') when 6 then concat('m', k, '/c.TS') else concat('m', k, '/notes') end as path
         from km where m not in (2, 3, 7))
"""


@register("ingest_mixed", MIXED + """
select repo, path, case m when 1 then 'javascript' when 6 then 'typescript' when 8 then 'unknown' else 'python' end as language,
       m = 5 as is_binary, case m when 5 then 3 when 4 then 18 else 5 end as size_bytes,
       case m when 5 then null when 4 then concat('x = 1', chr(10), 'y = 2', chr(10), 'z = 3') else concat('a', chr(10), chr(12), 'b', chr(10)) end as content,
       case m when 5 then null else 3 end as n_lines from kept
""")
def q_ingest_mixed(spark, sf):
    f = files_of(spark, sf, "corpus_mixed")
    return f.select("repo", "path", "language", "is_binary", F.col("size_bytes").cast("int").alias("size_bytes"), "content",
                    F.when(F.col("content").isNotNull(), CL.line_count("content")).alias("n_lines"))


@register("entry_points_mixed", MIXED + "select repo, path from kept where m in (0, 1)")
def q_entry_points_mixed(spark, sf):
    return CL.entry_points(files_of(spark, sf, "corpus_mixed"))


@register("quality_files", MIXED + """
select repo, path from kept where m in (0, 1, 4, 5, 6) union all select concat('r', cast(s_suppkey as int) % 8), concat('cpp/s_', s_suppkey, '.cpp') from supplier
""")
def q_quality_files(spark, sf):
    mixed, cpp = files_of(spark, sf, "corpus_mixed"), files_of(spark, sf, "corpus_cpp")
    return CL.quality_files(mixed.unionByName(cpp)).select("repo", "path")


@register("behaviour_files", MIXED + "select repo, path from kept where m in (0, 4, 5)")
def q_behaviour_files(spark, sf):
    return CL.behaviour_files(files_of(spark, sf, "corpus_mixed")).select("repo", "path")


@register("file_status", MIXED + """
, kb as (select cast(p_partkey as int) k, concat('r', cast(p_partkey as int) % 8) repo, concat('bad/b_', cast(p_partkey as int), '.py') path from part)
select repo, path, case when m = 5 then 'undecodable' when m in (0, 4) then 'parsed' else 'not parsed' end as status from kept
union all select repo, path, case when k % 7 = 0 or k % 13 = 0 then 'parse error' else 'parsed' end from kb
""")
def q_file_status(spark, sf):
    files = files_of(spark, sf, "corpus_mixed").unionByName(files_of(spark, sf, "corpus_bad"))
    return file_status(files, py_nodes(files)).select("repo", "path", "status")


# ---------------------------------------------------------------- varied Python

MORE = "with k as (select cast(p_partkey as int) k, concat('r', cast(p_partkey as int) % 8) repo, concat('more/p_', p_partkey, '.py') path from part)\n"


@register("py_imports_varied", MORE + """
select repo, path, 'os.path' as module, cast(null as varchar) as name, 'op' as alias, 1 as line_no from k
union all select repo, path, 'sys', null, null, 1 from k
union all select repo, path, 'a.b', 'c', 'd', 2 from k
union all select repo, path, 'a.b', 'e', null, 2 from k
""")
def q_py_imports_varied(spark, sf):
    return P.py_imports(nodes_of(spark, sf, "corpus_py_more", facts="imports")).select("repo", "path", "module", "name", "alias", "line_no")


@register("py_functions_varied", MORE + """
select repo, path, 'area' as name, concat('Box_', k) as owner_class, 'self,w:int,h' as args, 'float' as returns, 'Area.' as docstring, 'property' as decorators,
       false as is_async, 9 as line_start, 17 as line_end from k
union all select repo, path, 'same', null, '', null, null, '', true, 18, 22 from k
union all select repo, path, 'read', null, '', null, null, '', false, 20, 21 from k
union all select repo, path, 'same', null, concat('a:', chr(39), 'Box', chr(39)), null, null, '', false, 23, 24 from k
""")
def q_py_functions_varied(spark, sf):
    f = P.py_functions(nodes_of(spark, sf, "corpus_py_more", facts="defs"))
    args = F.array_join(F.transform("args", lambda a: F.concat(a["name"], F.coalesce(F.concat(F.lit(":"), a["type"]), F.lit("")))), ",")
    return f.select("repo", "path", "name", "owner_class", args.alias("args"), "returns", "docstring", F.array_join("decorators", ",").alias("decorators"),
                    "is_async", "line_start", "line_end")


@register("py_classes_varied", MORE + """
select repo, path, concat('Box_', k) as name, 'Base,mixin.M' as bases, 'A box.' as docstring, 'deco(1)' as decorators, 5 as line_start, 17 as line_end from k
""")
def q_py_classes_varied(spark, sf):
    c = P.py_classes(nodes_of(spark, sf, "corpus_py_more", facts="defs"))
    return c.select("repo", "path", "name", F.array_join("base_classes", ",").alias("bases"), "docstring", F.array_join("decorators", ",").alias("decorators"),
                    "line_start", "line_end")


@register("py_variables_varied", MORE + """
select repo, path, 'TOTAL' as name, cast(k as varchar) as value, 'module' as scope, cast(null as varchar) as owner_class, 3 as line_start from k
union all select repo, path, 'size', cast(k % 5 as varchar), 'class', concat('Box_', k), 7 from k
""")
def q_py_variables_varied(spark, sf):
    return P.py_variables(nodes_of(spark, sf, "corpus_py_more")).select("repo", "path", "name", "value", "scope", "owner_class", "line_start")


@register("py_complexity_varied", MORE + """
select repo, path, 'area' as name, 9 as line_start, 6 as complexity from k
union all select repo, path, 'same', 18, 1 from k union all select repo, path, 'read', 20, 1 from k union all select repo, path, 'same', 23, 1 from k
""")
def q_py_complexity_varied(spark, sf):
    return P.py_complexity(nodes_of(spark, sf, "corpus_py_more", facts="complexity")).drop("def_pre")


@register("last_definition", MORE + """
select repo, path, 'area' as name, 9 as line_start from k union all select repo, path, 'same', 23 from k union all select repo, path, 'read', 20 from k
""")
def q_last_definition(spark, sf):
    f = P.dedupe_by_name(P.py_functions(nodes_of(spark, sf, "corpus_py_more", facts="defs")))
    return f.select("repo", "path", "name", "line_start")


@register("behavior_varied", MORE + """
select repo, path, 'area' as name, 'Uses global variable k, Uses global variable TOTAL' as side_effects, 9 as line_start from k
union all select repo, path, 'same', '', 18 from k union all select repo, path, 'read', '', 20 from k union all select repo, path, 'same', '', 23 from k
""")
def q_behavior_varied(spark, sf):
    b = B.function_behavior(nodes_of(spark, sf, "corpus_py_more", facts="behaviour"))
    return b.select("repo", "path", "name", F.array_join("side_effects", ", ").alias("side_effects"), "line_start")


@register("variable_lines", with_(KNOBS_BEH) + """
select repo, path, concat('fn_', k) as "function", 'p' as name, 'parameter' as scope, '2' as assignments, cast(3 + (k % 4 = 0)::int as varchar) as reads from kb
""")
def q_variable_lines(spark, sf):
    f = B.variable_flow(nodes_of(spark, sf, "corpus_behaviour", facts="behaviour")).filter("scope = 'parameter'")
    lines = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return f.select("repo", "path", "function", "name", "scope", lines("assignments"), lines("reads"))


# ---------------------------------------------------------------- nested documents

DOCUMENTS_SQL = MORE + """,
ks as (select cast(s_suppkey as int) k, s_nationkey nk, concat('r', cast(s_suppkey as int) % 8) repo, concat('sup/s_', s_suppkey, '.py') path from supplier)
select repo, path, cast(to_json({'language': 'python',
  'imports': [{'module': 'os.path', 'name': null, 'alias': 'op', 'level': 0, 'line_no': 1}, {'module': 'sys', 'name': null, 'alias': null, 'level': 0, 'line_no': 1},
              {'module': 'a.b', 'name': 'c', 'alias': 'd', 'level': 0, 'line_no': 2}, {'module': 'a.b', 'name': 'e', 'alias': null, 'level': 0, 'line_no': 2}],
  'functions': [{'name': 'same', 'args': [], 'returns': null, 'docstring': null, 'decorators': [], 'line_start': 18, 'line_end': 22},
                {'name': 'read', 'args': [], 'returns': null, 'docstring': null, 'decorators': [], 'line_start': 20, 'line_end': 21},
                {'name': 'same', 'args': [{'name': 'a', 'type': concat(chr(39), 'Box', chr(39))}], 'returns': null, 'docstring': null, 'decorators': [],
                 'line_start': 23, 'line_end': 24}],
  'classes': [{'name': concat('Box_', k), 'base_classes': ['Base', 'mixin.M'], 'docstring': 'A box.', 'decorators': ['deco(1)'], 'line_start': 5, 'line_end': 17,
               'methods': [{'name': 'area', 'args': [{'name': 'self', 'type': null}, {'name': 'w', 'type': 'int'}, {'name': 'h', 'type': null}],
                            'returns': 'float', 'docstring': 'Area.', 'decorators': ['property'], 'line_start': 9, 'line_end': 17}],
               'variables': [{'name': 'size', 'value': cast(k % 5 as varchar), 'line_start': 7}]}],
  'variables': [{'name': 'TOTAL', 'value': cast(k as varchar), 'line_start': 3}]}) as varchar) as document from k
union all
select repo, path, cast(to_json({'language': 'python',
  'imports': [{'module': concat('nations.n_', nk), 'name': 'NAME', 'alias': null, 'level': 2, 'line_no': 1},
              {'module': concat('s_', k + 8), 'name': 'go', 'alias': null, 'level': 1, 'line_no': 2}],
  'functions': [{'name': 'go', 'args': [], 'returns': null, 'docstring': null, 'decorators': [], 'line_start': 3, 'line_end': 4}],
  'classes': [], 'variables': []}) as varchar) from ks
"""


def _documents(spark, sf):
    files = files_of(spark, sf, "corpus_py_more", "corpus_rel")
    nodes = stage_parquet(py_nodes(files), "py_nodes")
    return D.file_documents(files, P.py_functions(nodes), P.py_classes(nodes), P.py_variables(nodes), P.py_imports(nodes))


@register("file_documents", DOCUMENTS_SQL)
def q_file_documents(spark, sf):
    d = _documents(spark, sf)
    return d.select("repo", "path", F.to_json(F.struct("language", "imports", "functions", "classes", "variables"), {"ignoreNullFields": "false"}).alias("document"))


@register("document_manifest", MORE + """, ks as (select concat('r', cast(s_suppkey as int) % 8) repo from supplier)
select repo, cast(sum(f) as bigint) as n_files, cast(sum(n) as bigint) as n_functions, cast(sum(c) as bigint) as n_classes
from (select repo, 1 f, 4 n, 1 c from k union all select repo, 1, 1, 0 from ks) t group by repo
""")
def q_document_manifest(spark, sf):
    return D.manifest(_documents(spark, sf))


# ---------------------------------------------------------------- incremental analysis

@register("incremental_edges", with_(KNOBS_SUP) + """
select repo, concat('sup/s_', k, '.py') as src, concat('nations/n_', nk, case when nk % 2 = 0 then '.py' else '/__init__.py' end) as dst
from ks where k % 5 <> 0
union all select a.repo, concat('sup/s_', a.k, '.py'), concat('sup/s_', b.k, '.py') from ks a join ks b on b.k = a.k + 8 where a.k % 5 <> 0 and b.k % 5 <> 0
union all select repo, concat('sup/s_', k, '.py'), concat('nations/n_', (nk + 1) % 25, case when ((nk + 1) % 25) % 2 = 0 then '.py' else '/__init__.py' end)
from ks where k % 5 <> 0 and k % 3 = 0
""")
def q_incremental_edges(spark, sf):
    """2.O: a corpus of which every fifth module goes and every third of the
    others gains an import; the edges after a refresh."""
    from codelake.plans.incremental import full_run, refresh
    files = files_of(spark, sf, "corpus_nations", "corpus_rel")
    key = F.regexp_extract("path", r"^sup/s_(\d+)\.py$", 1).try_cast("int")
    nation = (F.regexp_extract("content", r"nations\.n_(\d+)", 1).try_cast("int") + 1) % 25
    more = F.concat("content", F.lit("import nations.n_"), nation.cast("string"), F.lit("\n"))
    after = files.filter(~F.coalesce(key % 5 == 0, F.lit(False))).withColumn("content", F.when(key % 3 == 0, more).otherwise(F.col("content")))
    facts = lambda f: {"py_imports": P.py_imports(py_nodes(f, facts="imports"))}
    return refresh(full_run(files, facts), after, facts).edges
