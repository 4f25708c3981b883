"""Registered line-language queries (D, E, F, G, H3, L5-L8, L14-L22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelake.operators import cpp as C
from codelake.operators import cs as CS
from codelake.operators import graph as G
from codelake.operators import js as J
from codelake.operators import patterns as PT
from codelake.operators import smells as S
from codelake.operators import svelte as SV
from codelake.operators.lines import src_lines
from codelake.plans.catalog import files_of, register, with_
from codelake.sources import fixtures as X

KNOBS_JS = """
kj as (select cast(c_custkey as int) k, concat('r', cast(c_custkey as int) % 8) repo,
        concat('src/c_', cast(c_custkey as int), case when cast(c_custkey as int) % 3 = 0 then '.ts' else '.js' end) path
       from customer)
"""
KNOBS_CPP = """
kc as (select cast(s_suppkey as int) k, s_nationkey nk, concat('r', cast(s_suppkey as int) % 8) repo,
        concat('cpp/s_', cast(s_suppkey as int), '.cpp') path from supplier)
"""
KNOBS_CS = """
kcs as (select cast(s_suppkey as int) k, concat('r', cast(s_suppkey as int) % 8) repo,
        concat('cs/S', cast(s_suppkey as int), '.cs') path from supplier)
"""
KNOBS_SV = """
ksv as (select cast(c_custkey as int) k, concat('r', cast(c_custkey as int) % 8) repo,
        concat('ui/N', cast(c_custkey as int), '.svelte') path from customer)
"""


def _args_text(c):
    return F.array_join(F.transform(c, lambda a: F.concat(a["name"], F.coalesce(
        F.concat(F.lit(":"), a["type"]), F.lit("")))), ",")


def _js(spark, sf):
    return J.js_lines(src_lines(files_of(spark, sf, "corpus_js")))


# ---------------------------------------------------------------- JavaScript / TypeScript

@register("js_functions", with_(KNOBS_JS) + """
select repo, path, concat('f_', k) as name, 'p0:number,p1' as args, 'string' as returns,
       concat('/**', chr(10), 'Adds things', chr(10)) as docstring, 8 as line_start from kj
""")
def q_js_functions(spark, sf):
    fns, _ = J.js_definitions(_js(spark, sf))
    return fns.select("repo", "path", "name", _args_text("args").alias("args"), "returns", "docstring", "line_start")


@register("js_imports", with_(KNOBS_JS) + """
select repo, path, concat('./c_', k + 8) as module, 'a,b' as names, 1 as line_no from kj
union all select repo, path, concat('./lib/c_', k), 'x', 2 from kj
""")
def q_js_imports(spark, sf):
    return J.js_imports(_js(spark, sf)).select("repo", "path", "module",
                                               F.array_join("names", ",").alias("names"), "line_no")


@register("ts_types", with_(KNOBS_JS) + """
select repo, path, concat('I_', k) as name, 'Base' as base_classes, 'TypeScript Interface' as docstring,
       11 as line_start from kj where k % 3 = 0
union all select repo, path, concat('T_', k), '', 'TypeScript Type Alias', 12 from kj where k % 3 = 0
""")
def q_ts_types(spark, sf):
    return J.ts_types(_js(spark, sf)).select("repo", "path", "name",
                                             F.array_join("base_classes", ",").alias("base_classes"),
                                             "docstring", "line_start")


@register("js_raw_dependencies", with_(KNOBS_JS) + """
select repo, path, concat('./c_', k + 8) as dependency from kj
union all select repo, path, concat('./lib/c_', k) from kj
""")
def q_js_raw_dependencies(spark, sf):
    return J.js_raw_dependencies(src_lines(files_of(spark, sf, "corpus_js"))).select("repo", "path", "dependency")


@register("js_dependency_edges", with_(KNOBS_JS) + """
select a.repo, a.path as src, b.path as dst from kj a join kj b on b.k = a.k + 8
""")
def q_js_dependency_edges(spark, sf):
    files = files_of(spark, sf, "corpus_js")
    deps = (J.js_raw_dependencies(src_lines(files))
             .withColumn("imp", F.col("line_no")))
    return G.js_dependency_edges(deps, files)


@register("smell_long_line", with_(KNOBS_JS) + """
select repo, path, 'Long Line' as type, cast(null as varchar) as name, 13 as line,
       'Line exceeds 120 characters' as message from kj where 3 + k % 200 > 120
""")
def q_smell_long_line(spark, sf):
    return S.smell_long_line(src_lines(files_of(spark, sf, "corpus_js"), splitlines=True))


@register("smell_complex_condition", with_(KNOBS_JS) + """
select repo, path, 'Complex Condition' as type, cast(null as varchar) as name, 9 as line,
       'Condition is too complex' as message from kj where k % 6 > 3
""")
def q_smell_complex_condition(spark, sf):
    return S.smell_complex_condition(src_lines(files_of(spark, sf, "corpus_js"), splitlines=True))


# ---------------------------------------------------------------- C / C++

def _cpp(spark, sf):
    return C.cpp_scan(src_lines(files_of(spark, sf, "corpus_cpp")))


@register("cpp_includes", with_(KNOBS_CPP) + "select repo, path, 2 as line_no, concat('s_', k, '.h') as module from kc")
def q_cpp_includes(spark, sf):
    return C.cpp_includes(_cpp(spark, sf))


@register("cpp_classes", with_(KNOBS_CPP) + """
select repo, path, concat('ns', k % 3, '::Box', k, '<typename T>') as name, 'Base,Other' as base_classes,
       'Class Template' as docstring, 6 as line_start, 8 + k % 5 as line_end from kc
""")
def q_cpp_classes(spark, sf):
    return C.cpp_classes(_cpp(spark, sf)).select("repo", "path", "name",
                                                 F.array_join("base_classes", ",").alias("base_classes"),
                                                 "docstring", "line_start", "line_end")


@register("cpp_functions", with_(KNOBS_CPP) + """
select repo, path, concat('ns', k % 3, '::sum', k) as name, 'a:int,b:const Foo&' as args, 'int' as returns,
       9 + k % 5 as line_start, 11 + k % 5 as line_end from kc
""")
def q_cpp_functions(spark, sf):
    return C.cpp_functions(_cpp(spark, sf)).select("repo", "path", "name", _args_text("args").alias("args"),
                                                   "returns", "line_start", "line_end")


@register("cpp_variables", with_(KNOBS_CPP) + """
select repo, path, 'LIMIT' as name, 'int' as type_hint, cast(nk as varchar) as value, 'global' as scope,
       3 as line_start from kc
union all select repo, path, concat('t', k), 'int', '0', 'global', 13 + k % 5 from kc
""")
def q_cpp_variables(spark, sf):
    return C.cpp_variables(_cpp(spark, sf))


@register("cpp_namespaces", with_(KNOBS_CPP) + """
select repo, path, concat('ns', k % 3) as name, 4 as line_start, 12 + k % 5 as line_end from kc
""")
def q_cpp_namespaces(spark, sf):
    return C.cpp_namespaces(_cpp(spark, sf))


@register("smell_nested_blocks", with_(KNOBS_CPP) + """
select repo, path, 'Nested Blocks' as type, cast(null as varchar) as name, 13 + k % 5 as line,
       'Too many nested blocks' as message from kc where k % 6 > 3
""")
def q_smell_nested_blocks(spark, sf):
    return S.smell_nested_blocks(src_lines(files_of(spark, sf, "corpus_cpp"), splitlines=True))


# ---------------------------------------------------------------- C#

def _cs(spark, sf):
    return CS.cs_scan(src_lines(files_of(spark, sf, "corpus_cs")))


@register("cs_usings", with_(KNOBS_CS) + """
select repo, path, 1 as line_no, 'System' as module, cast(null as varchar) as alias from kcs
union all select repo, path, 2, 'System.IO', 'Ali' from kcs
""")
def q_cs_usings(spark, sf):
    return CS.cs_usings(_cs(spark, sf))


@register("cs_raw_dependencies", with_(KNOBS_CS) + "select repo, path, 1 as line_no, 'System' as dependency from kcs")
def q_cs_raw_dependencies(spark, sf):
    return CS.cs_raw_dependencies(src_lines(files_of(spark, sf, "corpus_cs")))


@register("cs_types", with_(KNOBS_CS) + """
select repo, path, concat('App.N', k % 3, '.C', k) as name, 'Base,IThing' as base_classes,
       'Class with attributes: Serializable' as docstring, 5 as line_start, 11 + k % 4 as line_end from kcs
""")
def q_cs_types(spark, sf):
    return CS.cs_types(_cs(spark, sf)).select("repo", "path", "name",
                                              F.array_join("base_classes", ",").alias("base_classes"),
                                              "docstring", "line_start", "line_end")


@register("cs_methods", with_(KNOBS_CS) + """
select repo, path, 'Sum' as name, concat('C', k) as owner_class, 'a:int,b:string' as args, 'int' as returns,
       cast(null as varchar) as docstring, 8 as line_start, 10 + k % 4 as line_end from kcs
""")
def q_cs_methods(spark, sf):
    return CS.cs_methods(_cs(spark, sf)).select("repo", "path", "name", "owner_class",
                                                _args_text("args").alias("args"), "returns", "docstring",
                                                "line_start", "line_end")


@register("cs_members", with_(KNOBS_CS) + """
select repo, path, 'Id' as name, 'int' as type_hint, cast(null as varchar) as value,
       'Member with attributes: Key' as docstring, 'class' as scope, concat('C', k) as owner_class,
       7 as line_start from kcs
""")
def q_cs_members(spark, sf):
    return CS.cs_members(_cs(spark, sf))


# ---------------------------------------------------------------- statements over several lines

KNOBS_ST = """
kt as (select cast(p_partkey as int) k, concat('r', cast(p_partkey as int) % 8) repo,
        cast(13 + 2 * (p_partkey % 2) + p_partkey % 3 as int) body_end, concat('cs/D', cast(p_partkey as int), '.cs') cs,
        concat('cpp/b_', cast(p_partkey as int), '.cpp') cpp from part)
"""


def _cs_st(spark, sf):
    return CS.cs_scan(src_lines(files_of(spark, sf, "corpus_cs_statements")))


def _cpp_st(spark, sf):
    return C.cpp_scan(src_lines(files_of(spark, sf, "corpus_cpp_statements")))


@register("cs_statement_methods", with_(KNOBS_ST) + """
select repo, cs as path, concat('Go', k) as name, concat('D', k) as owner_class, 'a:int,b:string' as args, 'void' as returns,
       cast(null as varchar) as docstring, 11 as line_start, body_end as line_end from kt
""")
def q_cs_statement_methods(spark, sf):
    return CS.cs_methods(_cs_st(spark, sf)).select("repo", "path", "name", "owner_class", _args_text("args").alias("args"), "returns",
                                                   "docstring", "line_start", "line_end")


@register("cs_statement_members", with_(KNOBS_ST) + """
select repo, cs as path, concat('P', k) as name, 'int' as type_hint, cast(null as varchar) as value, cast(null as varchar) as docstring,
       'class' as scope, concat('D', k) as owner_class, 7 as line_start from kt
union all select repo, cs, 's', 'string', '"a { b"', null, 'class', concat('D', k), body_end + 1 from kt
""")
def q_cs_statement_members(spark, sf):
    return CS.cs_members(_cs_st(spark, sf))


@register("cs_statement_types", with_(KNOBS_ST) + """
select repo, cs as path, concat('M', k % 5, '.D', k) as name, concat('Base', k % 3, ',IThing') as base_classes,
       'Class with attributes: Attr' as docstring, 4 as line_start, body_end + 2 as line_end from kt
""")
def q_cs_statement_types(spark, sf):
    return CS.cs_types(_cs_st(spark, sf)).select("repo", "path", "name", F.array_join("base_classes", ",").alias("base_classes"),
                                                 "docstring", "line_start", "line_end")


@register("cpp_statement_functions", with_(KNOBS_ST) + """
select repo, cpp as path, concat('n', k % 4, '::linked', k) as name, 'a:int,b:char' as args, 'int' as returns,
       4 as line_start, 5 as line_end from kt
union all select repo, cpp, concat('n', k % 4, '::pick', k), 'left:T,right:T', 'T', 13, 16 + k % 4 from kt
""")
def q_cpp_statement_functions(spark, sf):
    return C.cpp_functions(_cpp_st(spark, sf)).select("repo", "path", "name", _args_text("args").alias("args"), "returns",
                                                      "line_start", "line_end")


@register("cpp_statement_classes", with_(KNOBS_ST) + """
select repo, cpp as path, concat('n', k % 4, '::Box', k) as name, 'Base' as base_classes, 'Class' as docstring,
       7 as line_start, 11 as line_end from kt
""")
def q_cpp_statement_classes(spark, sf):
    return C.cpp_classes(_cpp_st(spark, sf)).select("repo", "path", "name", F.array_join("base_classes", ",").alias("base_classes"),
                                                    "docstring", "line_start", "line_end")


@register("cpp_statement_variables", with_(KNOBS_ST) + """
select repo, cpp as path, 'LIM' as name, 'int' as type_hint, cast(k as varchar) as value, 'namespace' as scope,
       17 + k % 4 as line_start from kt
""")
def q_cpp_statement_variables(spark, sf):
    return C.cpp_variables(_cpp_st(spark, sf))


# ---------------------------------------------------------------- Svelte

RX_SCRIPT_DUCK = r'(?s)<script(\s+lang="(?:ts|typescript)")?\s*>(.*?)</script>'
RX_STYLE_DUCK = r'(?s)<style(\s+lang="[^"]+")?\s*>(.*?)</style>'
STRIP_DUCK = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _block_sql(rx: str, out: str, extra: str = "") -> str:
    m = f"regexp_extract(content, '{rx}', 0)"
    pre = f"substr(content, 1, strpos(content, {m}) - 1)"
    return (X.cte("corpus_svelte", "pages_tree") +
            f"select repo, path, {STRIP_DUCK.format(x=f'regexp_extract(content, {chr(39)}{rx}{chr(39)}, 2)')} as {out},"
            f" cast(length({pre}) - length(replace({pre}, chr(10), '')) + 1 as integer) as start_line{extra}"
            f" from (select * from corpus_svelte union all select * from pages_tree) f"
            f" where regexp_matches(content, '{rx}')")


@register("svelte_script_block", _block_sql(
    RX_SCRIPT_DUCK, "script", f", regexp_extract(content, '{RX_SCRIPT_DUCK}', 1) <> '' as is_typescript"))
def q_svelte_script_block(spark, sf):
    return SV.script_block(X.render_many(spark, sf, "corpus_svelte", "pages_tree"))


@register("svelte_style_block", _block_sql(RX_STYLE_DUCK, "style"))
def q_svelte_style_block(spark, sf):
    return SV.style_block(X.render_many(spark, sf, "corpus_svelte", "pages_tree"))


@register("svelte_template_block", X.cte("corpus_svelte", "pages_tree") + """
select repo, path, template from (
  select repo, path, regexp_replace(regexp_replace(content, '(?s)<script.*?</script>|<style.*?</style>', '', 'g'),
                                    '^\\s+|\\s+$', '', 'g') as template
  from (select * from corpus_svelte union all select * from pages_tree) f) t
where template <> ''
""")
def q_svelte_template_block(spark, sf):
    return SV.template_block(X.render_many(spark, sf, "corpus_svelte", "pages_tree"))


@register("svelte_event_handlers", with_(KNOBS_SV) + """
select repo, path, 'on_click' as name, 'Event handler for click' as docstring, 5 as line_start from ksv
union all select repo, path, 'on_blur', 'Event handler for blur', 5 from ksv
""")
def q_svelte_event_handlers(spark, sf):
    return SV.svelte_facts(files_of(spark, sf, "corpus_svelte"))[0]


@register("svelte_variables", with_(KNOBS_SV) + """
select repo, path, 'twice' as name, 'component' as scope, 'Reactive declaration' as docstring, 6 as line_start
from ksv
union all select repo, path, 'items', 'template', 'Each block iterable', 7 from ksv
""")
def q_svelte_variables(spark, sf):
    return SV.svelte_facts(files_of(spark, sf, "corpus_svelte"))[1]


@register("svelte_imports", with_(KNOBS_SV) + """
select repo, path, './Child' as module, 'Child' as names, 2 as line_no from ksv
""")
def q_svelte_imports(spark, sf):
    return SV.svelte_imports(files_of(spark, sf, "corpus_svelte")).select(
        "repo", "path", "module", F.array_join("names", ",").alias("names"), "line_no")


@register("svelte_raw_dependencies", with_(KNOBS_SV) + "select repo, path, './Child' as dependency from ksv")
def q_svelte_raw_dependencies(spark, sf):
    return SV.svelte_raw_dependencies(files_of(spark, sf, "corpus_svelte"))


@register("smell_multiple_style_blocks", with_(KNOBS_SV) + """
select repo, path, 'Multiple Style Blocks' as type, cast(null as varchar) as name, 1 as line,
       'Multiple style blocks should be consolidated' as message from ksv where k % 3 = 0
""")
def q_smell_multiple_style_blocks(spark, sf):
    return S.smell_multiple_style_blocks(files_of(spark, sf, "corpus_svelte"))


@register("text_patterns", with_(KNOBS_SV, KNOBS_CS) + """
select repo, path, 'Props Pattern' as pattern from ksv
union all select repo, path, 'Reactive Statement Pattern' from ksv
union all select repo, path, 'Template Method' from kcs
""")
def q_text_patterns(spark, sf):
    return PT.text_patterns(files_of(spark, sf, "corpus_svelte", "corpus_cs", "corpus_js", "corpus_cpp")).drop("ord")


KNOBS_SD = """with kd as (select cast(c_custkey as int) k, concat('r', cast(c_custkey as int) % 8) repo,
  concat('ui/D', cast(c_custkey as int), '.svelte') path from customer)
"""


@register("svelte_functions", KNOBS_SD + """
select repo, path, concat('add_', k) as name, concat('/**', chr(10), 'Adds ', k, '.') as docstring, 'a:number,b:' as args,
       cast(6 + k % 5 as int) as line_start from kd
""")
def q_svelte_functions(spark, sf):
    f = SV.svelte_definitions(files_of(spark, sf, "corpus_svelte_defs"))[0]
    args = F.array_join(F.transform("args", lambda a: F.concat(a["name"], F.lit(":"), F.coalesce(a["type"], F.lit("")))), ",")
    return f.select("repo", "path", "name", F.trim(F.col("docstring"), F.lit(chr(10))).alias("docstring"), args.alias("args"), "line_start")


@register("svelte_classes", KNOBS_SD + """
select repo, path, concat('Box_', k) as name, 'Base' as bases, cast(9 + k % 5 as int) as line_start from kd where k % 3 = 0
""")
def q_svelte_classes(spark, sf):
    c = SV.svelte_definitions(files_of(spark, sf, "corpus_svelte_defs"))[1]
    return c.select("repo", "path", "name", F.array_join("base_classes", ",").alias("bases"), "line_start")
