"""Corpora rendered from the given tables.

Each template is plain SQL over tables named like the inputs (``part``,
``nation``...).  Spark runs it with the tables bound as DataFrames
(``spark.sql(text, part=df)``); the DuckDB oracle runs the same text.  Every
corpus therefore grows with the tables it is rendered from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_PY = """
select concat('r', k % 8) repo, concat('pkg', sz % 10, '/mod_', k, '.py') path,
  concat('import nations.n_', sz % 25, chr(10),
    'class ', cls, k, ':', chr(10),
    '    ', attr, ': int = 0', chr(10),
    '    def ', meth, '(self', substr(', a1, a2, a3, a4, a5, a6, a7, a8', 1, 4 * np), '):', chr(10),
    '        x = 0', chr(10),
    case when depth > 0 then concat(repeat('    ', 2), 'if x:', chr(10)) else '' end,
    case when depth > 1 then concat(repeat('    ', 3), 'if x:', chr(10)) else '' end,
    case when depth > 2 then concat(repeat('    ', 4), 'if x:', chr(10)) else '' end,
    case when depth > 3 then concat(repeat('    ', 5), 'if x:', chr(10)) else '' end,
    case when depth > 4 then concat(repeat('    ', 6), 'if x:', chr(10)) else '' end,
    repeat(concat(repeat('    ', 2 + depth), 'x = 1', chr(10)), pad + 1),
    '        return helper_', k % 11, '(x)', chr(10),
    'def helper_', k % 11, '(v):', chr(10), '    return v', chr(10)) content
from (select cast(p_partkey as int) k, p_size sz, p_size % 9 np,
        cast((p_partkey * 7) % 240 as int) pad, cast(p_partkey % 6 as int) depth,
        case p_partkey % 7 when 0 then '_instance' when 1 then 'observers' else 'value' end attr,
        case p_partkey % 7 when 2 then 'create_item' when 3 then 'run_strategy'
             when 4 then 'notify_all' else 'run' end meth,
        case p_partkey % 7 when 5 then 'Wrapper' else 'Model' end cls from {part}) z
"""

CORPUS_NATIONS = """
select concat('r', r) repo,
  concat('nations/n_', n_nationkey, case when n_nationkey % 2 = 0 then '.py' else '/__init__.py' end) path,
  concat('NAME = ', chr(39), n_name, chr(39), chr(10)) content
from (select n_nationkey, n_name, {eight} r from {nation}) z
"""

CORPUS_REL = """
select concat('r', s_suppkey % 8) repo, concat('sup/s_', s_suppkey, '.py') path,
  concat('from ..nations.n_', s_nationkey, ' import NAME', chr(10),
    'from .s_', s_suppkey + 8, ' import go', chr(10),
    'def go():', chr(10), '    return NAME', chr(10)) content
from {supplier}
"""

CORPUS_BEHAVIOUR = """
select concat('r', k % 8) repo, concat('beh/b_', k, '.py') path,
  concat('LIMIT = 3', chr(10),
    case when k % 5 = 1 then 'async ' else '' end, 'def fn_', k, '(p):', chr(10),
    case when k % 4 = 0 then concat('    global LIMIT', chr(10)) else '' end,
    '    y = p', chr(10),
    case when k % 3 = 0 then concat('    print(y)', chr(10)) else '' end,
    case when k % 4 = 0 then concat('    LIMIT = y', chr(10)) else '' end,
    case when k % 2 = 0 then concat('    try:', chr(10), '        y = 1', chr(10),
      '    except (ValueError, KeyError):', chr(10), '        y = 0', chr(10)) else '' end,
    case when k % 5 = 2 then concat('    yield y', chr(10)) else '' end,
    case when k % 6 = 0 then concat('    return fn_', k, '(y)', chr(10))
         else concat('    return y', chr(10)) end) content
from (select cast(s_suppkey as int) k from {supplier}) z
"""

CORPUS_JS = """
select concat('r', k % 8) repo, concat('src/c_', k, case when k % 3 = 0 then '.ts' else '.js' end) path,
  concat('import { a, b } from ', chr(39), './c_', k + 8, chr(39), ';', chr(10),
    'const x = require("./lib/c_', k, '")', chr(10),
    '/**', chr(10), ' * Adds things', chr(10), ' * @param {number} p0 first', chr(10),
    ' * @returns {string} out', chr(10), ' */', chr(10),
    'function f_', k, '(p0, p1 = 2) {', chr(10),
    '  if (a', repeat(' && a', k % 6), ') { }', chr(10), '}', chr(10),
    'interface I_', k, ' extends Base { }', chr(10), 'type T_', k, ' = string;', chr(10),
    '// ', repeat('z', k % 200), chr(10)) content
from (select cast(c_custkey as int) k from {customer}) z
"""

CORPUS_CPP = """
select concat('r', k % 8) repo, concat('cpp/s_', k, '.cpp') path,
  concat('#include <vector>', chr(10), '#include "s_', k, '.h"', chr(10),
    'static const int LIMIT = ', nk, ';', chr(10),
    'namespace ns', k % 3, ' {', chr(10), 'template <typename T>', chr(10),
    'class Box', k, ' : public Base, private Other', chr(10), '{', chr(10),
    repeat(concat('  int get() { return 1; }', chr(10)), k % 5), '};', chr(10),
    'int sum', k, '(int a, const Foo& b) {', chr(10), '  return a;', chr(10), '}', chr(10),
    '}', chr(10), 'int t', k, ' = 0; // ', repeat('{', k % 6), repeat('}', k % 6), chr(10)) content
from (select cast(s_suppkey as int) k, s_nationkey nk from {supplier}) z
"""

CORPUS_CS = """
select concat('r', k % 8) repo, concat('cs/S', k, '.cs') path,
  concat('using System;', chr(10), 'using Ali = System.IO;', chr(10),
    'namespace App.N', k % 3, ' {', chr(10), '[Serializable]', chr(10),
    'public class C', k, ' : Base, IThing {', chr(10), '  [Key]', chr(10),
    '  public int Id { get; set; }', chr(10),
    '  public virtual int Sum(int a, ref string b) {', chr(10),
    repeat(concat('    a = 1;', chr(10)), k % 4), '    return a;', chr(10), '  }', chr(10),
    '}', chr(10), '}', chr(10)) content
from (select cast(s_suppkey as int) k from {supplier}) z
"""

CORPUS_SVELTE = """
select concat('r', k % 8) repo, concat('ui/N', k, '.svelte') path,
  concat('<script lang="ts">', chr(10), 'import Child from ', chr(39), './Child', chr(39), chr(10),
    'export let n = ', k, ';', chr(10), '</script>', chr(10),
    '<button on:click={go} on:blur={stop}>x</button>', chr(10),
    '$: twice = n * 2', chr(10), '{#each items as item}{/each}', chr(10),
    '<style>p{}</style>', chr(10),
    case when k % 3 = 0 then concat('<style>q{}</style>', chr(10)) else '' end) content
from (select cast(c_custkey as int) k from {customer}) z
"""

# pages as a web tree: repo = top-level domain, path = host + URL path,
# a trailing '/' (or an empty path) names 'index.html'.
PAGES_TREE = """
select regexp_extract(host, '([a-z]+)$', 1) repo,
  concat(host, case when upath = '' then '/index.html'
                    when upath like '%/' then concat(upath, 'index.html') else upath end) path,
  html content
from (select page_id, html,
        regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) host,
        regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) upath
      from {pages}) z
"""

# documents as text files: repo = language, path = '<source>/<doc_id>.md'
DOCUMENTS_TREE = """
select lang repo, concat(source, '/', doc_id, '.md') path, text content from {documents}
"""

# components whose script block holds a documented function and class
CORPUS_SVELTE_DEFS = """
select concat('r', k % 8) repo, concat('ui/D', k, '.svelte') path,
  concat(repeat(chr(10), k % 5), '<script>', chr(10), '/**', chr(10), ' * Adds ', k, '.', chr(10),
    ' * @param {number} a first', chr(10), ' */', chr(10), 'function add_', k, '(a, b) {', chr(10), '}', chr(10),
    case when k % 3 = 0 then concat('/** A box. */', chr(10), 'class Box_', k, ' extends Base {', chr(10), '}', chr(10)) else '' end,
    '</script>', chr(10), '<p>', k, '</p>', chr(10)) content
from (select cast(c_custkey as int) k from {customer}) z
"""

# files that a parser must survive: every 7th a syntax error, every 13th nested
# beyond the parser's limit, every 11th with a lone surrogate in a docstring
CORPUS_BAD = """
select concat('r', k % 8) repo, concat('bad/b_', k, '.py') path,
  concat(case when k % 11 = 0 then concat(repeat(chr(34), 3), chr(92), 'ud800 x', repeat(chr(34), 3), chr(10)) else '' end,
    'def good_', k, '():', chr(10), '    return ', k, chr(10),
    case when k % 7 = 0 then concat('def (:', chr(10)) else '' end,
    case when k % 13 = 0 then concat('x = ', repeat('(', 300), '1', repeat(')', 300), chr(10)) else '' end) content
from (select cast(p_partkey as int) k from {part}) z
"""

# definitions over several lines, attributes, locals in bodies, braces in strings and comments
CORPUS_CS_STATEMENTS = """
select concat('r', k % 8) repo, concat('cs/D', k, '.cs') path,
  concat('namespace M', k % 5, chr(10), '{', chr(10), '[Attr]', chr(10), 'public class D', k, chr(10),
    '    : Base', k % 3, ', IThing', chr(10), '{', chr(10), '    public int P', k, chr(10), '    {', chr(10),
    '        get { return 1; }', chr(10), '    }', chr(10),
    case when k % 2 = 0 then concat('    public void Go', k, '(int a, ref string b) {', chr(10))
         else concat('    public void Go', k, '(int a,', chr(10), '        ref string b)', chr(10), '    {', chr(10)) end,
    '        int local = 1;', chr(10), repeat(concat('        Call(1, "}");', chr(10)), k % 3), '    }', chr(10),
    '    private string s = "a { b"; // }', chr(10), '}', chr(10), '}', chr(10)) content
from (select cast(p_partkey as int) k from {part}) z
"""

CORPUS_CPP_STATEMENTS = """
select concat('r', k % 8) repo, concat('cpp/b_', k, '.cpp') path,
  concat('namespace n', k % 4, chr(10), '{', chr(10), 'extern "C" {', chr(10), 'int linked', k, '(int a,', chr(10),
    '              char b);', chr(10), '}', chr(10), 'class Box', k, chr(10), '    : public Base', chr(10), '{', chr(10),
    '    int inside;', chr(10), '};', chr(10), 'template <typename T>', chr(10), 'T pick', k, '(T left,', chr(10), '    T right)', chr(10),
    '{', chr(10), repeat(concat('    int local = 1;', chr(10)), k % 4), '}', chr(10), 'static const int LIM =', chr(10), '    ', k, ';', chr(10),
    '}', chr(10)) content
from (select cast(p_partkey as int) k from {part}) z
"""

# modules whose functions call one another through imports, classes and nested defs
CORPUS_CALLS = """
select concat('r', k % 8) repo, concat('calls/c_', k, '.py') path,
  concat('import calls.u_', k % 25, ' as util', chr(10), 'from .u_', k % 25, ' import helper as h', chr(10),
    'from . import u_', (k + 1) % 25, chr(10), 'class K', k, ':', chr(10), '    def run(self):', chr(10), '        self.step()', chr(10),
    '        return h(1)', chr(10), '    def step(self):', chr(10), '        util.helper(2)', chr(10), '        return u_', (k + 1) % 25, '.other()', chr(10),
    'def main():', chr(10), '    def nested():', chr(10), '        return unknown_', k % 3, '()', chr(10), '    nested()', chr(10),
    '    return local_', k, '()', chr(10), 'def local_', k, '():', chr(10), '    return len([])', chr(10)) content
from (select cast(s_suppkey as int) k from {supplier}) z
"""

CORPUS_CALLED = """
select concat('r', r) repo, concat('calls/u_', j, '.py') path,
  concat('def helper(x):', chr(10), '    return x', chr(10), 'def other():', chr(10), '    return helper(0)', chr(10),
    'def unknown_', j % 3, '():', chr(10), '    return 1', chr(10)) content
from (select cast(n_nationkey as int) j, {eight} r from {nation}) z
"""

CORPUS_JS_CLASSES = """
select concat('r', k % 8) repo, concat('src/k_', k, case when k % 2 = 0 then '.jsx' else '.tsx' end) path,
  concat('/** A box. */', chr(10), 'class Box_', k, case when k % 3 = 0 then ' extends Base' else '' end, ' {', chr(10), '}', chr(10)) content
from (select cast(c_custkey as int) k from {customer}) z
"""

# annotations, returns, docstrings, decorators, bases, class attributes, aliases, every branch
# kind, names defined twice, closures
CORPUS_PY_MORE = """
select concat('r', k % 8) repo, concat('more/p_', k, '.py') path,
  concat('import os.path as op, sys', chr(10), 'from a.b import c as d, e', chr(10), 'TOTAL = ', k, chr(10),
    '@deco(1)', chr(10), 'class Box_', k, '(Base, mixin.M):', chr(10), '    ', repeat(chr(34), 3), 'A box.', repeat(chr(34), 3), chr(10),
    '    size = ', k % 5, chr(10), '    @property', chr(10), '    def area(self, w: int, h=2) -> float:', chr(10),
    '        ', repeat(chr(34), 3), 'Area.', repeat(chr(34), 3), chr(10), '        while w and h or k:', chr(10), '            w = w - 1', chr(10),
    '        for i in h:', chr(10), '            match i:', chr(10), '                case 1:', chr(10), '                    pass', chr(10),
    '        return TOTAL', chr(10), 'async def same():', chr(10), '    x = 1', chr(10), '    def read():', chr(10), '        return x', chr(10),
    '    return read', chr(10), 'def same(a: ', chr(39), 'Box', chr(39), ', *rest):', chr(10), '    return [a for a in rest if a]', chr(10)) content
from (select cast(p_partkey as int) k from {part}) z
"""

# what ingest must sort out, as bytes: ignored paths, other line ends, no UTF-8, upper case,
# entry points (the expression is Spark's; the oracle goes by the knobs)
CORPUS_MIXED = """
select concat('r', k % 8) repo,
  concat(case k % 9 when 0 then concat('m', k, '/main.py') when 1 then concat('m', k, '/App.JS') when 2 then concat('m', k, '/node_modules/x.js')
                    when 3 then concat('.hidden/y', k, '.py') when 4 then concat('m', k, '/a.py') when 5 then concat('m', k, '/b.py')
                    when 6 then concat('m', k, '/c.TS') when 7 then concat('m', k, '/build/z.py') else concat('m', k, '/notes') end) path,
  case k % 9 when 5 then unhex('fffe00') when 4 then encode(concat('x = 1', chr(13), chr(10), 'y = 2', chr(13), 'z = 3'), 'UTF-8')
             else encode(concat('a', chr(10), chr(12), 'b', chr(10)), 'UTF-8') end content
from (select cast(c_custkey as int) k from {customer}) z
"""

CORPORA = {
    "corpus_js_classes": (CORPUS_JS_CLASSES, ["customer"]),
    "corpus_py_more": (CORPUS_PY_MORE, ["part"]),
    "corpus_mixed": (CORPUS_MIXED, ["customer"]),
    "corpus_calls": (CORPUS_CALLS, ["supplier"]),
    "corpus_called": (CORPUS_CALLED, ["nation"]),
    "corpus_cs_statements": (CORPUS_CS_STATEMENTS, ["part"]),
    "corpus_cpp_statements": (CORPUS_CPP_STATEMENTS, ["part"]),
    "corpus_py": (CORPUS_PY, ["part"]),
    "corpus_bad": (CORPUS_BAD, ["part"]),
    "corpus_svelte_defs": (CORPUS_SVELTE_DEFS, ["customer"]),
    "corpus_nations": (CORPUS_NATIONS, ["nation"]),
    "corpus_rel": (CORPUS_REL, ["supplier"]),
    "corpus_behaviour": (CORPUS_BEHAVIOUR, ["supplier"]),
    "corpus_js": (CORPUS_JS, ["customer"]),
    "corpus_cpp": (CORPUS_CPP, ["supplier"]),
    "corpus_cs": (CORPUS_CS, ["supplier"]),
    "corpus_svelte": (CORPUS_SVELTE, ["customer"]),
    "pages_tree": (PAGES_TREE, ["pages"]),
    "documents_tree": (DOCUMENTS_TREE, ["documents"]),
}


def _escape(text: str, tables) -> str:
    """Double literal braces so only ``{table}`` placeholders are formatted."""
    out = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        out = out.replace("{{" + t + "}}", "{" + t + "}")
    return out


# eight rows of each: a generator, which the two engines write differently
_EIGHT = "explode(sequence(0, 7))"
CORPORA = {k: (_escape(v[0].replace("{eight}", _EIGHT), v[1]), v[1]) for k, v in CORPORA.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# input rows that one task renders and parses, at most about
ROWS_PER_TASK = 4096


def _spread(df: DataFrame, sql: str) -> DataFrame:
    """Rendering expands each small input row into a whole file, and the
    parse job after it is CPU-bound: spread the *input rows* (not the rendered
    text) over tasks, round-robin.  Their number follows from the rows: the task
    slots that Spark knows of are those of the executors registered so far, two
    at the start of an application, and a few long tasks wait for the slowest.

    What later filters ask of a rendered file (its language, whether it is
    UTF-8) would be pushed through the exchange, and every file rendered and
    checked in the few tasks that scan the input.  Filters on generated columns
    stay where they are, so the rows pass through a generator; as column pruning
    stops there too, only the columns that the SQL names go in."""
    named = [c for c in df.columns if re.search(rf"\b{re.escape(c)}\b", sql)]
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    rows = df.select(named).repartition(tasks)
    return rows.select(F.inline(F.array(F.struct(*named))))


def render(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Render one corpus as ``(repo, path, content)`` from the given tables."""
    text, tables = CORPORA[name]
    return spark.sql(text, **{t: _spread(table(spark, sf_dir, t), text) for t in tables})


def render_many(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = None
    for n in names:
        d = render(spark, sf_dir, n)
        out = d if out is None else out.unionByName(d)
    return out


def sql_text(name: str) -> str:
    """The corpus SQL for DuckDB, with plain table names."""
    text, tables = CORPORA[name]
    return text.replace(_EIGHT, "unnest(range(8))").format(**{t: t for t in tables})


def cte(*names: str) -> str:
    """``WITH`` prefix defining the named corpora for an oracle query."""
    return "with " + ",\n".join(f"{n} as ({sql_text(n)})" for n in names) + "\n"


def union_sql(*names: str) -> str:
    return " union all ".join(f"select repo, path, content from {n}" for n in names)

