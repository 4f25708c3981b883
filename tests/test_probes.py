"""Literal sources that ordinary repositories hold, with the facts expected of them."""

from conftest import files_df
from pyspark.sql import functions as F

from codelake.operators import behaviour as B
from codelake.operators import cpp, cs, pyfacts
from codelake.operators.classify import structure_nodes, total_lines
from codelake.operators.lines import src_lines
from codelake.operators.pyast import parse_errors, py_nodes
from codelake.operators.report import report_classes
from codelake.sources.corpus import ingest

BEHAVIOUR = '''
import os
try:
    import json
except ImportError:
    json = None
LIMIT = 3


def local_things(p, *rest, key=1):
    import re
    from math import sqrt as root
    try:
        re.match(p, root(4))
    except ValueError as err:
        str(err)

    def inner(q):
        return q

    class Box:
        pass
    inner(Box())
    pick = lambda item: item + 1  # noqa: E731
    match p:
        case [first, *others]:
            max(first, others)
        case {"a": one, **more}:
            max(one, more)
        case whole:
            max(whole)
    json.dumps(os.sep)
    return pick(__name__)


def reads_global():
    return LIMIT
'''

CPP = """int proto(int a,
    int b);
int real(int x) {
    return x;
}
class Fwd;
int decl(int a);
namespace outer {
namespace inner {
int deep(int y)
{
    return y;
}
}
}
class Open : public Base
{
    int v;
    int w;
"""

CS = """namespace N {
public class S {
    public int Plain;
    public int Prop {
        get {
            return y;
            return Compute(x);
        }
    }
    public int Lazy =
        5;
    public void Two(int a,
        int b) {
    }
    public int Three(int c) {
        var z = Make(c);
        throw Fail(z);
    }
    public class Inner {
        public string Name { get; set; }
    }
}
}
"""


def test_one_bad_file_does_not_fail_the_job(spark):
    files = files_df(spark, [("r", "a.py", '"""\\ud800 codec"""\ndef f():\n    "\\udfff"\n    return 1\n'), ("r", "b.py", "def ("),
                             ("r", "c.py", "x = " + "(" * 400 + "1" + ")" * 400), ("r", "d.py", "def g():\n    return 2\n")])
    nodes = py_nodes(files)
    assert {r.name for r in pyfacts.py_functions(nodes).collect()} == {"f", "g"}
    assert {r.path for r in parse_errors(nodes).collect()} == {"b.py", "c.py"}
    assert pyfacts.py_functions(nodes).filter("name = 'f'").first().docstring == "\\udfff"


def test_status_of_a_file_does_not_depend_on_its_neighbours(spark):
    import pyarrow as pa

    from codelake.operators.pyast import _flatten_batches
    texts = {"empty.py": "", "comment.py": "# nothing\n", "plain.py": "x = 1\n", "imports.py": "import os\n", "bad.py": "def (:\n", "f.py": "def f(): pass\n"}
    for facts in (None, "imports", "defs", "complexity"):
        seen = []
        for size in (1, 2, 256):
            rows = list(texts.items())
            batches = [pa.RecordBatch.from_arrays([pa.array(["r"] * len(part)), pa.array([p for p, _ in part]), pa.array([c for _, c in part])],
                                                  names=["repo", "path", "content"]) for part in (rows[i:i + size] for i in range(0, len(rows), size))]
            got = [r for b in _flatten_batches(batches, facts=facts) for r in b.to_pylist()]
            seen.append(sorted((r["path"], r["field"], r["n_values"]) for r in got if r["kind"] == "__file__"))
        assert seen[0] == seen[1] == seen[2]
        assert {p for p, state, _ in seen[0] if state == "error"} == {"bad.py"} and len(seen[0]) == len(texts)


def test_file_status(spark):
    from codelake.operators.pyast import file_status
    files = files_df(spark, [("r", "a.py", "x = 1\n"), ("r", "pkg/__init__.py", ""), ("r", "b.py", "def (:\n"), ("r", "c.js", "var x"), ("r", "d.py", None)])
    blob = spark.createDataFrame([("r", "e.py", bytearray(b"\xff\xfe"))], "repo string, path string, content binary")
    files = files.unionByName(ingest(blob))
    assert {r.path: (r.status, r.error) for r in file_status(files, py_nodes(files)).collect()} == {
        "a.py": ("parsed", None), "pkg/__init__.py": ("no facts", None), "b.py": ("parse error", "SyntaxError"), "c.js": ("not parsed", None),
        "d.py": ("unreadable", None), "e.py": ("undecodable", None)}
    assert [r.path for r in parse_errors(py_nodes(files.filter("path = 'pkg/__init__.py'"))).collect()] == []


def test_no_local_binding_is_a_global(spark):
    nodes = py_nodes(files_df(spark, [("r", "m.py", BEHAVIOUR)]))
    got = {r.name: r for r in B.function_behavior(nodes).collect()}
    assert list(got["local_things"].side_effects) == [] and got["local_things"].is_pure
    assert list(got["reads_global"].side_effects) == ["Uses global variable LIMIT"]
    scope = {r.name: r.scope for r in B.variable_flow(nodes).filter("function = 'local_things'").collect()}
    assert {k: scope[k] for k in ("re", "err", "inner", "Box", "item", "first", "one", "whole", "others", "more")} == dict.fromkeys(
        ("re", "err", "inner", "Box", "item", "first", "one", "whole", "others", "more"), "local")


SCOPES = """
import os
LIMIT = 3
def outer(a):
    x = 1
    def inner():
        return x + a + LIMIT
    class Body:
        y = x
        z = y
        def method(self):
            return y, x
    def writes():
        nonlocal x
        x = 2
    def deep():
        def deeper():
            return x
        return deeper
    return inner
def comps(rows):
    one = [i for i in rows if i]
    two = {k: v for k, v in rows}
    three = [i for i in i]
    pick = lambda q, d=q: q + d
    def uses():
        return k, one
    return pick
def late():
    def g():
        return later
    later = 1
    return g
def hides():
    global LIMIT
    def h():
        return LIMIT
    return h
def twice():
    def same():
        w = 1
        return w
    return same
def shadow(os):
    def s():
        return os.sep
    return s
"""


def test_names_resolve_through_the_enclosing_defs(spark):
    files = files_df(spark, [("r", "m.py", SCOPES), ("r", "n.py", "def f():\n    def g():\n        return x\n    return g\nx = 1\n")])
    for nodes in (py_nodes(files), py_nodes(files, facts="behaviour")):
        got = {(r.path, r.name): list(r.side_effects) for r in B.function_behavior(nodes).collect()}
        reads = lambda *names: [f"Uses global variable {n}" for n in names]
        assert {k[1]: v for k, v in got.items() if k[0] == "m.py"} == {
            "outer": [], "inner": reads("LIMIT"), "method": reads("y"), "writes": ["Uses nonlocal variable x"], "deep": [], "deeper": [],
            "comps": reads("i", "q"), "uses": reads("k"), "late": [], "g": [], "hides": ["Uses global variable LIMIT"], "h": reads("LIMIT"),
            "twice": [], "same": [], "shadow": [], "s": []}
        assert got["n.py", "g"] == reads("x")
        scope = {(r.function, r.name): r.scope for r in B.variable_flow(nodes).filter("path = 'm.py'").collect()}
        assert {k: scope[k] for k in (("inner", "x"), ("inner", "a"), ("method", "x"), ("deeper", "x"), ("g", "later"), ("s", "os"), ("writes", "x"))} == dict.fromkeys(
            (("inner", "x"), ("inner", "a"), ("method", "x"), ("deeper", "x"), ("g", "later"), ("s", "os"), ("writes", "x")), "nonlocal")
        assert (scope["method", "y"], scope["uses", "k"], scope["h", "LIMIT"]) == ("global",) * 3
        assert (scope["outer", "z"], scope["comps", "v"], scope["same", "w"], scope["shadow", "os"]) == ("local", "local", "local", "parameter")


def test_behaviour_parses_once(spark):
    from codelake.plans.catalog import QUERIES
    for name in ("function_behavior", "variable_flow"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("MapInArrow") == 1, name


def test_cpp_declarations_nesting_and_open_blocks(spark):
    acc = cpp.cpp_scan(src_lines(files_df(spark, [("r", "a.cpp", CPP)])))
    f = {(r.name, r.line_start, r.line_end) for r in cpp.cpp_functions(acc).collect()}
    assert f == {("proto", 1, 2), ("real", 3, 5), ("decl", 7, 7), ("outer::inner::deep", 10, 13)}
    c = {(r.name, r.line_start, r.line_end) for r in cpp.cpp_classes(acc).collect()}
    assert c == {("Fwd", 6, 6), ("Open", 16, CPP.count("\n") + 1)}


def test_cs_statements_are_no_members(spark):
    acc = cs.cs_scan(src_lines(files_df(spark, [("r", "a.cs", CS)])))
    assert {(r.name, r.owner_class, r.line_start, r.line_end) for r in cs.cs_methods(acc).collect()} == {("Two", "S", 12, 14), ("Three", "S", 15, 18)}
    assert {(r.name, r.owner_class, r.value) for r in cs.cs_members(acc).collect()} == {
        ("Plain", "S", None), ("Prop", "S", None), ("Lazy", "S", "5"), ("Name", "S.Inner", None)}
    assert {r.name: r.line_end for r in cs.cs_types(acc).collect()} == {"N.S": 22, "N.S.Inner": 21}


CS_STATEMENTS = """using System;
namespace Flat.Name;
// a brace in a comment { and "in a string {" do not count
public class Box
    : Base,
      IThing
{
    [Key, Column("a;b")]
    [Required]
    public int Lazy
    {
        get { return y; }
    }

    [Detached]

    private string text = "a { b; c";
    public void M(int a,
        int b)
    { Foo(); int z = 1; }
    public int Arrow(int x) => x + 1;
    public Dictionary<string, int> Map(
        string key,
        ref int value
    ) {
        var local = new Dictionary<string, int> {
            { "a", 1 },
        };
        int inner = 2;
        for (int i = 0; i < 3; i++) {
            int deep = i;
        }
        return local;
    }
    #region more
    enum Kind { A, B }
    struct Point {
        public int X, Y;
        public int Z;
    }
    #endregion
}
interface ITail { void Go(); }
"""

CPP_STATEMENTS = """#include "x.h" // "not this"
extern "C" {
int linked(int a);
}
namespace a {
namespace b
{
Q_MACRO
template <typename K,
          typename V>
class Map
    : public Base<K>,
      private Other
{
public:
    int inside;
    void method(int a,
                int b) { int local = 1; }
};
template <class T>
T pick(T left,
       T right)
{
    if (left) {
        int nested = 3;
    }
    return left;
}
static const int LIMIT =
    3;
}
int middle = 2;
}
std::string text = "} {";
int last(int x)
{
"""


def test_statements_over_several_lines(spark):
    acc = cs.cs_scan(src_lines(files_df(spark, [("r", "a.cs", CS_STATEMENTS)])))
    acc.cache()
    assert sorted((r.name, tuple(r.base_classes), r.line_start, r.line_end) for r in cs.cs_types(acc).collect()) == [
        ("Flat.Name.Box", ("Base", "IThing"), 4, 42), ("Flat.Name.Box.Kind", (), 36, 36), ("Flat.Name.Box.Point", (), 37, 40),
        ("Flat.Name.ITail", (), 43, 43)]
    assert sorted((r.name, r.owner_class, [(a.name, a.type) for a in r.args], r.line_start, r.line_end) for r in cs.cs_methods(acc).collect()) == [
        ("Arrow", "Box", [("x", "int")], 21, 21), ("M", "Box", [("a", "int"), ("b", "int")], 18, 20),
        ("Map", "Box", [("key", "string"), ("value", "int")], 22, 34)]
    members = {r.name: (r.owner_class, r.value, r.docstring) for r in cs.cs_members(acc).collect()}
    assert members == {"Lazy": ("Box", None, "Member with attributes: Required"), "text": ("Box", '"a { b; c"', None),
                       "Y": ("Box.Point", None, None), "Z": ("Box.Point", None, None)}
    acc = cpp.cpp_scan(src_lines(files_df(spark, [("r", "a.cpp", CPP_STATEMENTS)])))
    assert {(r.name, r.line_start, r.line_end) for r in cpp.cpp_functions(acc).collect()} == {
        ("linked", 3, 3), ("a::b::pick", 21, 28), ("last", 35, CPP_STATEMENTS.count("\n") + 1)}
    assert [(r.name, list(r.base_classes), r.line_start, r.line_end) for r in cpp.cpp_classes(acc).collect()] == [
        ("a::b::Map<typename K,typename V>", ["Base<K>", "Other"], 9, 19)]
    assert {(r.name, r.value, r.scope) for r in cpp.cpp_variables(acc).collect()} == {
        ("LIMIT", "3", "namespace"), ("middle", "2", "namespace"), ("text", '"} {"', "global")}
    assert {(r.name, r.line_start, r.line_end) for r in cpp.cpp_namespaces(acc).collect()} == {("a", 5, 33), ("a::b", 6, 31)}
    assert [r.module for r in cpp.cpp_includes(acc).collect()] == ["x.h"]


def test_scopes_of_any_depth(spark):
    n = 12
    src = "".join("    " * i + f"class C{i} {{\n" for i in range(n)) + "int x;\n" + "}\n" * n + "class Z { }\n"
    acc = cs.cs_scan(src_lines(files_df(spark, [("r", "a.cs", src), ("r", "empty.cs", ""), ("q", "a.cs", "class Other {\n}\n")])))
    assert [(r.name, r.owner_class) for r in cs.cs_members(acc).collect()] == [("x", ".".join(f"C{i}" for i in range(n)))]
    assert {r.name for r in cs.cs_types(acc).collect()} == {".".join(f"C{i}" for i in range(k + 1)) for k in range(n)} | {"Z", "Other"}


def test_same_named_classes_keep_their_own_methods(spark):
    src = "if A:\n    class K:\n        x = 1\n        def one(self):\n            pass\nelse:\n    class K:\n        y = 2\n        def two(self):\n            pass\n"
    nodes = py_nodes(files_df(spark, [("r", "k.py", src)]))
    lines = [r.line.strip() for r in report_classes(pyfacts.py_classes(nodes), pyfacts.py_functions(nodes), pyfacts.py_variables(nodes),
                                                    B.function_behavior(nodes), B.variable_flow(nodes)).orderBy("key").collect()]
    first, second = lines[:lines.index("K()", lines.index("K()") + 1)], lines[lines.index("K()", lines.index("K()") + 1):]
    assert any("one(" in x for x in first) and not any("two(" in x for x in first)
    assert any("two(" in x for x in second) and not any("one(" in x for x in second)
    assert any(x.startswith("- x") for x in first) and any(x.startswith("- y") for x in second)


def test_splitlines_and_repeated_paths(spark):
    text = "a\x0cb\nc\x85d\u2028e\x1ef"
    files = files_df(spark, [("r", "a.js", text), ("r", "b.js", ""), ("r", "c.js", "x\n\n")])
    assert [r.line for r in src_lines(files.filter("path = 'a.js'"), splitlines=True).orderBy("line_no").collect()] == text.splitlines()
    assert total_lines(files).first().total_lines == len(text.splitlines()) + 2
    twice = files.unionByName(files).withColumn("size_bytes", F.lit(4).cast("long"))
    s = structure_nodes(twice)
    assert s.filter("not is_dir").count() == 3


def test_checkpoint_folder_without_a_setting(spark):
    from codelake.session import checkpoint_dir
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_fact_groups_give_what_the_whole_table_gives(spark):
    from codelake.operators import patterns, smells
    more = ("import a.b as c\nfrom . import d, e as f\n@deco(1)\nclass W(Base, mixin.M):\n    '''doc'''\n    observers: list = []\n"
            "    @private\n    def __init__(self, a: int, *b, k: str = 'x') -> None:\n        if a and k or b:\n            for i in b:\n"
            "                while i:\n                    if i:\n                        i = [x for x in b if x and a]\n"
            "        lambda q: q\n\n    async def create(self):\n        try:\n            import zlib\n        except E as e:\n            match e:\n"
            "                case 1:\n                    def deep(z): return z and e\n")
    files = files_df(spark, [("r", "a.py", BEHAVIOUR), ("r", "b.py", more), ("r", "c.py", "def (")])
    whole = py_nodes(files)
    from codelake.operators.pyfacts import py_classes, py_complexity, py_functions, py_imports, py_nesting
    for op, group, drop in ((py_functions, "defs", ("def_pre", "owner_pre")), (py_classes, "defs", ("class_pre",)), (py_imports, "imports", ("stmt_pre",)),
                            (py_complexity, "complexity", ("def_pre",)), (py_nesting, "smells", ("pre",)), (smells.python_smells, "smells", ()),
                            (patterns.python_patterns, "patterns", ()), (parse_errors, "imports", ())):
        want = sorted(map(str, op(whole).drop(*drop).collect()))
        got = sorted(map(str, op(py_nodes(files, facts=group)).drop(*drop).collect()))
        assert got == want and (want or op is smells.python_smells), op.__name__
