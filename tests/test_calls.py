"""Call edges through imports, classes and nested defs; return prefixes."""

from conftest import files_df

from codelake.operators import behaviour as B
from codelake.operators.calls import call_edges
from codelake.operators.pyast import py_nodes

MAIN = """import pkg.deep
import pkg.deep as d
from pkg.deep import far as f, Box
from . import side
from .side import near
from pkg import side as other
import os
def near():
    pass
def shadow():
    return near()
def go():
    pkg.deep.far()
    d.far()
    f()
    side.near()
    other.near()
    os.getcwd()
    Box()
    unknown().far()
    lonely()
    missing()
    def near():
        def inner():
            return near()
        return inner
    return near()
class K:
    @classmethod
    def make(cls):
        return cls.help()
    def help(self):
        return self.gone(), help(self)
def twice():
    return 1
def twice():
    return twice()
"""
FILES = [("r", "pkg/main.py", MAIN), ("r", "pkg/deep.py", "def far():\n    return 1\ndef far():\n    return 2\nclass Box:\n    def gone(self): pass\n"),
         ("r", "pkg/side.py", "def near():\n    pass\n"), ("r", "pkg/__init__.py", ""), ("r", "z.py", "def lonely(): pass\n"),
         ("q", "pkg/deep.py", "def missing():\n    pass\ndef user():\n    missing()\n")]


def test_calls_resolve_through_symbols(spark):
    files = files_df(spark, FILES)
    got = call_edges(py_nodes(files), files).collect()
    rows = {(r.repo, r.caller, r.base, r.callee): (r.callee_path, r.callee_line, r.how, r.n_targets) for r in got}
    assert len(rows) == len(got)
    main, deep, side = "pkg/main.py", "pkg/deep.py", "pkg/side.py"
    assert rows == {
        ("r", "shadow", "", "near"): (main, 8, "local", None),
        ("r", "go", "pkg.deep", "far"): (deep, 3, "module", None), ("r", "go", "d", "far"): (deep, 3, "module", None),
        ("r", "go", "", "f"): (deep, 3, "import", None), ("r", "go", "side", "near"): (side, 1, "module", None),
        ("r", "go", "other", "near"): (side, 1, "module", None), ("r", "go", None, "far"): (None, None, "name", 2),
        ("r", "go", "", "lonely"): (None, None, "name", 1), ("r", "go", "", "near"): (main, 23, "local", None),
        ("r", "inner", "", "near"): (main, 23, "local", None), ("r", "make", "cls", "help"): (main, 32, "method", None),
        ("r", "help", "self", "gone"): (None, None, "name", 1), ("r", "help", "", "help"): (None, None, "name", 1),
        ("r", "twice", "", "twice"): (main, 36, "local", None), ("q", "user", "", "missing"): ("pkg/deep.py", 1, "local", None)}


def test_no_calls_and_no_files(spark):
    files = files_df(spark, [("r", "a.py", "x = 1\n"), ("r", "b.py", "def (")])
    assert call_edges(py_nodes(files), files).collect() == []


def test_return_prefixes_hold_each_line_once(spark):
    src = "def f(a):\n    if a:\n        return 1\n    for x in a:\n        return 2\n    return 3\ndef g():\n    pass\n"
    nodes = py_nodes(files_df(spark, [("r", "a.py", src)]))
    one = B.return_prefixes(nodes).collect()
    assert [(list(r.lines), [(x.line_no, x.n) for x in r.returns]) for r in one] == [([2, 3, 4, 5, 6], [(3, 2), (5, 4), (6, 5)])]
    assert sorted((r.line_no, list(r.path_lines)) for r in B.return_paths(nodes).collect()) == [(3, [2, 3]), (5, [2, 3, 4, 5]), (6, [2, 3, 4, 5, 6])]
