"""Groups of facts: what the operators make of them equals what they make of the whole node table."""

import pytest
from conftest import files_df

from codelake.operators import behaviour as B
from codelake.operators import patterns, pyfacts, smells
from codelake.operators.pyast import _flatten_one, py_nodes

TEXT = '''import a.b as c
from . import d, e as f
LIMIT, OTHER = 3, [i for i in range(4)]
if LIMIT:
    late = c.f(1)
@deco(1)
class W(Base, mixin.M):
    """doc"""
    observers: list = []
    size = width = 1 + 2
    @private
    def __init__(self, a: int, *b, k: str = 'x') -> None:
        global LIMIT
        if a and k or b:
            for i in b:
                while i:
                    if i:
                        i = [x for x in b if x and a]
                    elif a: return make(a)
                    else:
                        print(a); pass
        LIMIT = a
        total = i = 0
        total += LIMIT + total
        key = lambda q, r=a: q + a
        class Inner:
            part = total
            def deep(self): return part(total)

    async def create(self):
        try:
            import zlib
        except (E, OSError) as e:
            match e:
                case 1:
                    def deep(z): return z and e
                case [first, *rest]: return first(rest)
        except zlib.error: yield zlib
        for i, j in self.items(): self.items()(i)
        with open(self.p) as h: h.read()
'''


@pytest.fixture(scope="module")
def files(spark):
    return files_df(spark, [("r", "a.py", TEXT), ("r", "b.py", "def f(x):\n" + "    y = x\n" * 9 + "    return f(y)\n"), ("r", "c.py", "def ("), ("s", "a.py", TEXT)])


def rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


@pytest.mark.parametrize("op, facts, drop", [
    (pyfacts.py_variables, "variables", ("assign_pre", "owner_pre")),
    (pyfacts.py_file_calls, "calls", ()),
    (pyfacts.distinct_return_calls, "calls", ("def_pre",)),
    (B.function_callers, "calls", ("caller_pre",)),
    (B.function_caller_edges, "calls", ("caller_pre",)),
    (B.control_flow, "flow", ("def_pre",)),
    (B.return_prefixes, "returns", ("def_pre",)),
    (B.return_paths, "returns", ("def_pre",)),
    (B.function_behavior, "behaviour", ("def_pre",)),
    (B.variable_flow, "behaviour", ("def_pre",)),
    (B.function_behavior, ("defs", "complexity", "behaviour"), ("def_pre",)),
    (B.variable_flow, ("patterns", "calls", "flow", "variables", "behaviour"), ("def_pre",)),
    (pyfacts.py_complexity, ("defs", "complexity", "behaviour"), ("def_pre",)),
    (pyfacts.py_functions, ("defs", "smells", "patterns"), ("def_pre", "owner_pre")),
    (smells.python_smells, ("imports", "counts", "patterns", "smells"), ()),
    (patterns.python_patterns, ("imports", "counts", "patterns", "smells"), ()),
    (pyfacts.py_imports, ("imports", "defs"), ("stmt_pre",)),
])
def test_groups_give_what_the_whole_table_gives(files, op, facts, drop):
    want = rows(op(py_nodes(files)), *drop)
    assert rows(op(py_nodes(files, facts=facts)), *drop) == want and (want or op is smells.python_smells)


@pytest.mark.parametrize("op", [pyfacts.py_classes, pyfacts.py_functions, pyfacts.py_variables, B.function_behavior, B.variable_flow])
def test_exact_positions_are_those_of_the_whole_table(files, op):
    nodes = py_nodes(files, facts=("defs", "variables", "behaviour"), exact=True)
    assert rows(op(nodes)) == rows(op(py_nodes(files)))


def test_definition_counts(files):
    want = rows(pyfacts.file_definition_counts(files, py_nodes(files)))
    assert rows(pyfacts.file_definition_counts(files, py_nodes(files, facts="counts"))) == want


def test_rows_do_not_grow_with_statements_that_hold_no_fact():
    for facts in ("defs", "smells", "patterns", "complexity", "counts", "calls", "returns", "behaviour", "variables"):
        few, many = (len(_flatten_one("class A:\n    def f(self):\n" + "        x = 1\n" * n + "        return g(x)\n", False, facts)) for n in (2, 200))
        assert few == many, facts


def test_branches_are_no_rows():
    few, many = (_flatten_one("def f(x):\n    for i in x:\n" + "        x = 1\n" * n + "        return x\n", False, "flow") for n in (2, 200))
    assert len(few) == len(many) == 2
    assert many[0][14] == {"target": "i", "iter": "x", "body": ",".join(map(str, range(3, 204)))}


def test_branch_lines_of_files_given_twice(spark):
    one = ("r", "a.py", "def f(x):\n    if x:\n        y = 1\n        return y\n")
    for facts in ("flow", None):
        got = B.control_flow(py_nodes(files_df(spark, [one, one]), facts=facts)).orderBy("line_no").collect()
        assert [(r.line_no, r.condition, r.true_branch, r.false_branch) for r in got] == [(2, "x", [3, 3, 4, 4], []), (4, None, [], [])], facts


@pytest.mark.parametrize("facts", ["calls", "complexity", "variables", ("calls", "complexity")])
def test_plain_assignments_are_not_walked(facts):
    last = [max(r[0] for r in _flatten_one("T = 1\ndef f(x):\n" + "    x = 1\n" * n + "    if x:\n        return g(x)\nclass A:\n    b = 2\n", False, facts))
            for n in (2, 200)]
    assert last[0] == last[1]
    deep = _flatten_one("def f(x):\n    x = y[g(1)]\n    y[g(2)] = x\n    x = a and b\n", False, ("calls", "complexity"))
    assert [r[6] for r in deep if r[3] == "func"] == ["g", "g"] and [r[5] for r in deep].count("BoolOp") == 1
