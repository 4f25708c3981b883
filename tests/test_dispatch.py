"""Extractor registry, nested documents, incremental analysis."""

import json
import os
import random

from conftest import files_df
from pyspark.sql import functions as F

from codelake.operators import pyfacts as P
from codelake.operators.documents import export_documents, file_documents, manifest
from codelake.operators.graph import py_dependency_edges
from codelake.operators.pyast import py_nodes
from codelake.plans.analyze import analyze
from codelake.plans.dispatch import Family, definitions, extract
from codelake.plans.incremental import full_run, refresh

ROWS = [("r", "a.py", "import b\ndef f():\n    return 1\nclass C:\n    x = 1\n    def m(self): pass\n"), ("r", "b.py", ""), ("r", "w.js", "/** D */\nfunction g(a) {\n}\n"),
        ("r", "x.cpp", "int h(int a)\n{\n}\n"), ("r", "s.cs", "class S {\n  void M(int a) {\n  }\n}\n"), ("r", "t.go", "func top() {}\n"), ("r", "n.md", "text")]


def names(tables):
    return {(r.family, r.kind, r.name) for r in definitions(tables).collect()}


def test_families_are_added_replaced_and_disabled(spark):
    files = files_df(spark, ROWS)
    whole = {("python", "function", "f"), ("python", "function", "m"), ("python", "class", "C"), ("javascript", "function", "g"), ("cpp", "function", "h"),
             ("csharp", "function", "M"), ("csharp", "class", "S")}
    assert names(extract(files)) == whole
    assert names(extract(files, {"cpp": None})) == {x for x in whole if x[0] != "cpp"}
    assert names(extract(files, only=["csharp"])) == {x for x in whole if x[0] == "csharp"}
    go = Family(("go",), lambda part: {"go_functions": part.select("path", F.regexp_extract("content", r"func (\w+)", 1).alias("name"))})
    one = Family(("c++", "c"), lambda part: {"cpp_functions": part.select("repo", "path", F.lit("mine").alias("name"), F.lit(1).alias("line_start"))})
    got = extract(files, {"go": go, "cpp": one})
    assert [(r.path, r.name) for r in got["go_functions"].collect()] == [("t.go", "top")]
    assert names(got) == {x for x in whole if x[0] != "cpp"} | {("cpp", "function", "mine")} and got["cpp_classes"].count() == 0
    # each part is read from its own folder
    scan = got["go_functions"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "family" in scan


def test_analyze_takes_extractors(spark):
    files = files_df(spark, ROWS)
    out = analyze(files, extractors={"python": None})
    assert out["py_functions"].count() == 0 and {r.name for r in out["cs_methods"].collect()} == {"M"}
    assert out["dep_edges"].count() == 0 and out["smell_counts"].count() == 0
    out = analyze(files)
    assert [(r.src, r.dst) for r in out["dep_edges"].collect()] == [("a.py", "b.py")]
    assert {r.path: r.status for r in out["file_status"].collect()}["b.py"] == "no facts"
    doc = {r.path: r for r in out["file_documents"].collect()}["a.py"]
    assert [c.name for c in doc.classes] == ["C"] and [m.name for m in doc.classes[0].methods] == ["m"]


def test_nested_documents_are_written_by_file(spark, tmp_path):
    files = files_df(spark, [*ROWS, ("q", "a.py", "y = 1\n")])
    nodes = py_nodes(files)
    docs = file_documents(files, P.py_functions(nodes), P.py_classes(nodes), P.py_variables(nodes), P.py_imports(nodes))
    out = str(tmp_path / "out")
    export_documents(docs, out)
    lines = [json.loads(x) for d, _, fs in os.walk(out + "/files") for f in fs if f.endswith(".json") for x in open(os.path.join(d, f))]
    assert sorted(x["path"] for x in lines) == sorted([r[1] for r in ROWS] + ["a.py"])
    a = next(x for x in lines if x["path"] == "a.py" and x["functions"])
    assert (a["functions"][0]["name"], a["classes"][0]["variables"][0]["name"], a["imports"][0]["module"]) == ("f", "x", "b")
    assert next(x for x in lines if x["path"] == "n.md")["classes"] == []
    assert sorted(tuple(r) for r in manifest(docs).collect()) == [("q", 1, 0, 0), ("r", 7, 2, 1)]


def test_refresh_equals_a_whole_run(spark):
    rnd = random.Random(3)

    def module(i):
        return "".join(f"import m{rnd.randrange(12)}\n" for _ in range(rnd.randrange(4))) + f"from .m{rnd.randrange(12)} import f{i}\ndef f{i}(): pass\n"

    def facts(f):
        nodes = py_nodes(f)
        return {"py_imports": P.py_imports(nodes), "py_functions": P.py_functions(nodes)}
    state_rows = {f"m{i}.py": module(i) for i in range(8)}
    state = full_run(files_df(spark, [("r", p, c) for p, c in state_rows.items()]), facts)
    for _ in range(3):
        for _ in range(3):
            i = rnd.randrange(12)
            path = rnd.choice([f"m{i}.py", f"m{i}/__init__.py"])
            if path in state_rows and rnd.random() < 0.5:
                del state_rows[path]
            else:
                state_rows[path] = module(i)
        files = files_df(spark, [("r", p, c) for p, c in state_rows.items()])
        state = refresh(state, files, facts)
        whole = facts(files)
        edges = {(r.src, r.dst) for r in py_dependency_edges(whole["py_imports"], files).collect()}
        assert {(r.src, r.dst) for r in state.edges.collect()} == edges
        for t, df in whole.items():
            assert sorted(map(str, state.tables[t].collect())) == sorted(map(str, df.collect()))
    state = refresh(state, files_df(spark, [("r", "z.py", "import m1\n")]), facts)
    assert state.edges.collect() == [] and state.tables["py_functions"].collect() == [] and state.tables["py_imports"].count() == 1
