"""Raw-tree data source, end-to-end analysis and JSON export on a small tree."""

import json
import os

from pyspark.sql import functions as F

from codelake.operators.report import export_json
from codelake.plans.analyze import analyze
from codelake.sources.corpus import ingest
from codelake.sources.tree import read_tree

TREE = {
    "app/__init__.py": "",
    "app/main.py": "from .util import helper\nimport os\n\ndef main():\n    \"\"\"Run.\"\"\"\n    return helper(1)\n",
    "app/util.py": "def helper(x):\n    print(x)\n    return x\n",
    "web/index.js": "import { a } from './lib';\n/**\n * Doc\n * @param {string} s text\n */\nfunction go(s) {\n}\n",
    "web/lib.js": "class A {\n constructor() {}\n}\n",
    "src/box.cpp": '#include "box.h"\nclass Box : public Base\n{\n  int v;\n};\n',
    "Svc.cs": "using System;\nnamespace N {\npublic class S {\n  public int Id { get; set; }\n}\n}\n",
    "ui/C.svelte": "<script>\nexport let x = 1;\n</script>\n<p on:click={f}>x</p>\n",
    "node_modules/skip.js": "x",
    ".hidden/skip.py": "x = 1\n",
    "bad.py": "def (:\n",
    "blob.bin": None,
}


def _make(tmp_path):
    root = tmp_path / "proj"
    for rel, text in TREE.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        if text is None:
            p.write_bytes(b"\xff\xfe\x00")
        else:
            p.write_text(text)
    return str(root)


def test_tree_source_keeps_dunder_files_and_prunes_ignored(spark, tmp_path):
    root = _make(tmp_path)
    df = read_tree(spark, root, files_per_partition=3)
    paths = {r.path for r in df.collect()}
    assert "app/__init__.py" in paths and "bad.py" in paths
    assert not any(p.startswith(("node_modules", ".hidden")) for p in paths)
    assert {r.repo for r in df.collect()} == {"proj"}
    files = ingest(df)
    assert files.filter(F.col("is_binary")).select("path").collect()[0].path == "blob.bin"


def test_analyze_end_to_end_and_export(spark, tmp_path):
    files = ingest(read_tree(spark, _make(tmp_path)))
    t = analyze(files)
    edges = {(r.src, r.dst) for r in t["dep_edges"].collect()}
    assert ("app/main.py", "app/util.py") in edges and ("web/index.js", "web/lib.js") in edges
    assert {r.path for r in t["parse_errors"].collect()} == {"bad.py"}
    beh = {r.name: r for r in t["function_behavior"].collect()}
    assert list(beh["helper"].side_effects) == ["Calls print"] and beh["main"].is_pure
    assert {r.name for r in t["js_functions"].collect()} == {"go"}
    assert {r.name for r in t["cpp_classes"].collect()} == {"Box"}
    assert {r.name for r in t["cs_members"].collect()} == {"Id"}
    assert {r.name for r in t["svelte_event_handlers"].collect()} == {"on_click"}
    pats = {(r.path, r.pattern) for r in t["patterns"].collect()}
    assert ("web/lib.js", "Class-based OOP") in pats and ("ui/C.svelte", "Props Pattern") in pats
    out = str(tmp_path / "out")
    export_json({"dep_edges": t["dep_edges"]}, out)
    rows = [json.loads(line) for f in os.listdir(out + "/dep_edges") if f.endswith(".json")
            for line in open(os.path.join(out, "dep_edges", f))]
    assert {(r["src"], r["dst"]) for r in rows} == edges


def test_unreadable_files_are_reported(spark, tmp_path):
    from codelake.sources.tree import read_errors
    root = tmp_path / "broken"
    root.mkdir()
    (root / "ok.py").write_text("x = 1\n")
    os.symlink(str(root / "gone.py"), str(root / "link.py"))
    df = read_tree(spark, str(root))
    assert [(r.path, r.error.split(":")[0]) for r in read_errors(df).collect()] == [("link.py", "FileNotFoundError")]
    assert {r.path: r.content is None for r in ingest(df).collect()} == {"ok.py": False, "link.py": True}


def test_listing_goes_round_by_round(spark, tmp_path):
    from codelake.sources.tree import list_tree
    want = set()
    for i in range(4):
        for j in range(3):
            d = tmp_path / "big" / f"d{i}" / f"_e{j}" / "f"
            d.mkdir(parents=True)
            for k in range(3):
                (d / f"__x{k}.py").write_text("y" * k)
                want.add((f"d{i}/_e{j}/f/__x{k}.py", k))
    (tmp_path / "big" / "node_modules").mkdir()
    (tmp_path / "big" / "node_modules" / "z.js").write_text("")
    os.symlink(str(tmp_path / "big" / "d0"), str(tmp_path / "big" / "loop"))
    (tmp_path / "other").mkdir()
    for entries in (1, 5, 10_000):
        got = list_tree(spark, str(tmp_path / "big"), str(tmp_path / "other"), str(tmp_path / "none"), entries_per_task=entries).collect()
        assert {(r.path, r.size_bytes) for r in got if r.repo == "big"} == want and len(got) == len(want) + 1
        assert [(r.repo, r.error.split(":")[0]) for r in got if r.error] == [("none", "FileNotFoundError")]
    tree = read_tree(spark, str(tmp_path / "big"), files_per_partition=4, entries_per_task=2)
    assert {(r.path, len(r.content)) for r in tree.collect()} == want and tree.rdd.getNumPartitions() == 9


def test_files_are_rendered_and_filtered_after_the_input_rows_are_spread(spark, tmp_path):
    from codelake.sources import fixtures as X
    part = spark.createDataFrame([(k, k % 50, "x") for k in range(1, 40)] + [(7, 7, "y"), (None, 3, "z")], "p_partkey bigint, p_size int, p_comment string")
    part.write.parquet(str(tmp_path / "part.parquet"))
    files = ingest(X.render_many(spark, str(tmp_path), "corpus_py")).filter((F.col("language") == "python") & F.col("content").isNotNull())
    above, below = files._jdf.queryExecution().optimizedPlan().toString().split("Repartition")
    assert "Filter" in above and "Filter" not in below and "p_comment" not in above
    text, _ = X.CORPORA["corpus_py"]
    plain = ingest(spark.sql(text, part=X.table(spark, str(tmp_path), "part"))).filter("content is not null")
    assert sorted(map(str, files.collect())) == sorted(map(str, plain.collect())) and files.count() == 40


def test_tasks_that_render_files_grow_with_the_input_rows(spark, tmp_path):
    from codelake.sources import fixtures as X
    rows = 60_000
    spark.range(rows).selectExpr("id as s_suppkey", "id % 25 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    files = X.render(spark, str(tmp_path), "corpus_rel")
    sizes = files.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in sizes) == rows and max(r["count"] for r in sizes) <= 4500
    few = X.render(spark, "/root/testdata/sf0.001", "corpus_rel")
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
