"""Benchmark: run headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully with the ``noop`` sink (no driver collect) and
timed after an untimed warm-up; prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "smell_counts", "py_functions", "py_complexity", "python_patterns", "py_dependency_edges",
    "called_by", "function_behavior", "variable_flow", "js_functions", "js_dependency_edges",
    "cpp_classes", "cs_methods", "svelte_event_handlers", "structure_nodes", "project_totals",
    "document_lines",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from codelake.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    from codelake.plans.catalog import QUERIES
    # untimed warm-up: session start, Python worker spawn and JIT are paid
    # once here, not by whichever query happens to run first
    from codelake.operators.pyast import py_nodes
    from codelake.sources.corpus import ingest
    warm = ingest(spark.createDataFrame([("w", "w.py", "def f(x):\n    return x\n")],
                                        "repo string, path string, content string"))
    py_nodes(warm).groupBy("kind").count().collect()
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    if os.environ.get("BENCH_FULL") == "1":
        # end to end: every table for the union of all corpora, one parse per file
        from codelake.plans.analyze import analyze
        from codelake.sources import fixtures as X
        from codelake.sources.corpus import ingest
        t0 = time.time()
        files = ingest(X.render_many(spark, sf_dir, *X.CORPORA))
        for name, df in analyze(files).items():
            df.write.format("noop").mode("overwrite").save()
        times["full_analysis"] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": sf}))


if __name__ == "__main__":
    main()
