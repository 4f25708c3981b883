"""End-to-end analysis of a corpus: every table of the analysed tool's
result, from one scan, one line explode and one parse per file.

``py_nodes`` is written once as Parquet to the shared checkpoint folder and every
Python operator reads it from there (each then shuffles only the small row
subset it filters).  Lines are exploded lazily: every consumer filters its
languages first (the filter runs below the explode), and the brace-language
scanners write their own file-partitioned line tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.operators import behaviour as B
from codelake.operators import classify as CL
from codelake.operators import graph as G
from codelake.operators import patterns as PT
from codelake.operators import pyfacts as P
from codelake.operators import report as R
from codelake.operators import smells as S
from codelake.operators.calls import call_edges
from codelake.operators.documents import file_documents
from codelake.operators.lines import src_lines
from codelake.operators.pyast import file_status
from codelake.plans.dispatch import definitions, extract
from codelake.session import stage_parquet


def analyze(files: DataFrame, thresholds: dict | None = None, extractors: dict | None = None) -> dict[str, DataFrame]:
    """``files`` is an ingested corpus (``codelake.sources.corpus.ingest``);
    ``thresholds`` overrides the smell limits (P3), ``extractors`` adds,
    replaces or disables language families (P1, see ``plans.dispatch``).

    Returns a dict of lazily defined DataFrames keyed by table name; only
    the node and line tables are materialised here.
    """
    code = files.filter(F.col("language").isin(K.ANALYSABLE_LANGUAGES) & F.col("content").isNotNull())
    families = extract(files, extractors)
    nodes = families["py_nodes"]
    out: dict[str, DataFrame] = {"files": files.drop("content")} | families
    out["file_status"] = file_status(files, nodes)
    out["definitions"] = definitions(families)

    # structure
    out["structure_nodes"] = CL.structure_nodes(files)
    out["tree_text"] = CL.tree_text(out["structure_nodes"])
    out["project_totals"] = CL.project_totals(files)
    out["language_counts"] = CL.language_counts(files)
    out["entry_points"] = CL.entry_points(files)

    # Python
    imports, functions, classes, calls = (families[t] for t in ("py_imports", "py_functions", "py_classes", "py_file_calls"))
    out["py_imports"] = imports.drop("stmt_pre", "ord")
    out["py_complexity"] = complexity = stage_parquet(P.py_complexity(nodes), "complexity")
    behaviour, flow = B.analyse(nodes)
    behaviour, flow = stage_parquet(behaviour, "behaviour"), stage_parquet(flow, "variable_flow")
    out["function_behavior"], out["variable_flow"] = behaviour, flow
    out["control_flow"] = stage_parquet(B.control_flow(nodes), "control_flow")
    out["return_prefixes"] = B.return_prefixes(nodes)
    out["function_callers"] = B.function_callers(nodes)
    out["py_functions"] = G.function_calls_attach(functions, calls).join(
        complexity.select("repo", "path", "def_pre", "complexity"), ["repo", "path", "def_pre"], "left")
    out["called_by"] = G.called_by_counts(functions.select("repo", "path", "def_pre", "name"), calls)
    out["file_definition_counts"] = P.file_definition_counts(files, nodes)

    out["call_edges"] = call_edges(nodes, files)

    # linking
    py_edges = G.py_dependency_edges(imports, files)
    js_edges = G.js_dependency_edges(families["js_raw_dependencies"].withColumn("imp", F.col("line_no")), files)
    out["dep_edges"] = edges = stage_parquet(py_edges.unionByName(js_edges).distinct(), "dep_edges")
    out["dependents"] = G.dependents(edges)
    out["dependency_adjacency"] = G.dependency_adjacency(code.select("repo", "path"), edges)

    # quality
    smell_lines = src_lines(code.filter(F.col("language") != "python"), splitlines=True)
    smells = stage_parquet(S.python_smells(nodes, thresholds).unionByName(S.line_smells(code, smell_lines)), "smells")
    patterns = stage_parquet(PT.python_patterns(nodes).unionByName(PT.text_patterns(code)), "patterns")
    out["smells"], out["patterns"] = smells, patterns
    out["smell_counts"] = S.smell_counts(smells)
    out["missing_patterns"] = PT.missing_patterns(files, patterns)

    # reports
    out["function_metrics"] = R.function_metrics(functions, complexity, behaviour)
    out["report_suggestions"] = R.report_suggestions(files, functions, classes, smells, patterns)
    out["report_smells"] = R.report_smells(smells)
    out["report_patterns"] = R.report_patterns(patterns)
    out["report_functions"] = R.report_functions(functions, behaviour, flow)
    out["report_classes"] = R.report_classes(classes, functions, out["py_variables"], behaviour, flow)
    out["file_documents"] = file_documents(files, functions, classes, out["py_variables"], imports)
    out["report_overview"] = R.report_overview(files, out["structure_nodes"])
    out["report_architecture"] = R.report_architecture(code.select("repo", "path", "language", "name"),
                                                       out["structure_nodes"], functions, classes, edges)
    out["file_summary"] = R.file_summary(code, nodes, patterns, smells, edges)
    out["function_flow"] = R.function_flow(functions, behaviour, flow, out["control_flow"],
                                           out["function_callers"])
    return out
