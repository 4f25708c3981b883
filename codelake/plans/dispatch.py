"""One registry of language families and their extractors.

``extract`` writes the readable files of a corpus once, partitioned by family,
and hands each extractor its own part, which it reads with partition pruning.
An entry is a ``Family`` (languages, function from files to named tables);
callers may add families, replace built-in ones or disable them (None).  A
disabled family gives its tables without rows; a replaced one gives the tables
of its replacement, over the empty ones of the family that it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.operators import cpp as C
from codelake.operators import cs as CS
from codelake.operators import js as J
from codelake.operators import pyfacts as P
from codelake.operators import svelte as SV
from codelake.operators.lines import src_lines
from codelake.operators.pyast import parse_errors, py_nodes
from codelake.session import stage_parquet

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Family:
    languages: tuple[str, ...]
    extract: Callable[[DataFrame], Tables]
    # the functions and classes alone, where that reads less
    define: Callable[[DataFrame], Tables] | None = None


def python_tables(files: DataFrame) -> Tables:
    nodes = stage_parquet(py_nodes(files), "py_nodes")
    imports = P.py_imports(nodes)
    return {"py_nodes": nodes, "parse_errors": parse_errors(nodes), "py_imports": imports, "py_raw_dependencies": P.py_raw_dependencies(imports),
            "py_functions": stage_parquet(P.py_functions(nodes), "functions"), "py_classes": stage_parquet(P.py_classes(nodes), "classes"),
            "py_variables": P.py_variables(nodes), "py_file_calls": stage_parquet(P.py_file_calls(nodes), "file_calls")}


def python_definitions(files: DataFrame) -> Tables:
    nodes = stage_parquet(py_nodes(files, facts="defs"), "py_nodes")
    return {"py_functions": P.py_functions(nodes), "py_classes": P.py_classes(nodes)}


def js_tables(files: DataFrame) -> Tables:
    lines = src_lines(files)
    jl = J.js_lines(lines)
    functions, classes = J.js_definitions(jl)
    return {"js_functions": functions, "js_classes": classes.unionByName(J.ts_types(jl)), "js_imports": J.js_imports(jl),
            "js_raw_dependencies": J.js_raw_dependencies(lines)}


def cpp_tables(files: DataFrame) -> Tables:
    d = stage_parquet(C.cpp_scan(src_lines(files)), "cpp_definitions")
    return {"cpp_includes": C.cpp_includes(d), "cpp_classes": C.cpp_classes(d), "cpp_functions": C.cpp_functions(d),
            "cpp_variables": C.cpp_variables(d), "cpp_namespaces": C.cpp_namespaces(d)}


def cs_tables(files: DataFrame) -> Tables:
    lines = src_lines(files)
    d = stage_parquet(CS.cs_scan(lines), "cs_definitions")
    return {"cs_usings": CS.cs_usings(d), "cs_types": CS.cs_types(d), "cs_methods": CS.cs_methods(d), "cs_members": CS.cs_members(d),
            "cs_raw_dependencies": CS.cs_raw_dependencies(lines)}


def svelte_tables(files: DataFrame) -> Tables:
    handlers, variables = SV.svelte_facts(files)
    functions, classes = SV.svelte_definitions(files)
    return {"svelte_event_handlers": handlers, "svelte_variables": variables, "svelte_functions": functions, "svelte_classes": classes,
            "svelte_imports": SV.svelte_imports(files), "svelte_raw_dependencies": SV.svelte_raw_dependencies(files)}


FAMILIES: dict[str, Family] = {
    "python": Family(("python",), python_tables, python_definitions),
    "javascript": Family(tuple(K.JS_FAMILY), js_tables),
    "cpp": Family(tuple(K.CPP_FAMILY), cpp_tables),
    "csharp": Family(("c#",), cs_tables),
    "svelte": Family(("svelte",), svelte_tables),
}


def by_family(files: DataFrame, families: dict[str, Family | None]) -> DataFrame:
    """The readable files of the families' languages, with their ``family``,
    staged in one folder a family.  Of two families the later one has a language."""
    of = {lang: name for name, fam in families.items() if fam for lang in fam.languages}
    pairs = [F.lit(x) for kv in of.items() for x in kv]
    family = F.element_at(F.create_map(*pairs), F.col("language")) if pairs else F.lit(None).cast("string")
    code = files.filter(F.col("content").isNotNull()).withColumn("family", family).filter(F.col("family").isNotNull())
    return stage_parquet(code, "by_family", partition_by="family")


def extract(files: DataFrame, extractors: dict[str, Family | None] | None = None, only: Iterable[str] | None = None,
            defining: bool = False) -> Tables:
    """The tables of all families (or ``only`` some) over an ingested corpus;
    if ``defining``, those of functions and classes at least."""
    families: dict[str, Family | None] = FAMILIES | (extractors or {})
    if only is not None:
        families = {name: families[name] for name in only}
    staged = by_family(files, families)
    out: Tables = {}
    for name, family in families.items():
        mine = staged.filter(F.col("family") == name).drop("family")
        built_in = FAMILIES.get(name)
        if built_in and family is not built_in:
            out |= built_in.extract(mine.filter(F.lit(False)))
        if family:
            out |= (defining and family.define or family.extract)(mine)
    return out


def definitions(tables: Tables) -> DataFrame:
    """K3: the functions and classes of all families as one table ``(repo, path,
    family, kind, name, line_start)``."""
    parts = [("python", "py"), ("javascript", "js"), ("cpp", "cpp"), ("svelte", "svelte")]
    found = [(f, kind, tables.get(f"{key}_{plural}")) for f, key in parts for kind, plural in (("function", "functions"), ("class", "classes"))]
    found += [("csharp", "function", tables.get("cs_methods")), ("csharp", "class", tables.get("cs_types"))]
    rows = [t.select("repo", "path", F.lit(f).alias("family"), F.lit(kind).alias("kind"), "name", "line_start") for f, kind, t in found if t is not None]
    return reduce(DataFrame.unionByName, rows)
