"""JavaScript / TypeScript line extraction (D1-D11, H9) -- regex over lines, no UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.functions import text as T
from codelake.operators.blocks import FILE, by_file

# --- FIXED VALUES: line patterns of the JS analyser (Java regex dialect)
RX_PARAM = r"^@param\s+\{([^}]+)\}\s+(\w+)(?:\s+(.*))?"
RX_RETURNS = r"^@returns?\s+\{([^}]+)\}(?:\s+(.*))?"
RX_FUNCTION = r"^function\s+(\w+)\s*\((.*?)\)"
RX_CLASS = r"^class\s+(\w+)(?:\s+extends\s+(\w+))?"
RX_REQUIRE_DECL = r"(?:const|let|var)\s+(\w+)\s*=\s*require\(['\"]([^'\"]*)['\"]\)"
RX_REQUIRE = r"require\(['\"]([^'\"]*)['\"]\)"
RX_INTERFACE = r"^interface\s+(\w+)(?:\s+extends\s+(\w+))?"
RX_TYPE = r"^type\s+(\w+)\s*="
RX_ES_MODULE = r"^\s*['\"]?([^'\";]*)"


def js_lines(lines: DataFrame) -> DataFrame:
    """JS-family lines, one file per partition key, with JSDoc block marks.

    A block opens on a stripped line starting ``/**`` and closes on the first
    line containing ``*/`` (D1).  ``blk`` is the open line of the block a
    line belongs to; ``after_blk`` marks the definition line right after a
    block (both consumed by the scanner).
    """
    x = by_file(lines.filter(F.col("language").isin(K.JS_FAMILY + ["svelte"])))
    opens = F.col("stripped").startswith("/**")
    closes = F.col("line").contains("*/")
    w_prev = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_next = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    x = (x.withColumn("_close_at", F.first(F.when(closes, F.col("line_no")), ignorenulls=True).over(w_next))
          .withColumn("_open", F.last(F.when(opens, F.struct(F.col("line_no").alias("o"),
                                                             F.col("_close_at").alias("c"))),
                                      ignorenulls=True).over(w_prev)))
    in_blk = F.col("_open").isNotNull() & F.col("_open.c").isNotNull() & (F.col("line_no") <= F.col("_open.c"))
    x = x.withColumn("blk", F.when(in_blk, F.col("_open.o")))
    prev = F.lag(F.struct("blk", F.col("_open.c").alias("c"))).over(Window.partitionBy(*FILE).orderBy("line_no"))
    x = x.withColumn("after_blk", F.when(prev["blk"].isNotNull() & (prev["c"] == F.col("line_no") - 1), prev["blk"]))
    return x.drop("_close_at", "_open")


def jsdoc_blocks(jl: DataFrame) -> DataFrame:
    """Per block the documented parameter types (name -> type),
    the return type and the description (non-tag lines, newline-joined,
    after the ``strip`` / ``lstrip('* ')`` clean-up, the closing line also
    ``rstrip('*/')``)."""
    b = jl.filter(F.col("blk").isNotNull())
    txt = T.py_lstrip_chars(T.py_strip("line"), "* ")
    txt = F.when(F.col("line").contains("*/"), T.py_rstrip_chars(txt, "*/")).otherwise(txt)
    t = T.py_strip(txt)
    b = b.select(*FILE, "blk", "line_no", t.alias("t"))
    is_param = F.col("t").startswith("@param") & F.col("t").rlike(RX_PARAM)
    is_ret = F.col("t").startswith("@returns") & F.col("t").rlike(RX_RETURNS)
    return (b.groupBy(*FILE, "blk")
             .agg(F.map_from_entries(F.collect_list(F.when(is_param, F.struct(
                      F.regexp_extract("t", RX_PARAM, 2), F.regexp_extract("t", RX_PARAM, 1))))).alias("param_types"),
                  F.max_by(F.when(is_ret, F.regexp_extract("t", RX_RETURNS, 1)),
                           F.when(is_ret, F.col("line_no"))).alias("returns"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("t").startswith("@"),
                                                                             F.struct("line_no", "t")))),
                                           lambda s: s["t"]), "\n").alias("description")))


def js_definitions(jl: DataFrame):
    """The definition line after each JSDoc block -> functions and classes."""
    docs = jsdoc_blocks(jl)
    d = jl.filter(F.col("after_blk").isNotNull()).select(*FILE, "line_no", "stripped",
                                                         F.col("after_blk").alias("blk"))
    d = d.join(docs, FILE + ["blk"], "left")
    fn = d.filter(F.col("stripped").rlike(RX_FUNCTION))
    params = F.filter(F.transform(F.split(F.regexp_extract("stripped", RX_FUNCTION, 2), ","), lambda p: F.trim(p)),
                      lambda p: p != "")
    args = F.transform(params, lambda p: F.struct(
        T.py_strip(F.split_part(p, F.lit("="), F.lit(1))).alias("name"),
        F.element_at(F.col("param_types"), T.py_strip(F.split_part(p, F.lit("="), F.lit(1)))).alias("type")))
    functions = fn.select(*FILE, F.regexp_extract("stripped", RX_FUNCTION, 1).alias("name"), args.alias("args"),
                          "returns", F.col("description").alias("docstring"),
                          F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))
    cl = d.filter(F.col("stripped").rlike(RX_CLASS))
    base = F.regexp_extract("stripped", RX_CLASS, 2)
    classes = cl.select(*FILE, F.regexp_extract("stripped", RX_CLASS, 1).alias("name"),
                        F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>")).alias("base_classes"),
                        F.col("description").alias("docstring"),
                        F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"))
    return functions, classes


def _free(jl):
    """Lines the scanner looks at: not inside a JSDoc block or right after one."""
    return jl.filter(F.col("blk").isNull() & F.col("after_blk").isNull())


def js_imports(jl: DataFrame) -> DataFrame:
    """ES ``import ... from 'm'`` and ``const x = require('m')``
    (module unquoted, ledger Q7)."""
    f = _free(jl)
    s = F.col("stripped")
    parts = F.split(s, " from ")
    es = s.startswith("import ") & (F.size(parts) == 2)
    head = T.py_strip(F.regexp_replace(F.element_at(parts, 1), "import", ""))
    names = (F.when(head.startswith("{"), F.transform(F.split(T.py_strip_chars(head, "{}"), ","),
                                                      lambda n: T.py_strip(n)))
              .when(head != "", F.array(head)).otherwise(F.array().cast("array<string>")))
    req = ~s.startswith("import ") & s.contains("require(") & s.rlike(RX_REQUIRE_DECL)
    return (f.filter(es | req)
             .select(*FILE, F.when(es, F.regexp_extract(F.element_at(parts, 2), RX_ES_MODULE, 1))
                              .otherwise(F.regexp_extract(s, RX_REQUIRE_DECL, 2)).alias("module"),
                     F.when(es, names).otherwise(F.array(F.regexp_extract(s, RX_REQUIRE_DECL, 1))).alias("names"),
                     F.col("line_no")))


def ts_types(jl: DataFrame) -> DataFrame:
    """Interfaces and type aliases of .ts/.tsx files as class rows."""
    f = _free(jl).filter(F.col("path").rlike(r"\.tsx?$"))
    s = F.col("stripped")
    itf = s.startswith("interface ") & s.rlike(RX_INTERFACE)
    typ = ~s.startswith("interface ") & s.startswith("type ") & s.rlike(RX_TYPE)
    base = F.regexp_extract(s, RX_INTERFACE, 2)
    return (f.filter(itf | typ)
             .select(*FILE, F.when(itf, F.regexp_extract(s, RX_INTERFACE, 1)).otherwise(F.regexp_extract(s, RX_TYPE, 1))
                     .alias("name"),
                     F.when(itf & (base != ""), F.array(base)).otherwise(F.array().cast("array<string>"))
                     .alias("base_classes"),
                     F.when(itf, F.lit("TypeScript Interface")).otherwise(F.lit("TypeScript Type Alias"))
                     .alias("docstring"),
                     F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end")))


def js_raw_dependencies(lines: DataFrame) -> DataFrame:
    """Relative module specifiers from ES imports and ``require`` calls
    on any line (the dependency scan does not skip JSDoc)."""
    s = F.col("stripped")
    parts = F.split(s, " from ")
    es = s.startswith("import ") & s.contains(" from ")
    es_mod = F.regexp_extract(F.element_at(parts, 2), RX_ES_MODULE, 1)
    req_mod = F.regexp_extract(s, RX_REQUIRE, 1)
    dep = F.when(es, es_mod).when(s.contains("require("), req_mod)
    return (lines.select(*FILE, "line_no", dep.alias("dependency"))
                 .filter(F.col("dependency").startswith(".")))
