"""Svelte component extraction (G1-G8): script / template / style blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import text as T
from codelake.operators import js as J
from codelake.operators.blocks import FILE

# --- FIXED VALUES: Svelte block and template patterns (Java regex dialect)
RX_SCRIPT = r'(?s)<script(\s+lang="(?:ts|typescript)")?\s*>(.*?)</script>'
RX_STYLE = r'(?s)<style(\s+lang="[^"]+")?\s*>(.*?)</style>'
RX_BLOCKS = r"(?s)<script.*?</script>|<style.*?</style>"
RX_HANDLER = r"on:(\w+)=\{([^}]+)\}"
RX_REACTIVE = r"^\s*\$:\s*(\w+)\s*="
RX_EACH = r"^\s*\{#each\s+(\w+)"
RX_IMPORT_ANY = r"import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]"


def _line_of(content, pos):
    """1-based line of a 1-based character position."""
    return F.regexp_count(F.substring(content, 1, pos - 1), F.lit("\n")) + 1


def script_block(files: DataFrame) -> DataFrame:
    """G1: first script block -> text (stripped), start line, TypeScript flag."""
    c = F.col("content")
    pos = F.regexp_instr(c, F.lit(RX_SCRIPT))
    return (files.filter(pos > 0)
                 .select(*FILE, T.py_strip(F.regexp_extract(c, RX_SCRIPT, 2)).alias("script"),
                         _line_of(c, pos).alias("start_line"),
                         (F.regexp_extract(c, RX_SCRIPT, 1) != "").alias("is_typescript")))


def style_block(files: DataFrame) -> DataFrame:
    """First style block -> text (stripped) and start line."""
    c = F.col("content")
    pos = F.regexp_instr(c, F.lit(RX_STYLE))
    return (files.filter(pos > 0)
                 .select(*FILE, T.py_strip(F.regexp_extract(c, RX_STYLE, 2)).alias("style"),
                         _line_of(c, pos).alias("start_line")))


def template_block(files: DataFrame) -> DataFrame:
    """The component text without script and style blocks (stripped)."""
    t = T.py_strip(F.regexp_replace("content", RX_BLOCKS, ""))
    return files.select(*FILE, t.alias("template")).filter(F.col("template") != "")


def script_lines(files: DataFrame) -> DataFrame:
    """The script block's lines at their real file line numbers, shaped
    like ``src_lines`` so the JS extractors run on them unchanged."""
    c = F.col("content")
    pos = F.regexp_instr(c, F.lit(RX_SCRIPT))
    body = F.regexp_extract(c, RX_SCRIPT, 2)
    return (files.filter(pos > 0)
                 .select(*FILE, F.lit("svelte").alias("language"), _line_of(c, pos).alias("_l0"),
                         F.posexplode(F.split(body, "\n", -1)).alias("_i", "line"))
                 .select(*FILE, "language", (F.col("_l0") + F.col("_i")).cast("int").alias("line_no"), "line",
                         T.py_strip("line").alias("stripped")))


def template_lines(files: DataFrame) -> DataFrame:
    """Template text split at script/style blocks, each piece's lines at
    their real file line numbers: piece i starts after the newlines of all
    earlier pieces and blocks."""
    segs = F.split("content", RX_BLOCKS, -1)
    blks = F.regexp_extract_all("content", F.lit(RX_BLOCKS), 0)
    nl = lambda s: F.regexp_count(s, F.lit("\n"))
    starts = F.transform(segs, lambda s, i: 1 + F.aggregate(
        F.slice(F.arrays_zip(F.slice(segs, 1, i), F.slice(blks, 1, i)), 1, i), F.lit(0),
        lambda acc, z: acc + nl(F.coalesce(z["0"], F.lit(""))) + nl(F.coalesce(z["1"], F.lit("")))))
    x = files.select(*FILE, F.posexplode(F.arrays_zip(segs.alias("s"), starts.alias("st"))).alias("_k", "z"))
    return (x.select(*FILE, F.col("z.st").alias("_st"), F.posexplode(F.split(F.col("z.s"), "\n", -1)).alias("_i", "line"))
             .select(*FILE, (F.col("_st") + F.col("_i")).cast("int").alias("line_no"), "line"))


def svelte_facts(files: DataFrame):
    """Event handlers (functions ``on_<event>``), reactive
    declarations (scope component) and each-block iterables (scope template)."""
    f = files.filter(F.col("language") == "svelte")
    tl = template_lines(f)
    handlers = (tl.select(*FILE, "line_no", F.explode(F.regexp_extract_all("line", F.lit(RX_HANDLER), 1)).alias("ev"))
                  .select(*FILE, F.concat(F.lit("on_"), "ev").alias("name"),
                          F.concat(F.lit("Event handler for "), "ev").alias("docstring"),
                          F.col("line_no").alias("line_start")))
    react = tl.filter(F.col("line").contains("$:") & F.col("line").rlike(RX_REACTIVE)).select(
        *FILE, F.regexp_extract("line", RX_REACTIVE, 1).alias("name"), F.lit("component").alias("scope"),
        F.lit("Reactive declaration").alias("docstring"), F.col("line_no").alias("line_start"))
    each = tl.filter(F.col("line").rlike(RX_EACH)).select(
        *FILE, F.regexp_extract("line", RX_EACH, 1).alias("name"), F.lit("template").alias("scope"),
        F.lit("Each block iterable").alias("docstring"), F.col("line_no").alias("line_start"))
    return handlers, react.unionByName(each)


def svelte_imports(files: DataFrame) -> DataFrame:
    """JS imports of the script block, at real file lines."""
    sl = script_lines(files.filter(F.col("language") == "svelte"))
    return J.js_imports(J.js_lines(sl))


def svelte_definitions(files: DataFrame):
    """Documented functions and classes of the script block, at real file
    lines."""
    sl = script_lines(files.filter(F.col("language") == "svelte"))
    return J.js_definitions(J.js_lines(sl))


def svelte_raw_dependencies(files: DataFrame) -> DataFrame:
    """Script-block dependencies plus ``import X from './...'`` on any
    line; offered de-duplicated per file."""
    f = files.filter(F.col("language") == "svelte")
    script = J.js_raw_dependencies(script_lines(f)).select(*FILE, "dependency")
    lines = f.select(*FILE, F.explode(F.split("content", "\n", -1)).alias("line"))
    anyl = (lines.filter(F.col("line").rlike(RX_IMPORT_ANY))
                 .select(*FILE, F.regexp_extract("line", RX_IMPORT_ANY, 2).alias("dependency"))
                 .filter(F.col("dependency").startswith(".")))
    return script.unionByName(anyl).distinct()
