"""Code smells (L1-L8) as filters + projections.  Output schema of every
detector: ``repo, path, type, name, line, message``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.functions import text as T
from codelake.operators import pyfacts as P

SMELL_COLUMNS = ["repo", "path", "type", "name", "line", "message"]


def _fmt(template: str, **cols):
    """Render a ``{n}``/``{m}`` message template with columns (format_string)."""
    spec = template
    args = []
    for key in ("n", "m"):
        if "{" + key + "}" in spec:
            spec = spec.replace("{" + key + "}", "%s")
            args.append(cols[key])
    return F.format_string(spec, *args)


def _t(name):
    return K.SMELL_THRESHOLDS[name]


def smell_long_method(nodes: DataFrame, max_length: int = _t("max_function_length")) -> DataFrame:
    """L1: ``end_lineno - lineno > max`` on every def."""
    n = F.col("end_lineno") - F.col("lineno")
    return (nodes.filter(F.col("kind").isin(P.DEF_KINDS) & (n > max_length))
                 .select("repo", "path", F.lit("Long Method").alias("type"), "name",
                         F.col("lineno").alias("line"),
                         _fmt(K.MSG_LONG_METHOD, n=n, m=F.lit(max_length)).alias("message")))


def smell_large_class(nodes: DataFrame, max_length: int = _t("max_class_length")) -> DataFrame:
    """L4: ``end_lineno - lineno > max`` on every class."""
    n = F.col("end_lineno") - F.col("lineno")
    return (nodes.filter((F.col("kind") == "ClassDef") & (n > max_length))
                 .select("repo", "path", F.lit("Large Class").alias("type"), "name",
                         F.col("lineno").alias("line"),
                         _fmt(K.MSG_LARGE_CLASS, n=n, m=F.lit(max_length)).alias("message")))


def smell_too_many_parameters(nodes: DataFrame, max_params: int = _t("max_parameters")) -> DataFrame:
    """L2: positional parameters other than ``self`` above the maximum.

    Counted straight from ``arg`` rows grouped by their def: no join."""
    args = (nodes.filter((F.col("kind") == "arg") & (F.col("field") == "args") &
                         (P.parent().kind == "arguments") & P.parent(2).kind.isin(P.DEF_KINDS) &
                         (F.col("name") != "self"))
                 .groupBy("repo", "path", P.parent(2).pre.alias("def_pre"))
                 .agg(F.count(F.lit(1)).alias("n"), F.first(P.parent(2)["name"]).alias("name"),
                      F.first(P.parent(2).lineno).alias("line")))
    return (args.filter(F.col("n") > max_params)
                .select("repo", "path", F.lit("Too Many Parameters").alias("type"), "name", "line",
                        _fmt(K.MSG_TOO_MANY_PARAMS, n=F.col("n"), m=F.lit(max_params)).alias("message")))


def smell_deep_nesting(nodes: DataFrame, max_depth: int = _t("max_nesting_depth")) -> DataFrame:
    """L3: one row per if/for/while nested deeper than the maximum."""
    return (P.py_nesting(nodes).filter(F.col("depth") > max_depth)
             .select("repo", "path", F.lit("Deep Nesting").alias("type"),
                     F.lit(None).cast("string").alias("name"), "line",
                     _fmt(K.MSG_DEEP_NESTING, n=F.col("depth"), m=F.lit(max_depth)).alias("message")))


def python_smells(nodes: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """All Python smells (L1-L4) in one pass: def, class and loop rows plus
    the non-``self`` parameter rows keyed to their def; one group-by, then
    each group emits the smells it has."""
    kind, field = F.col("kind"), F.col("field")
    loops = ["If", "For", "While"]
    is_def, is_cls, is_loop = kind.isin(P.DEF_KINDS), kind == "ClassDef", kind.isin(loops)
    is_arg = ((kind == "arg") & (field == "args") & (P.parent().kind == "arguments") &
              P.parent(2).kind.isin(P.DEF_KINDS) & (F.col("name") != "self"))
    key = F.when(is_arg, P.parent(2).pre).otherwise(F.col("pre"))
    own = F.struct(F.col("kind").alias("kind"), F.col("name").alias("name"), F.col("lineno").alias("line"),
                   (F.col("end_lineno") - F.col("lineno")).alias("length"),
                   (F.col("n_loops") + 1).alias("depth"))
    g = (nodes.filter(is_def | is_cls | is_loop | is_arg)
              .groupBy("repo", "path", key.alias("k"))
              .agg(F.first(F.when(~is_arg, own), ignorenulls=True).alias("o"),
                   F.count_if(is_arg).alias("n_args")))
    o = F.col("o")
    t = {**K.SMELL_THRESHOLDS, **(thresholds or {})}  # P3: thresholds are keyword config
    none = F.lit(None).cast("string")

    def smell(cond, typ, name, message):
        return F.when(cond, F.struct(F.lit(typ).alias("type"), name.alias("name"), message.alias("message")))

    cands = F.array(
        smell(o.kind.isin(P.DEF_KINDS) & (o.length > t["max_function_length"]), "Long Method", o["name"],
              _fmt(K.MSG_LONG_METHOD, n=o.length, m=F.lit(t["max_function_length"]))),
        smell(o.kind.isin(P.DEF_KINDS) & (F.col("n_args") > t["max_parameters"]), "Too Many Parameters",
              o["name"], _fmt(K.MSG_TOO_MANY_PARAMS, n=F.col("n_args"), m=F.lit(t["max_parameters"]))),
        smell(o.kind.isin(loops) & (o.depth > t["max_nesting_depth"]), "Deep Nesting", none,
              _fmt(K.MSG_DEEP_NESTING, n=o.depth, m=F.lit(t["max_nesting_depth"]))),
        smell((o.kind == "ClassDef") & (o.length > t["max_class_length"]), "Large Class", o["name"],
              _fmt(K.MSG_LARGE_CLASS, n=o.length, m=F.lit(t["max_class_length"]))))
    return (g.filter(o.isNotNull())
             .select("repo", "path", F.col("o.line").alias("line"),
                     F.explode(F.filter(cands, lambda x: x.isNotNull())).alias("s"))
             .select("repo", "path", F.col("s.type").alias("type"), F.col("s.name").alias("name"), "line",
                     F.col("s.message").alias("message")))


# ---------------------------------------------------------------- line smells

def smell_long_line(lines: DataFrame) -> DataFrame:
    """L5 (JS/TS): stripped line longer than 120 characters."""
    return (lines.filter(F.col("language").isin("javascript", "typescript") &
                         (F.char_length("stripped") > 120))
                 .select("repo", "path", F.lit("Long Line").alias("type"),
                         F.lit(None).cast("string").alias("name"), F.col("line_no").alias("line"),
                         F.lit(K.MSG_LONG_LINE).alias("message")))


def smell_complex_condition(lines: DataFrame) -> DataFrame:
    """L6 (JS/TS): more than three ``if`` / ``&&`` / ``||`` substrings on a line."""
    c = F.col("line")
    return (lines.filter(F.col("language").isin("javascript", "typescript") &
                         ((T.count_sub(c, "if") > 3) | (T.count_sub(c, "&&") > 3) | (T.count_sub(c, "||") > 3)))
                 .select("repo", "path", F.lit("Complex Condition").alias("type"),
                         F.lit(None).cast("string").alias("name"), F.col("line_no").alias("line"),
                         F.lit(K.MSG_COMPLEX_CONDITION).alias("message")))


def smell_nested_blocks(lines: DataFrame) -> DataFrame:
    """L7 (C++/C#): more than three ``{`` on a line."""
    return (lines.filter(F.col("language").isin("c++", "c#") & (T.count_sub("line", "{") > 3))
                 .select("repo", "path", F.lit("Nested Blocks").alias("type"),
                         F.lit(None).cast("string").alias("name"), F.col("line_no").alias("line"),
                         F.lit(K.MSG_NESTED_BLOCKS).alias("message")))


def smell_multiple_style_blocks(files: DataFrame) -> DataFrame:
    """L8 (Svelte): ``<style`` occurs more than once in the file."""
    return (files.filter((F.col("language") == "svelte") & (T.count_sub("content", "<style") > 1))
                 .select("repo", "path", F.lit("Multiple Style Blocks").alias("type"),
                         F.lit(None).cast("string").alias("name"), F.lit(1).alias("line"),
                         F.lit(K.MSG_MULTIPLE_STYLES).alias("message")))


def line_smells(files: DataFrame, lines: DataFrame) -> DataFrame:
    return (smell_long_line(lines).unionByName(smell_complex_condition(lines))
            .unionByName(smell_nested_blocks(lines)).unionByName(smell_multiple_style_blocks(files)))


# ---------------------------------------------------------------- aggregates

def smell_counts(smells: DataFrame) -> DataFrame:
    """Smells per repo and type."""
    return smells.groupBy("repo", "type").agg(F.count(F.lit(1)).alias("n"))


def recurring_smells(smells: DataFrame, min_count: int = 3) -> DataFrame:
    """Smell types seen more than ``min_count`` times in a repo."""
    return smell_counts(smells).filter(F.col("n") > min_count)
