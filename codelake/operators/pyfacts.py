"""Python facts over ``py_nodes`` (C1-C9, I3, I4, J7) -- all DataFrame code.

Conventions: ``p1``/``p2``/``p3`` are the parent, grandparent and
great-grandparent structs of a node, ``defs`` its enclosing defs.  A
definition is keyed by ``(repo, path, def_pre)``: node position, not name
(ledger Q3), so same-named functions never collide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEF_KINDS = ["FunctionDef", "AsyncFunctionDef"]
SCOPE_KINDS = ["FunctionDef", "AsyncFunctionDef", "ClassDef", "Lambda"]


def parent(i: int = 1):
    """Ancestor ``i`` levels up (1 = parent, up to 3) as a struct column."""
    return F.col(f"p{i}")


# ---------------------------------------------------------------- imports

def py_imports(nodes: DataFrame) -> DataFrame:
    """One row per imported name: ``import a.b as c`` and ``from m import n as x``.

    ``level`` keeps the relative-import depth (dropped by the reference's model).
    """
    a = nodes.filter((F.col("kind") == "alias") & parent().kind.isin("Import", "ImportFrom"))
    is_from = parent().kind == "ImportFrom"
    return a.select(
        "repo", "path",
        F.when(is_from, F.col("attrs")["module"]).otherwise(F.col("name")).alias("module"),
        F.when(is_from, F.col("name")).alias("name"),
        F.col("attrs")["asname"].alias("alias"),
        F.when(is_from, F.col("attrs")["level"].cast("int")).otherwise(F.lit(0)).alias("level"),
        is_from.alias("is_from_import"),
        parent().lineno.alias("line_no"),
        parent().pre.alias("stmt_pre"),
        "ord",
    )


def py_raw_dependencies(imports: DataFrame) -> DataFrame:
    """Module names a file depends on, as the reference lists them (C8):
    plain imports cut to the first dotted part; relative from-imports get
    their leading dots back; from-imports give one entry per statement (its
    first name row) and are skipped without a module.  Single pass."""
    frm = F.col("is_from_import")
    return (imports.filter(~frm | ((F.col("ord") == 0) & (F.col("module") != "")))
                   .select("repo", "path",
                           F.when(frm, F.concat(F.repeat(F.lit("."), F.col("level")), F.col("module")))
                            .otherwise(F.split_part(F.col("module"), F.lit("."), F.lit(1))).alias("dependency")))


# ---------------------------------------------------------------- definitions

def py_functions(nodes: DataFrame) -> DataFrame:
    """Every function/method at any depth (C3), async included (ledger Q15).

    ``owner_class`` is set for methods directly in a class body (C5 /
    ledger Q5); ``args`` are the positional parameters with annotations.

    Single pass: the def row and its parameter, annotation, return and
    decorator rows all carry the def's position (``p1``-``p3``), so one
    group-by assembles each function -- one parse, one shuffle, no join.
    """
    kind, field = F.col("kind"), F.col("field")
    p1, p2, p3 = parent(1), parent(2), parent(3)
    is_def = kind.isin(DEF_KINDS)
    is_arg = (kind == "arg") & (field == "args") & (p1.kind == "arguments") & p2.kind.isin(DEF_KINDS)
    is_ann = (field == "annotation") & (p1.kind == "arg") & (p2.kind == "arguments") & p3.kind.isin(DEF_KINDS)
    is_ret = (field == "returns") & p1.kind.isin(DEF_KINDS)
    is_dec = (field == "decorator_list") & p1.kind.isin(DEF_KINDS)
    key = F.when(is_def, F.col("pre")).when(is_arg, p2.pre).when(is_ann, p3.pre).otherwise(p1.pre)
    d = F.struct(
        F.col("name").alias("name"),
        F.when((p1.kind == "ClassDef") & (field == "body"), p1["name"]).alias("owner_class"),
        F.when((p1.kind == "ClassDef") & (field == "body"), p1.pre).alias("owner_pre"),
        (kind == "AsyncFunctionDef").alias("is_async"),
        F.col("attrs")["docstring"].alias("docstring"),
        F.col("lineno").alias("line_start"), F.col("end_lineno").alias("line_end"),
        F.col("col").alias("col_start"), F.col("end_col").alias("col_end"))
    g = (nodes.filter(is_def | is_arg | is_ann | is_ret | is_dec)
              .groupBy("repo", "path", key.alias("def_pre"))
              .agg(F.first(F.when(is_def, d), ignorenulls=True).alias("d"),
                   F.array_sort(F.collect_list(F.when(is_arg, F.struct("pre", "name")))).alias("arg_rows"),
                   F.map_from_entries(F.collect_list(F.when(is_ann, F.struct(p1.pre, F.col("text"))))).alias("ann"),
                   F.max(F.when(is_ret, F.col("text"))).alias("returns"),
                   F.array_sort(F.collect_list(F.when(is_dec, F.struct("ord", "text")))).alias("decs")))
    args = F.transform("arg_rows", lambda a: F.struct(a["name"].alias("name"),
                                                      F.element_at(F.col("ann"), a["pre"]).alias("type")))
    return (g.filter(F.col("d").isNotNull())
             .select("repo", "path", "def_pre", F.col("d.owner_class").alias("owner_class"), F.col("d.owner_pre").alias("owner_pre"),
                     F.col("d.name").alias("name"), args.alias("args"), "returns",
                     F.col("d.docstring").alias("docstring"),
                     F.transform("decs", lambda x: x["text"]).alias("decorators"),
                     F.col("d.is_async").alias("is_async"), F.col("d.line_start").alias("line_start"),
                     F.col("d.line_end").alias("line_end"), F.col("d.col_start").alias("col_start"),
                     F.col("d.col_end").alias("col_end")))


def py_classes(nodes: DataFrame) -> DataFrame:
    """Every class with bases, decorators, docstring and span (C4), in one
    group-by keyed by the class position."""
    kind, field = F.col("kind"), F.col("field")
    is_cls = kind == "ClassDef"
    is_kid = field.isin("bases", "decorator_list") & (parent().kind == "ClassDef")
    c = F.struct(F.col("name").alias("name"), F.col("attrs")["docstring"].alias("docstring"),
                 F.col("lineno").alias("line_start"), F.col("end_lineno").alias("line_end"),
                 F.col("col").alias("col_start"), F.col("end_col").alias("col_end"))
    g = (nodes.filter(is_cls | is_kid)
              .groupBy("repo", "path", F.when(is_cls, F.col("pre")).otherwise(parent().pre).alias("class_pre"))
              .agg(F.first(F.when(is_cls, c), ignorenulls=True).alias("c"),
                   F.array_sort(F.collect_list(F.when(field == "bases", F.struct("ord", "text")))).alias("b"),
                   F.array_sort(F.collect_list(F.when(field == "decorator_list", F.struct("ord", "text"))))
                   .alias("dd")))
    return (g.filter(F.col("c").isNotNull())
             .select("repo", "path", "class_pre", F.col("c.name").alias("name"),
                     F.transform("b", lambda x: x["text"]).alias("base_classes"),
                     F.col("c.docstring").alias("docstring"),
                     F.transform("dd", lambda x: x["text"]).alias("decorators"),
                     *[F.col("c." + k).alias(k) for k in ("line_start", "line_end", "col_start", "col_end")]))


def py_variables(nodes: DataFrame) -> DataFrame:
    """Assignments at module level and directly in class bodies.

    The variable is the first plain-name target; ``value`` is the source
    text of the assigned expression.  Module scope means no enclosing
    def/class/lambda (ledger Q5).
    """
    kids = nodes.filter((parent().kind == "Assign") & F.col("field").isin("targets", "value"))
    agg = (kids.groupBy("repo", "path", F.col("parent").alias("assign_pre"))
               .agg(F.min_by(F.when((F.col("field") == "targets") & (F.col("kind") == "Name"), F.col("name")),
                             F.when((F.col("field") == "targets") & (F.col("kind") == "Name"), F.col("ord")))
                    .alias("name"),
                    F.max(F.when(F.col("field") == "value", F.col("text"))).alias("value"),
                    F.first(parent().lineno).alias("line_start"),
                    F.max(F.when(F.col("field") == "value", F.col("end_lineno"))).alias("line_end"),
                    F.first(parent(2)).alias("outer"), F.first("n_scopes").alias("n_scopes")))
    # the Assign's parent is the child's grandparent; Assign itself is no scope
    scope = (F.when(F.col("outer").kind == "ClassDef", F.lit("class"))
              .when(F.col("n_scopes") == 0, F.lit("module")))
    return (agg.filter(F.col("name").isNotNull())
               .select("repo", "path", "assign_pre", "name", F.lit(None).cast("string").alias("type_hint"),
                       "value", scope.alias("scope"),
                       F.when(scope == "class", F.col("outer")["name"]).alias("owner_class"),
                       F.when(scope == "class", F.col("outer")["pre"]).alias("owner_pre"),
                       "line_start", "line_end")
               .filter(F.col("scope").isNotNull()))


# ---------------------------------------------------------------- calls

def py_file_calls(nodes: DataFrame) -> DataFrame:
    """Distinct callee names per file: ``f(...)`` -> f, ``x.m(...)`` -> m."""
    return (nodes.filter((F.col("field") == "func") & (parent().kind == "Call") &
                         F.col("kind").isin("Name", "Attribute"))
                 .select("repo", "path", F.col("name").alias("callee"))
                 .distinct())


# ---------------------------------------------------------------- metrics

def py_complexity(nodes: DataFrame) -> DataFrame:
    """Cyclomatic complexity per def (I4): 1 + branches + extra boolean
    operands over every descendant, nested defs included (as the reference
    walks them).  Each weighted node is credited to all of its enclosing
    defs through ``defs``; def rows carry name and line -- one group-by."""
    kind = F.col("kind")
    is_def = kind.isin(DEF_KINDS)
    w = (F.when(kind.isin("If", "While", "For", "Match", "ExceptHandler"), F.lit(1))
          .when(kind == "BoolOp", F.col("n_values") - 1).otherwise(F.lit(0)))
    me = F.array(F.struct(F.col("pre").alias("k"), F.col("name").alias("name"),
                          F.col("lineno").alias("line"), F.lit(0).alias("w")))
    up = F.transform("defs",
                     lambda a: F.struct(a.pre.alias("k"), F.lit(None).cast("string").alias("name"),
                                        F.lit(None).cast("int").alias("line"), w.alias("w")))
    rows = (nodes.filter(is_def | (w > 0))
                 .select("repo", "path", F.explode(F.when(is_def, me).otherwise(up)).alias("e")))
    return (rows.groupBy("repo", "path", F.col("e.k").alias("def_pre"))
                .agg(F.first("e.name", ignorenulls=True).alias("name"),
                     F.first("e.line", ignorenulls=True).alias("line_start"),
                     F.sum("e.w").alias("w"))
                .filter(F.col("name").isNotNull())
                .select("repo", "path", "def_pre", "name", "line_start",
                        (F.lit(1) + F.col("w")).cast("int").alias("complexity")))


def py_nesting(nodes: DataFrame) -> DataFrame:
    """Nesting level of every if/for/while (J7): 1 + enclosing if/for/while
    nodes; an ``elif`` counts as a level; nested defs do not reset it."""
    loops = ["If", "For", "While"]
    return (nodes.filter(F.col("kind").isin(loops))
                 .select("repo", "path", "pre", "kind", F.col("lineno").alias("line"),
                         (F.col("n_loops") + 1).alias("depth")))


def file_definition_counts(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions (outside class bodies) and classes per file, zero-filled (I3):
    one group-by over the node rows, left-joined to the file list."""
    kind = F.col("kind")
    is_fn = kind.isin(DEF_KINDS) & ~((parent().kind == "ClassDef") & (F.col("field") == "body"))
    cnt = (nodes.filter(kind.isin(DEF_KINDS + ["ClassDef"]))
                .groupBy("repo", "path")
                .agg(F.count_if(is_fn).alias("n_functions"), F.count_if(kind == "ClassDef").alias("n_classes")))
    return (files.select("repo", "path").join(cnt, ["repo", "path"], "left")
                 .select("repo", "path", F.coalesce("n_functions", F.lit(0)).cast("bigint").alias("n_functions"),
                         F.coalesce("n_classes", F.lit(0)).cast("bigint").alias("n_classes")))


def distinct_return_calls(nodes: DataFrame) -> DataFrame:
    """Per method (def directly in a class body), the number of
    distinct plain-name callees of ``return f(...)`` anywhere in its subtree;
    more than one means it creates different objects (the strict factory
    test of L10).  Return-call rows are credited to every enclosing def."""
    kind = F.col("kind")
    is_method = kind.isin(DEF_KINDS) & (parent().kind == "ClassDef") & (F.col("field") == "body")
    ret_call = (kind == "Name") & (F.col("field") == "func") & (parent(1).kind == "Call") & (parent(2).kind == "Return")
    rows = (nodes.filter(is_method | ret_call)
                 .select("repo", "path", F.explode(F.when(is_method, F.array(F.struct(
                     F.col("pre").alias("k"), F.col("name").alias("method"), F.lit(None).cast("string").alias("callee"))))
                     .otherwise(F.transform("defs", lambda d: F.struct(d.pre.alias("k"),
                                                                      F.lit(None).cast("string").alias("method"),
                                                                      F.col("name").alias("callee"))))).alias("e")))
    return (rows.groupBy("repo", "path", F.col("e.k").alias("def_pre"))
                .agg(F.first("e.method", ignorenulls=True).alias("name"),
                     F.countDistinct("e.callee").alias("n_return_calls"))
                .filter(F.col("name").isNotNull())
                .withColumn("creates_objects", F.col("n_return_calls") > 1))


def dedupe_by_name(defs: DataFrame) -> DataFrame:
    """The analysed tool keys some per-function results by bare name, so
    a later definition overwrites an earlier one; this keeps the last
    definition per (repo, path, name) -- a window per file, no global sort."""
    from pyspark.sql import Window
    w = Window.partitionBy("repo", "path", "name").orderBy(F.col("def_pre").desc())
    return defs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
