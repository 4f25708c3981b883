"""Function behaviour over ``py_nodes``.

The owner of a node is the innermost def whose body holds it (``scope``,
ledger Q18).  Facts that the analysed tool gathers by walking the whole def
subtree (generators, recursion, exit points) are credited to every enclosing
def through ``defs``.

Names are resolved as the language does (J4): in the def itself, then in the
defs around it from the inside out, then in the module, then as builtins.  Class
bodies, comprehensions and lambdas bind nothing for others.  A read asks each
def around it by one row of its own, which meets the bindings of that def and
name in the group it falls in, so nothing is joined or paired.

Plan shape: one stream of narrow fact rows is hash-partitioned on
``(repo, path)``; every later group-by and window is keyed by a superset of
that, so there is one parse and one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.operators.pyast import IN_CLASS, INNER, USES
from codelake.operators.pyfacts import DEF_KINDS, parent
from codelake.session import stage_parquet

_EVENTS = "array<struct<a:int,b:int,s:string>>"
_FACT = f"struct<def:int,var:string,tag:string,a:int,b:int,s:string,ev:{_EVENTS}>"
MODULE = -1      # the def key of what a module binds


def _rows(nodes: DataFrame) -> DataFrame:
    """The fact rows ``(repo, path, def, var, tag, a, b, s, ev)``, by file; ``ev``
    holds the uses of a name, as (position, line, context)."""
    kind, field, name, scope, pre, line = (F.col(c) for c in ("kind", "field", "name", "scope", "pre", "lineno"))
    p1, p2, p3 = parent(1), parent(2), parent(3)
    inside = scope.isNotNull()
    outside = F.col("n_scopes") == 0
    is_def = kind.isin(DEF_KINDS)
    is_name = (kind == "Name") & inside
    inner = F.coalesce(F.col("n_values") == INNER, F.lit(False))
    in_class = F.coalesce(F.col("n_values") == IN_CLASS, F.lit(False))
    call_name = (kind == "Name") & (field == "func") & (p1.kind == "Call")
    imported = (kind == "alias") & p1.kind.isin("Import", "ImportFrom")
    bound = F.coalesce(F.col("attrs")["asname"],
                       F.when(p1.kind == "Import", F.split_part(name, F.lit("."), F.lit(1))).otherwise(name))
    exc = is_name & (((p1.kind == "ExceptHandler") & (field == "type")) | ((p1.kind == "Tuple") & (p2.kind == "ExceptHandler")))
    # local bindings that are no Name of a Store: except aliases, nested defs
    # and classes, match captures
    local_name = inside & name.isNotNull() & kind.isin(DEF_KINDS + ["ClassDef", "ExceptHandler", "MatchAs", "MatchStar", "MatchMapping"])
    null = F.lit(None)

    def fact(key, var, tag, a=null, b=null, s=null, ev=null):
        return F.struct(key.cast("int").alias("def"), (var if isinstance(var, Column) else F.lit(var)).cast("string").alias("var"), F.lit(tag).alias("tag"),
                        a.cast("int").alias("a"), b.cast("int").alias("b"), s.cast("string").alias("s"), ev.cast(_EVENTS).alias("ev"))

    def one(cond, *args):
        return F.when(cond, F.array(fact(*args)))

    def each(cond, items, f):
        return F.when(cond, F.transform(items, f))
    up = F.col("defs")
    facts = [
        # a name of an enclosing comprehension or lambda stands for itself; one
        # in a class body is reported, but binds nothing for nested defs
        one(is_name, scope, name, "ev", null, null, null, F.array(F.struct(pre.alias("a"), line.alias("b"), F.concat(
            F.when(inner, "i").when(in_class, "c").otherwise(""), F.col("ctx")).alias("s")))),
        # a read asks the defs around its own
        each(is_name & ~inner & (F.col("ctx") == "Load"), F.filter(up, lambda d: d["pre"] < scope), lambda d: fact(d["pre"], name, "ask", scope)),
        one((kind == "arg") & (p1.kind == "arguments") & p2.kind.isin(DEF_KINDS), p2.pre, name, "param", p2.lineno),
        one((kind == "arg") & (p1.kind == "arguments") & (p2.kind == "Lambda") & inside, scope, name, "inner"),
        one((field == "annotation") & (p1.kind == "arg") & (p2.kind == "arguments") & p3.kind.isin(DEF_KINDS),
            p3.pre, p1["name"], "hint", null, null, F.col("text")),
        each(kind.isin("Global", "Nonlocal") & inside, F.split(name, ","), lambda n: fact(scope, n, "decl", pre, null, kind)),
        one(imported & inside, scope, bound, "bind"),
        one(local_name, scope, name, "bind"),
        # module-level bindings that are not "global variable" reads (ledger
        # Q13) -- at any depth outside defs and classes, e.g. under ``try:``
        one(kind.isin(DEF_KINDS + ["ClassDef"]) & outside, F.lit(MODULE), name, "bind"),
        one(imported & outside, F.lit(MODULE), bound, "bind"),
        one(call_name & name.isin(K.SIDE_EFFECT_CALLS) & inside, scope, None, "call", pre, null, F.concat(F.lit("Calls "), name)),
        one(exc, scope, None, "except", null, null, name),
        one(is_def, pre, None, "def", line, (kind == "AsyncFunctionDef"), name),
        # facts credited to every enclosing def (the tool walks the subtree)
        each(call_name & (p2.kind == "Return"), up, lambda d: fact(d["pre"], None, "exit", F.col("depth"), pre, name)),
        each(kind == "Yield", up, lambda d: fact(d["pre"], None, "yield")),
        each(call_name, F.filter(up, lambda d: d["name"] == name), lambda d: fact(d["pre"], None, "recur")),
    ]
    none = F.array().cast(f"array<{_FACT}>")
    # most rows are names of which only the event is reported
    plain = is_name & ((F.col("ctx") == "Store") | ((F.size(up) < 2) & (field != "func") & ~p1.kind.isin("ExceptHandler", "Tuple")))
    part = lambda u, i: F.split_part(u, F.lit(" "), F.lit(i))
    used = F.transform(F.split("text", ","), lambda u: F.struct(part(u, 1).cast("int").alias("a"), part(u, 2).cast("int").alias("b"), part(u, 3).alias("s")))
    every = F.when(kind == USES, one(kind == USES, scope, name, "ev", null, null, null, used)).when(plain, facts[0]).otherwise(F.concat(*(F.coalesce(x, none) for x in facts)))
    some = nodes.filter(kind.isin("Name", "arg", "alias", "Global", "Nonlocal", "ClassDef", "ExceptHandler", "MatchAs", "MatchStar", "MatchMapping", "Yield",
                                  USES, *DEF_KINDS) | (field == "annotation"))
    return some.select("repo", "path", F.explode(every).alias("f")).select("repo", "path", "f.*").repartition("repo", "path")


def _tagged(tag: str, value: Column | None = None) -> Column:
    return F.when(F.col("tag") == tag, F.struct("a", "b", "s") if value is None else value)


def _names(rows: DataFrame) -> DataFrame:
    """One row per (def, name) and, with ``var`` null, one per def, each with
    its facts; of a name also ``at``, the def around it that binds what it
    reads, and ``module_bound``."""
    g = (rows.groupBy("repo", "path", "def", "var")
         .agg(F.array_sort(F.flatten(F.collect_list("ev"))).alias("ev"), F.array_sort(F.collect_list(_tagged("decl"))).alias("decls"),
              F.collect_set(_tagged("ask", F.col("a"))).alias("asked"), F.max(_tagged("param", F.col("a"))).alias("param_line"),
              F.max(_tagged("hint", F.col("s"))).alias("hint"), F.count_if(F.col("tag") == "bind").alias("n_bind"),
              F.count_if(F.col("tag") == "inner").alias("n_inner"),
              F.collect_list(F.when(F.col("var").isNull(), F.struct("tag", "a", "b", "s"))).alias("facts")))
    stores = F.exists("ev", lambda e: e["s"] == "Store")
    binds = (F.size("decls") == 0) & ((F.col("n_bind") > 0) | F.col("param_line").isNotNull() | stores)
    g = g.withColumn("binds", binds)
    # the answer goes back to the defs that asked
    payload = ["ev", "decls", "param_line", "hint", "n_inner", "facts", "binds"]
    mine = F.struct(F.col("def").alias("to"), F.lit(None).cast("int").alias("at"), F.struct(*payload).alias("own"))
    answers = F.transform("asked", lambda d: F.struct(d.alias("to"), F.col("def").alias("at"), F.lit(None).alias("own")))
    sent = g.select("repo", "path", "var", F.explode(F.concat(F.array(mine), F.when(F.col("binds"), answers).otherwise(F.array().cast(
        "array<struct<to:int,at:int,own:void>>")))).alias("m")).select("repo", "path", "var", "m.*")
    got = sent.groupBy("repo", "path", "var", F.col("to").alias("def")).agg(
        F.first("own", ignorenulls=True).alias("own"), F.max("at").alias("at")).select("repo", "path", "var", "def", "at", "own.*")
    name = Window.partitionBy("repo", "path", "var")
    return got.withColumn("module_bound", F.max((F.col("def") == MODULE) & F.col("binds")).over(name)).filter(F.col("def") >= 0)


def _resolved(names: DataFrame) -> DataFrame:
    """Names with scope (J4), assignment and read lines (L24, I11), and the
    side-effect messages they cause (L25)."""
    own = lambda e: ~e["s"].startswith("i")
    first = F.get(F.filter("ev", own), F.lit(0))["s"]
    of = lambda what: F.transform(F.filter("ev", lambda e: e["s"].endswith(what)), lambda e: e["b"])
    is_param = F.col("param_line").isNotNull()
    kind = F.get("decls", F.size("decls") - 1)["s"]
    free = first.endswith("Load") & ~F.col("binds") & ~is_param
    # a name that a class body reads may be one of its own
    own_class = F.exists("ev", lambda e: e["s"] == "cStore") & first.startswith("c")
    scope = (F.when(kind == "Global", "global").when(kind == "Nonlocal", "nonlocal").when(is_param, "parameter")
              .when(free & F.col("at").isNotNull(), "nonlocal").when(free & ~own_class, "global").otherwise("local"))
    reads_global = ((F.size("decls") == 0) & free & F.col("at").isNull() & ~own_class & ~F.col("module_bound") & ~F.col("var").isin(K.PY_BUILTINS))
    msgs = F.transform("decls", lambda d: F.struct(d["a"].alias("pre"), F.concat(
        F.when(d["s"] == "Global", "Uses global variable ").otherwise("Uses nonlocal variable "), F.col("var")).alias("msg")))
    none = F.array().cast("array<struct<pre:int,msg:string>>")
    read = F.array(F.struct(F.get(F.filter("ev", own), F.lit(0))["a"].alias("pre"), F.concat(F.lit("Uses global variable "), F.col("var")).alias("msg")))
    assigned = F.concat(F.when(is_param, F.array("param_line")).otherwise(F.array().cast("array<int>")), of("Store"))
    # a bare binding is no variable of the flow
    used = (F.size("ev") > 0) | is_param | (F.size("decls") > 0)
    return names.select("repo", "path", "def", "var", used.alias("used"), scope.alias("scope"), assigned.alias("assignments"), of("Load").alias("reads"),
                        F.col("hint").alias("type_hints"), "facts",
                        F.when(used & F.col("var").isNotNull(), F.concat(msgs, F.when(reads_global, read).otherwise(none))).otherwise(none).alias("se"))


def variable_flow(nodes: DataFrame) -> DataFrame:
    """Scope, assignment and read lines of every variable of a def."""
    return _flow(_resolved(_names(_rows(nodes))))


def _flow(names: DataFrame) -> DataFrame:
    of_def = Window.partitionBy("repo", "path", "def")
    here = F.get(F.filter("facts", lambda f: f["tag"] == "def"), F.lit(0))["s"]
    v = names.withColumn("function", F.max(here).over(of_def))
    return v.filter(F.col("var").isNotNull() & F.col("used") & F.col("function").isNotNull()).select(
        "repo", "path", F.col("def").alias("def_pre"), "function", F.col("var").alias("name"), "scope", "assignments", "reads", "type_hints")


def function_behavior(nodes: DataFrame) -> DataFrame:
    """What a def does besides computing its result."""
    return _behaviour(_resolved(_names(_rows(nodes))))


def _behaviour(names: DataFrame) -> DataFrame:
    d = (names.groupBy("repo", "path", "def")
         .agg(F.flatten(F.collect_list("se")).alias("var_se"), F.flatten(F.collect_list("facts")).alias("facts")))
    of = lambda tag, f: F.transform(F.filter("facts", lambda x: x["tag"] == tag), f)
    has = lambda tag: F.exists("facts", lambda x: x["tag"] == tag)
    d = d.withColumn("d", F.get(of("def", lambda x: x), F.lit(0))).filter(F.col("d").isNotNull())
    se = F.transform(F.array_sort(F.concat("var_se", of("call", lambda x: F.struct(x["a"].alias("pre"), x["s"].alias("msg"))))), lambda x: x["msg"])
    exits = F.transform(F.array_sort(of("exit", lambda x: F.struct(x["a"].alias("depth"), x["b"].alias("pre"), x["s"].alias("s")))), lambda x: x["s"])
    d = d.withColumn("side_effects", se)
    return d.select("repo", "path", F.col("def").alias("def_pre"), F.col("d.s").alias("name"), F.col("d.a").alias("line_start"),
                    (F.col("d.b") == 1).alias("is_async"), has("yield").alias("is_generator"), has("recur").alias("is_recursive"),
                    "side_effects", (F.size("side_effects") == 0).alias("is_pure"),
                    F.array_sort(F.array_distinct(of("except", lambda x: x["s"]))).alias("handled_exceptions"), exits.alias("exit_points"))


def analyse(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(behaviour, variable_flow)`` of a staged node table; what both are made
    of is staged."""
    names = stage_parquet(_resolved(_names(_rows(nodes))), "names")
    return _behaviour(names), _flow(names)


def control_flow(nodes: DataFrame) -> DataFrame:
    """Return / if / while / for rows per function with condition text
    and branch start lines, which the node rows carry as ``attrs``: the
    statements of a branch are no rows of their own here."""
    kind, attrs = F.col("kind"), F.col("attrs")
    ctrl = kind.isin("Return", "If", "While", "For") & F.col("scope").isNotNull()

    def lines(branch):
        at = F.transform(F.split(attrs[branch], ","), lambda x, i: F.struct(i.alias("ord"), x.cast("int").alias("lineno")))
        return F.array_sort(F.flatten(F.collect_list(at)))
    g = (nodes.filter(ctrl).groupBy("repo", "path", "pre")
              .agg(F.first(F.struct("scope", "kind", "lineno")).alias("n"), *[F.max(attrs[h]).alias(h) for h in ("test", "target", "iter")],
                   lines("body").alias("body"), lines("orelse").alias("orelse")))
    k = F.col("n.kind")
    cond = (F.when(k.isin("If", "While"), F.col("test"))
             .when(k == "For", F.concat(F.lit("for "), F.col("target"), F.lit(" in "), F.col("iter"))))
    return g.select("repo", "path", F.col("n.scope").alias("def_pre"), F.col("n.lineno").alias("line_no"),
                    F.lower(k).alias("node_type"), cond.alias("condition"),
                    F.transform("body", lambda x: x["lineno"]).alias("true_branch"),
                    F.when(k == "If", F.transform("orelse", lambda x: x["lineno"]))
                     .otherwise(F.array().cast("array<int>")).alias("false_branch"))


def return_prefixes(nodes: DataFrame) -> DataFrame:
    """Per def the lines of its control-flow nodes in visit order, stored
    once, and its returns as (line_no, n): a return's path is the first n
    lines.  As many values as there are control-flow nodes."""
    ctrl = F.col("kind").isin("Return", "If", "While", "For") & F.col("scope").isNotNull()
    c = nodes.filter(ctrl).groupBy("repo", "path", F.col("scope").alias("def_pre")).agg(
        F.array_sort(F.collect_list(F.struct("pre", "lineno", (F.col("kind") == "Return").alias("ends")))).alias("c"))
    numbered = F.transform("c", lambda x, i: F.struct(x["lineno"].alias("line_no"), (i + 1).alias("n"), x["ends"].alias("ends")))
    returns = F.transform(F.filter(numbered, lambda x: x["ends"]), lambda x: F.struct(x["line_no"], x["n"]))
    return c.select("repo", "path", "def_pre", F.transform("c", lambda x: x["lineno"]).alias("lines"),
                    returns.cast("array<struct<line_no:int,n:int>>").alias("returns")).filter(F.size("returns") > 0)


def return_paths(nodes: DataFrame) -> DataFrame:
    """J2 in the analysed tool's shape: for each return, the lines of the
    control-flow nodes visited before it in its function, then its own line
    (listed once, ledger Q14).  A view of ``return_prefixes``."""
    r = return_prefixes(nodes).select("repo", "path", "def_pre", "lines", F.explode("returns").alias("r"))
    return r.select("repo", "path", "def_pre", F.col("r.line_no").alias("line_no"), F.expr("slice(lines, 1, r.n)").alias("path_lines"))


def function_callers(nodes: DataFrame) -> DataFrame:
    """L30 entry points: function-level call edges -- for each call site, the
    innermost def that makes it and the callee name.  Joined on name with a
    function table this lists which functions call which."""
    call = (F.col("kind").isin("Name", "Attribute") & (F.col("field") == "func") & (parent().kind == "Call") &
            F.col("scope").isNotNull())
    return (nodes.filter(call)
                 .select("repo", "path", F.col("scope").alias("caller_pre"), F.col("name").alias("callee"))
                 .distinct())


def function_caller_edges(nodes: DataFrame) -> DataFrame:
    """L30 over the repo: for every function that calls one of the repo's
    functions by name, the callee's name and how many functions bear it.  Rows
    stay keyed by the caller; a hot name is met by one pre-aggregated row, so
    its callers and its bearers are never paired."""
    defs = nodes.filter(F.col("kind").isin(DEF_KINDS))
    bearers = defs.groupBy("repo", F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n_targets"))
    names = defs.select("repo", "path", F.col("pre").alias("caller_pre"), F.col("name").alias("function"))
    return (function_callers(nodes).join(bearers, ["repo", "callee"])
            .join(names, ["repo", "path", "caller_pre"])
            .select("repo", "path", "caller_pre", "function", "callee", "n_targets"))
