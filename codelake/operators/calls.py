"""Call edges between definitions (L30): who calls whom, through the symbols of
each file.

A call is looked up as the language would: a plain name among the defs nested
around the caller, those of its module, and its imported names; ``module.f()``
through the file's module aliases; ``self.f()`` in the caller's class.  Imported
modules become files by the candidate paths of H1.  What none of these finds
is matched by bare name against the repo and marked as such, with the number of
definitions that bear the name.

Every join is an equi-join on the file and a name.  A definition that a third
of the corpus calls is one row of the definition side, so its callers are never
paired with one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators import graph as G
from codelake.operators.pyfacts import DEF_KINDS, parent, py_imports

FILE = ["repo", "path"]


def definitions(nodes: DataFrame) -> DataFrame:
    """Functions and methods: (repo, path, def_pre, name, line, around: the
    defs that enclose it, owner_pre: its class, top: of the module itself)."""
    in_class = (parent().kind == "ClassDef") & (F.col("field") == "body")
    return nodes.filter(F.col("kind").isin(DEF_KINDS)).select(
        *FILE, F.col("pre").alias("def_pre"), "name", F.col("lineno").alias("line"), F.transform("defs", lambda d: d["pre"]).alias("around"),
        F.when(in_class, parent().pre).alias("owner_pre"), (F.col("n_scopes") == 0).alias("top"))


def call_sites(nodes: DataFrame) -> DataFrame:
    """Distinct calls of a def's body: (repo, path, caller_pre, around, base,
    callee), base being the name or dotted pair that an attribute is called
    on ('' for a plain name, null for any other expression)."""
    p1, p2, p3 = parent(1), parent(2), parent(3)
    is_call = F.col("kind").isin("Name", "Attribute") & (F.col("field") == "func") & (p1.kind == "Call") & F.col("scope").isNotNull()
    on_name = (F.col("kind") == "Name") & (F.col("field") == "value") & (p1.kind == "Attribute")
    # of x.y.f(): x is two attributes below the called one
    dotted = on_name & (p2.kind == "Attribute") & (p3.kind == "Call")
    key = F.when(is_call, F.col("pre")).when(dotted, p2.pre).otherwise(p1.pre)
    call = F.struct(F.col("scope").alias("caller_pre"), F.col("name").alias("callee"), F.transform("defs", lambda d: d["pre"]).alias("around"),
                    (F.col("kind") == "Name").alias("plain"))
    base = F.when(dotted, F.concat(F.col("name"), F.lit("."), p1["name"])).otherwise(F.col("name"))
    g = (nodes.filter(is_call | on_name).groupBy(*FILE, key.alias("pre"))
         .agg(F.first(F.when(is_call, call), ignorenulls=True).alias("c"), F.max(F.when(on_name, base)).alias("base")).filter("c is not null"))
    return g.select(*FILE, "c.caller_pre", "c.around", F.when(F.col("c.plain"), F.lit("")).otherwise(F.col("base")).alias("base"), "c.callee").distinct()


def symbols(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """What the imports of each file bind: (repo, path, symbol, dst, member).
    ``member`` is null where the symbol is the module that file ``dst`` is."""
    imports = py_imports(nodes)
    paths = G.py_module_paths(imports)
    i = imports.join(paths, ["repo", "path", "stmt_pre", "ord"]).withColumn("imp", F.struct("stmt_pre", "ord"))
    i = i.withColumn("symbol", F.coalesce("alias", "name", "module"))
    found = G.resolve_first(i, files, G.PY_SUFFIXES)
    member = F.concat_ws("/", F.when(F.col("module_path") != "", F.col("module_path")), F.col("name"))
    inside = G.resolve_first(i.filter("is_from_import").withColumn("module_path", member), files, G.PY_SUFFIXES)
    keyed = i.select("repo", F.col("path").alias("src"), "imp", "symbol", F.when(F.col("is_from_import"), F.col("name")).alias("member"))
    whole = keyed.join(found, ["repo", "src", "imp"])
    module = keyed.join(inside, ["repo", "src", "imp"]).withColumn("member", F.lit(None).cast("string"))
    last = F.max_by(F.struct("dst", "member"), "imp")   # a later import of the name replaces an earlier one
    both = whole.unionByName(module)
    return (both.groupBy("repo", F.col("src").alias("path"), "symbol", F.col("member").isNull().alias("is_module")).agg(last.alias("m"))
            .select("repo", "path", "symbol", "is_module", "m.dst", "m.member"))


def call_edges(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, caller_pre, caller, base, callee, callee_path, callee_pre,
    callee_line, how, n_targets): one row for every distinct call of a def that
    the repo can answer.  ``how`` is local, import, module, method, or name,
    where ``n_targets`` definitions bear the bare name and none is chosen."""
    defs = definitions(nodes)
    me = defs.select(*FILE, F.col("def_pre").alias("caller_pre"), F.col("name").alias("caller"), F.col("owner_pre").alias("my_class"))
    calls = call_sites(nodes).join(me, [*FILE, "caller_pre"])
    # a later definition of the same name replaces an earlier one
    key = [*FILE, "caller_pre", "base", "callee"]
    target = F.struct(F.col("def_pre").alias("pre"), F.col("line"))
    tops = defs.filter("top").groupBy(*FILE, "name").agg(F.max(target).alias("t"))
    # nested: the defs directly inside one that is around the call
    nested = (defs.filter(F.size("around") > 0).filter("owner_pre is null")
              .groupBy(*FILE, "name", F.element_at("around", -1).alias("outer")).agg(F.max(target).alias("t")))
    plain = calls.filter("base = ''")
    by_nest = (plain.select(*key, F.explode("around").alias("outer")).join(nested.withColumnRenamed("name", "callee"), [*FILE, "callee", "outer"])
               .groupBy(*key).agg(F.max_by("t", "outer").alias("nest")))
    syms = symbols(nodes, files)
    goal = tops.select("repo", F.col("path").alias("dst"), F.col("name").alias("goal"), F.col("t").alias("far"))
    # plain names are members of a module, bases are modules
    asked = F.col("base") == ""
    wanted = calls.filter("base is not null").withColumn("symbol", F.when(asked, F.col("callee")).otherwise(F.col("base"))).withColumn("is_module", ~asked)
    far = (wanted.join(syms, [*FILE, "symbol", "is_module"]).withColumn("goal", F.coalesce("member", "callee")).join(goal, ["repo", "dst", "goal"])
           .select(*key, "dst", "far"))
    own = defs.filter("owner_pre is not null").groupBy(*FILE, F.col("owner_pre").alias("my_class"), F.col("name").alias("callee")).agg(F.max(target).alias("mine"))
    bearers = defs.groupBy("repo", F.col("name").alias("callee")).agg(F.count(F.lit(1)).alias("n_targets"))
    out = (calls.join(by_nest, key, "left").join(tops.select(*FILE, F.col("name").alias("callee"), F.col("t").alias("near")), [*FILE, "callee"], "left")
           .join(far, key, "left").join(own, [*FILE, "my_class", "callee"], "left").join(bearers, ["repo", "callee"], "left"))
    base = F.col("base")
    local = F.when(base == "", F.coalesce("nest", "near"))
    method = F.when(base.isin("self", "cls"), F.col("mine"))
    how = (F.when(local.isNotNull(), "local").when(method.isNotNull(), "method").when(F.col("far").isNotNull(), F.when(base == "", "import").otherwise("module"))
           .when(F.col("n_targets") > 0, "name"))
    hit = F.coalesce(local, method, F.col("far"))
    return (out.withColumn("how", how).filter("how is not null").withColumn("hit", hit)
            .select(*FILE, "caller_pre", "caller", "base", "callee", F.when(F.col("how").isin("local", "method"), F.col("path")).when(
                F.col("how") != "name", F.col("dst")).alias("callee_path"), F.col("hit.pre").alias("callee_pre"), F.col("hit.line").alias("callee_line"),
                "how", F.when(F.col("how") == "name", F.col("n_targets")).alias("n_targets")))
