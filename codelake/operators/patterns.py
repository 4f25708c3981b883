"""Design-pattern flags per file (L9-L22).  Output: ``repo, path, pattern``.

Python rules look at direct children of class bodies in ``py_nodes``; the
other languages use substring predicates over the whole file text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.operators import pyfacts as P

PY_PATTERN_ORDER = ["Singleton", "Factory", "Observer", "Strategy", "Decorator"]


def _in_class_body(i: int = 1):
    return P.parent(i).kind == "ClassDef"


def python_patterns(nodes: DataFrame) -> DataFrame:
    """L9-L13 in one pass over the relevant node rows, then one group-by per file.

    * Singleton: class-level annotated ``_instance``, or ``__init__``
      decorated with the plain name ``private``;
    * Factory: a method whose name contains ``create``/``factory``;
    * Observer: an annotated class attribute containing ``observer``, or a
      method containing ``notify``;
    * Strategy: a method containing ``strategy``/``algorithm``;
    * Decorator: a class name containing ``decorator``/``wrapper``, or a
      plain-name base containing ``component``/``interface``.
    """
    kind, name, low = F.col("kind"), F.col("name"), F.lower(F.col("name"))
    ann_target = (kind == "Name") & (F.col("field") == "target") & (P.parent().kind == "AnnAssign") & _in_class_body(2)
    method = kind.isin(P.DEF_KINDS) & _in_class_body(1) & (F.col("field") == "body")
    private_init = ((kind == "Name") & (F.col("field") == "decorator_list") & (name == "private") &
                    P.parent().kind.isin(P.DEF_KINDS) & (P.parent()["name"] == "__init__") & _in_class_body(2))
    cls = kind == "ClassDef"
    base = (kind == "Name") & (F.col("field") == "bases") & _in_class_body(1)
    flags = (nodes.filter(ann_target | method | private_init | cls | base)
                  .groupBy("repo", "path")
                  .agg(F.bool_or((ann_target & (name == "_instance")) | private_init).alias("Singleton"),
                       F.bool_or(method & (low.contains("create") | low.contains("factory"))).alias("Factory"),
                       F.bool_or((ann_target & low.contains("observer")) |
                                 (method & low.contains("notify"))).alias("Observer"),
                       F.bool_or(method & (low.contains("strategy") | low.contains("algorithm"))).alias("Strategy"),
                       F.bool_or((cls & (low.contains("decorator") | low.contains("wrapper"))) |
                                 (base & (low.contains("component") | low.contains("interface"))))
                       .alias("Decorator")))
    return _unpivot(flags, PY_PATTERN_ORDER)


def _unpivot(flags: DataFrame, labels) -> DataFrame:
    arr = F.array(*[F.when(F.col(f"`{lab}`"), F.struct(F.lit(i).alias("ord"), F.lit(lab).alias("pattern")))
                    for i, lab in enumerate(labels)])
    return (flags.select("repo", "path", F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("p"))
                 .select("repo", "path", F.col("p").pattern.alias("pattern"), F.col("p").ord.alias("ord")))


# --- FIXED VALUES: text pattern rules per language family: (label, predicate)
def _has(s):
    return F.col("content").contains(s)


def text_patterns(files: DataFrame) -> DataFrame:
    """Substring rules over whole files of JS/TS, C++/C# and Svelte."""
    lang = F.col("language")
    js = lang.isin("javascript", "typescript")
    cc = lang.isin("c++", "c#")
    sv = lang == "svelte"
    rules = [
        ("Class-based OOP", js & _has("class") & (_has("constructor") | _has("prototype"))),
        ("Generator Pattern", js & (_has("function*") | _has("yield"))),
        ("Async/Await Pattern", js & _has("async") & _has("await")),
        ("Interface Segregation", cc & _has("interface")),
        ("Template Method", cc & (_has("virtual") | _has("override"))),
        ("Singleton", cc & _has("private static") & (_has("instance") | _has("Instance"))),
        ("Module Context Pattern", sv & _has('<script context="module">')),
        ("Props Pattern", sv & _has("export let")),
        ("Reactive Statement Pattern", sv & _has("$:")),
    ]
    flags = files.filter(js | cc | sv).select("repo", "path", *[r.alias(lab) for lab, r in rules])
    return _unpivot(flags, [lab for lab, _ in rules])


def found_patterns(patterns: DataFrame) -> DataFrame:
    """Distinct pattern labels per repo (I8)."""
    return patterns.select("repo", "pattern").distinct()


def missing_patterns(repos: DataFrame, patterns: DataFrame) -> DataFrame:
    """The five common patterns not found in a repo (K1): a 5-row literal
    dimension crossed with the repo list, anti-joined with what was found."""
    from codelake.functions.constants import COMMON_PATTERNS
    dim = repos.select("repo").distinct().select(
        "repo", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(p).alias("pattern"))
                                    for i, p in enumerate(COMMON_PATTERNS)])).alias("p"))
    dim = dim.select("repo", F.col("p").pattern.alias("pattern"), F.col("p").ord.alias("ord"))
    return dim.join(found_patterns(patterns), ["repo", "pattern"], "left_anti")
