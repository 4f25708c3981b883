"""C / C++ line extraction (E1-E8) -- regex over lines plus block spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.functions import text as T
from codelake.operators import blocks as BL
from codelake.operators.blocks import FILE

# --- FIXED VALUES: C++ line patterns (Java regex dialect)
RX_NAMESPACE = r"^namespace\s+(\w+)\s*\{?"
RX_TEMPLATE = r"^template\s*<(.+)>"
RX_TEMPLATE_LINE = r"^template\s*<.*>$"
RX_TEMPLATE_HEAD = r"^(template\s*<[^{};()]*>)\s*((?:class|struct)\s)"
RX_LINKAGE = r'^extern\s*"[^"]*"\s*\{'
RX_CLASS = r"^(class|struct)\s+(\w+)(?:\s*:\s*(.+))?"
RX_FUNCTION = r"^(?:virtual\s+)?(?:static\s+)?([\w:~<>]+)\s+([\w:~]+)\s*\((.*?)\)(?:\s*const)?(?:\s*=\s*0)?"
RX_VARIABLE = r"^(?:static\s+)?(?:const\s+)?([\w:]+)\s+(\w+)(?:\s*=\s*(.+))?;"
RX_ACCESS = r"(public|private|protected)\s+"
# control keywords that the function pattern would otherwise take as a
# return type (ledger Q11)
CONTROL_WORDS = ["return", "else", "if", "while", "for", "switch", "case", "do", "goto", "throw", "delete", "new"]


def cpp_scan(lines: DataFrame) -> DataFrame:
    """The C/C++ definitions of a corpus with spans and namespaces, one row
    each, ``ckind`` in include / namespace / class / function / variable.
    Statements run over lines, so a signature may too; namespaces (and language
    linkage blocks) are scopes, and nothing inside another block is reported."""
    s = F.col("text")
    x = lines.filter(F.col("language").isin(K.CPP_FAMILY))
    head = F.get("prefixes", F.size("prefixes") - 1)
    is_cls_line = s.rlike(RX_CLASS)
    ckind = (F.when(is_cls_line & (F.size("prefixes") > 0), F.lit("class"))
              .when(s.startswith("#include"), F.lit("include"))
              .when(s.startswith("namespace"), F.when(s.rlike(RX_NAMESPACE), F.lit("namespace")))
              .when(s.startswith("template"), F.lit(None))
              .when(s.startswith("class ") | s.startswith("struct "), F.when(is_cls_line, F.lit("class")))
              .when(s.rlike(RX_FUNCTION) & ~F.regexp_extract(s, RX_FUNCTION, 1).isin(CONTROL_WORDS),
                    F.lit("function"))
              .when(s.rlike(RX_VARIABLE), F.lit("variable")))
    linkage = s.rlike(RX_LINKAGE)
    scope = F.when((F.col("ckind") == "namespace") | linkage, F.struct(
        F.lit("namespace").alias("kind"), F.when(~linkage, F.regexp_extract(s, RX_NAMESPACE, 1)).alias("name")))
    st = BL.statements(x, s.rlike(RX_TEMPLATE_LINE))
    # a head that runs over lines, or shares the line of its class, is in the text
    inline = F.regexp_extract(s, RX_TEMPLATE_HEAD, 1)
    st = st.withColumn("prefixes", F.when(inline != "", F.array(inline)).otherwise(F.col("prefixes")))
    d = BL.scoped(st.withColumn("text", F.regexp_replace(s, RX_TEMPLATE_HEAD, "$2")), ckind, scope)
    # includes and variables are one-line facts
    end = F.when(F.col("ckind").isin("include", "variable"), F.col("line_no")).otherwise(F.col("line_end"))
    return d.select(*FILE, "ckind", "line_no", F.col("text").alias("stripped"), end.alias("line_end"), BL.scope_names("namespace", "::").alias("namespace"),
                    F.when(F.col("ckind") == "class", F.regexp_extract(head, RX_TEMPLATE, 1)).alias("template"))


def _qualify(name):
    return F.when(F.col("namespace") != "", F.concat(F.col("namespace"), F.lit("::"), name)).otherwise(name)


def cpp_includes(acc: DataFrame) -> DataFrame:
    """Local ``#include "x"`` (system includes have no quotes)."""
    i = acc.filter((F.col("ckind") == "include") & F.col("stripped").contains('"'))
    return i.select(*FILE, "line_no", F.split_part(F.col("stripped"), F.lit('"'), F.lit(2)).alias("module"))


def cpp_namespaces(acc: DataFrame) -> DataFrame:
    """Namespaces with their block span and the enclosing namespaces."""
    n = acc.filter(F.col("ckind") == "namespace")
    return n.select(*FILE, _qualify(F.regexp_extract("stripped", RX_NAMESPACE, 1)).alias("name"),
                    F.col("line_no").alias("line_start"), "line_end")


def cpp_classes(acc: DataFrame) -> DataFrame:
    """class/struct with template parameters, bases (access specifiers
    removed, base list cut at ``{``, ledger Q22), qualified name and span."""
    c = acc.filter(F.col("ckind") == "class")
    s = F.col("stripped")
    kind = F.regexp_extract(s, RX_CLASS, 1)
    bases_txt = F.split_part(F.regexp_extract(s, RX_CLASS, 3), F.lit("{"), F.lit(1))
    bases = F.filter(F.transform(F.split(bases_txt, ","), lambda b: F.regexp_replace(T.py_strip(b), RX_ACCESS, "")),
                     lambda b: b != "")
    tparams = F.array_join(F.transform(F.split("template", ","), lambda p: T.py_strip(p)), ",")
    name = _qualify(F.regexp_extract(s, RX_CLASS, 2))
    name = F.when(F.col("template").isNotNull(), F.concat(name, F.lit("<"), tparams, F.lit(">"))).otherwise(name)
    cap = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 100))
    return c.select(*FILE, name.alias("name"), bases.alias("base_classes"),
                    F.when(F.col("template").isNotNull(), F.concat(cap, F.lit(" Template"))).otherwise(cap)
                    .alias("docstring"),
                    F.col("line_no").alias("line_start"), "line_end")


def cpp_functions(acc: DataFrame) -> DataFrame:
    """Signature, return type, parameters (last token = name without
    ``&*``, the rest = type), qualified name and span."""
    f = acc.filter(F.col("ckind") == "function")
    s = F.col("stripped")
    params = F.filter(F.transform(F.split(F.regexp_extract(s, RX_FUNCTION, 3), ","), lambda p: T.py_strip(p)),
                      lambda p: p != "")

    def one(p):
        toks = F.split(p, r"\s+")
        return F.struct(T.py_strip_chars(F.element_at(toks, -1), "&*").alias("name"),
                        F.array_join(F.slice(toks, 1, F.size(toks) - 1), " ").alias("type"))
    return f.select(*FILE, _qualify(F.regexp_extract(s, RX_FUNCTION, 2)).alias("name"),
                    F.transform(params, one).alias("args"), F.regexp_extract(s, RX_FUNCTION, 1).alias("returns"),
                    F.col("line_no").alias("line_start"), "line_end")


def cpp_variables(acc: DataFrame) -> DataFrame:
    """Namespace-level / global declarations; the declared type is kept
    as ``type_hint`` (ledger Q8)."""
    v = acc.filter(F.col("ckind") == "variable")
    s = F.col("stripped")
    val = F.regexp_extract(s, RX_VARIABLE, 3)
    return v.select(*FILE, F.regexp_extract(s, RX_VARIABLE, 2).alias("name"),
                    F.regexp_extract(s, RX_VARIABLE, 1).alias("type_hint"),
                    F.when(val != "", val).alias("value"),
                    F.when(F.col("namespace") != "", F.lit("namespace")).otherwise(F.lit("global")).alias("scope"),
                    F.col("line_no").alias("line_start"))
