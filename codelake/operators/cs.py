"""C# line extraction (F1-F9) -- regex over lines plus block spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import text as T
from codelake.operators import blocks as BL
from codelake.operators.blocks import FILE

# --- FIXED VALUES: C# line patterns (Java regex dialect; '[' escaped inside classes)
RX_USING_ALIAS = r"^using\s+(\w+)\s*=\s*([\w.]+)\s*;"
RX_USING = r"^using\s+([\w.]+)\s*;"
RX_NAMESPACE = r"^namespace\s+([\w.]+)\s*\{?"
RX_IS_TYPE = r"^(?:public |internal |private |protected |abstract |sealed )*(?:class|interface|struct|enum|record)\s+\w+"
RX_TYPE = r"^(?:public |internal |private |protected |abstract |sealed )*(\w+)\s+(\w+)(?:\s*:\s*(.+))?"
RX_IS_METHOD = r"^(?:public |private |protected |internal |static |virtual |override |abstract )*[\w<>\[\],\s]+\s+\w+\s*\("
RX_METHOD = r"^(?:[\w\s]+\s+)?([\w<>\[\],\s]+)\s+(\w+)\s*\((.*?)\)"
RX_IS_MEMBER = r"^(?:public |private |protected |internal |static |readonly |const )*[\w<>\[\],\s]+\s+\w+\s*[{;=]"
RX_MEMBER = r"^(?:[\w\s]+\s+)?([\w<>\[\],\s]+)\s+(\w+)\s*(?:=\s*(.+))?[;{]"
RX_ATTRIBUTE_LINE = r"^\[.*\]$"
RX_ATTRIBUTES = r"^\[([\w,\s\(\)]+)\]"
RX_MODIFIER = r"^(?:ref|out|in)\s+"
# statement keywords that the method and member patterns would otherwise take
# as a type (ledger Q11)
STATEMENT_WORDS = ["return", "throw", "await", "yield", "new", "else", "if", "for", "foreach", "while", "do",
                   "switch", "case", "lock", "goto", "catch", "try", "finally", "var", "fixed", "checked", "unchecked",
                   "break", "continue", "default", "base", "this"]


def cs_scan(lines: DataFrame) -> DataFrame:
    """The C# definitions of a corpus with spans, scopes and attributes.
    Statements run over lines, so a signature may too; namespaces and types are
    scopes, whose members and methods are reported with their owner (ledger
    Q12); nothing inside a method's or a property's body is a definition."""
    s = F.col("text")
    x = lines.filter(F.col("language") == "c#")
    ckind = (F.when(s.startswith("using "), F.lit("using"))
              .when(s.startswith("namespace "), F.when(s.rlike(RX_NAMESPACE), F.lit("namespace")))
              .when(s.rlike(RX_IS_TYPE), F.lit("type"))
              .when(F.regexp_extract(s, r"^(\w+)", 1).isin(STATEMENT_WORDS), F.lit(None))
              .when(s.rlike(RX_IS_METHOD) & s.rlike(RX_METHOD), F.lit("method"))
              .when(s.rlike(RX_IS_MEMBER) & s.rlike(RX_MEMBER), F.lit("member")))
    name = F.when(F.col("ckind") == "namespace", F.regexp_extract(s, RX_NAMESPACE, 1)).when(F.col("ckind") == "type", F.regexp_extract(s, RX_TYPE, 2))
    scope = F.when(name.isNotNull(), F.struct(F.col("ckind").alias("kind"), name.alias("name")))
    d = BL.scoped(BL.statements(x, s.rlike(RX_ATTRIBUTE_LINE)), ckind, scope)
    # a file-scoped namespace (`namespace X;`) covers the rest of the file
    whole = F.when((F.col("ckind") == "namespace") & s.endswith(";"), F.regexp_extract(s, RX_NAMESPACE, 1))
    sofar = Window.partitionBy(*FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_whole", F.last(whole, ignorenulls=True).over(sofar))
    names = F.flatten(F.transform("prefixes", lambda p: F.transform(F.filter(
        F.split(F.regexp_extract(p, RX_ATTRIBUTES, 1), ","), lambda a: F.trim(a) != ""), lambda a: F.trim(a))))
    return d.select(*FILE, "ckind", "line_no", F.col("text").alias("stripped"), F.when(whole.isNotNull(), F.col("n_lines")).otherwise(F.col("line_end")).alias("line_end"),
                    F.concat_ws(".", "_whole", F.when(BL.scope_names("namespace", ".") != "", BL.scope_names("namespace", "."))).alias("namespace"),
                    BL.scope_names("type", ".").alias("owner"), names.alias("attributes"))


def _with_attrs(prefix):
    a = F.coalesce(F.col("attributes"), F.array().cast("array<string>"))
    return F.when(F.size(a) > 0, F.concat(F.lit(prefix), F.array_join(a, ", ")))


def cs_usings(acc: DataFrame) -> DataFrame:
    """``using A.B;`` and ``using X = A.B;`` (alias)."""
    u = acc.filter(F.col("ckind") == "using")
    s = F.col("stripped")
    alias = s.contains("=")
    mod = F.when(alias, F.regexp_extract(s, RX_USING_ALIAS, 2)).otherwise(F.regexp_extract(s, RX_USING, 1))
    return (u.select(*FILE, "line_no", mod.alias("module"),
                     F.when(alias, F.regexp_extract(s, RX_USING_ALIAS, 1)).alias("alias"))
             .filter(F.col("module") != ""))


def cs_raw_dependencies(lines: DataFrame) -> DataFrame:
    """every ``using`` line with neither ``static`` nor ``=``, text after
    ``using`` with the trailing ``;`` removed (all lines, no consumption)."""
    s = F.col("stripped")
    u = lines.filter((F.col("language") == "c#") & s.startswith("using ") & ~s.contains("static") & ~s.contains("="))
    return u.select(*FILE, "line_no",
                    T.py_rstrip_chars(T.py_strip(F.regexp_replace(s, "using", "")), ";").alias("dependency"))


def cs_types(acc: DataFrame) -> DataFrame:
    """class/interface/struct/enum/record with bases (cut at ``{``),
    attributes, namespace-qualified name and span."""
    t = acc.filter(F.col("ckind") == "type")
    s = F.col("stripped")
    kind = F.regexp_extract(s, RX_TYPE, 1)
    bases = F.filter(F.transform(F.split(F.split_part(F.regexp_extract(s, RX_TYPE, 3), F.lit("{"), F.lit(1)), ","),
                                 lambda b: T.py_strip(b)), lambda b: b != "")
    name = F.regexp_extract(s, RX_TYPE, 2)
    qual = F.concat_ws(".", F.when(F.col("namespace") != "", F.col("namespace")),
                       F.when(F.col("owner") != "", F.col("owner")), name)
    cap = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 100))
    return t.select(*FILE, qual.alias("name"), bases.alias("base_classes"),
                    F.concat(cap, F.coalesce(_with_attrs(" with attributes: "), F.lit(""))).alias("docstring"),
                    F.col("line_no").alias("line_start"), "line_end")


def cs_methods(acc: DataFrame) -> DataFrame:
    """Return type, name, parameters (ref/out/in dropped; type + name),
    attributes, owner type and span."""
    m = acc.filter(F.col("ckind") == "method")
    s = F.col("stripped")
    params = F.filter(F.transform(F.split(F.regexp_extract(s, RX_METHOD, 3), ","),
                                  lambda p: F.regexp_replace(T.py_strip(p), RX_MODIFIER, "")),
                      lambda p: F.size(F.split(p, r"\s+")) >= 2)

    def one(p):
        toks = F.split(p, r"\s+")
        return F.struct(F.element_at(toks, -1).alias("name"),
                        F.array_join(F.slice(toks, 1, F.size(toks) - 1), " ").alias("type"))
    return m.select(*FILE, F.regexp_extract(s, RX_METHOD, 2).alias("name"),
                    F.when(F.col("owner") != "", F.col("owner")).alias("owner_class"),
                    F.transform(params, one).alias("args"), F.regexp_extract(s, RX_METHOD, 1).alias("returns"),
                    _with_attrs("Method with attributes: ").alias("docstring"),
                    F.col("line_no").alias("line_start"), "line_end")


def cs_members(acc: DataFrame) -> DataFrame:
    """properties and fields with optional initialiser and attributes."""
    m = acc.filter(F.col("ckind") == "member")
    s = F.col("stripped")
    val = F.regexp_extract(s, RX_MEMBER, 3)
    return m.select(*FILE, F.regexp_extract(s, RX_MEMBER, 2).alias("name"),
                    F.regexp_extract(s, RX_MEMBER, 1).alias("type_hint"),
                    F.when(val != "", T.py_rstrip_chars(val, ";")).alias("value"),
                    _with_attrs("Member with attributes: ").alias("docstring"),
                    F.when(F.col("owner") != "", F.lit("class")).otherwise(F.lit("namespace")).alias("scope"),
                    F.when(F.col("owner") != "", F.col("owner")).alias("owner_class"),
                    F.col("line_no").alias("line_start"))
