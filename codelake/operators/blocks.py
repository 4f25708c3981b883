"""Statements, blocks and scopes of the brace languages.

A file's lines become logical statements, these and their braces one ordered
stream, and the stream carries the stack of open blocks.  Every step is a
window, or a group of one, keyed by the file, so after one hash partitioning by
file there is no further exchange but that of the few staged scope rows, and
the work is linear in the file: no row is ever paired with others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelake.functions import text as T
from codelake.session import stage_parquet

FILE = ["repo", "path"]

# --- FIXED VALUES: lexical patterns (Java regex dialect)
RX_STRING_OR_COMMENT = r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])+')|//.*$|/\*.*?\*/"""
RX_STRING = r"""'(?:\\.|[^'\\])+'|"(?:\\.|[^"\\])*\""""
RX_COMMENT_LINE = r"^(/\*[^{};]*|\*(/.*|\s.*)?)$"
RX_LABEL = r"^(public|private|protected|default|case\b[^{};]*|\w+)\s*:$"
RX_MACRO_LINE = r"^[A-Z][A-Z0-9_]*(\s*\([^{};]*\))?$"


def by_file(lines: DataFrame) -> DataFrame:
    """Hash-partition a line table by file once: the one exchange of an
    extractor, sized and split by AQE and reused by all its branches."""
    return lines.repartition(*FILE)


def statements(lines: DataFrame, prefix: Column) -> DataFrame:
    """Logical statements: ``(repo, path, stmt, line_no, last, n_lines, text,
    prefixes, braces)``.

    A statement goes on from line to line until, outside of parentheses, a line
    ends in ``;``, ``{``, ``}`` or a label's colon; preprocessor lines and lines
    of a macro alone are statements of their own.  Lines for which ``prefix``
    (over ``text``) holds stand before a statement (attributes, template
    heads): if they are directly above it they are its ``prefixes``, not part
    of its text.  Comments are left out, and braces inside strings are none.
    ``braces`` are the statement's braces and ``;``s, as (line, place, token).
    """
    text = T.py_strip(F.regexp_replace("stripped", RX_STRING_OR_COMMENT, "$1"))
    x = (by_file(lines.select(*FILE, "line_no", "n_lines", text.alias("text")).filter((F.col("text") != "") & ~F.col("text").rlike(RX_COMMENT_LINE)))
         .withColumn("code", F.regexp_replace("text", RX_STRING, "")).withColumn("pre", prefix))
    order = Window.partitionBy(*FILE).orderBy("line_no")
    delta = F.regexp_count("code", F.lit(r"\(")) - F.regexp_count("code", F.lit(r"\)"))
    x = x.withColumn("depth", F.sum(delta).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    flat = F.col("depth") <= 0
    # a macro line or a preprocessor line ends what stands before it too
    alone = F.col("text").startswith("#") | (flat & (delta == 0) & F.col("text").rlike(RX_MACRO_LINE))
    closed = alone | (flat & (F.col("code").rlike("[;{}]$") | F.col("code").rlike(RX_LABEL)))
    x = x.select("*", alone.alias("alone"), closed.alias("closed"))
    before = F.lag(F.struct("closed", "pre", "line_no")).over(order)
    apart = before["pre"] & (F.col("line_no") - before["line_no"] > 1)
    begins = before.isNull() | before["closed"] | F.col("alone") | apart
    x = x.withColumn("begins", begins)
    x = x.withColumnRenamed("line_no", "line").withColumnRenamed("text", "t")
    order = Window.partitionBy(*FILE).orderBy("line")
    x = x.withColumn("stmt", F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = ~F.col("pre")
    in_order = lambda c, f: F.transform(F.array_sort(F.collect_list(c)), f)
    tokens = F.transform(F.regexp_extract_all("code", F.lit("[{};]"), 0), lambda t, i: F.struct(
        F.col("line"), i.alias("at"), t.alias("tok")))
    return (x.groupBy(*FILE, "stmt")
            .agg(F.min(F.when(own, F.col("line"))).alias("line_no"), F.max("line").alias("last"), F.max("n_lines").alias("n_lines"),
                 F.array_join(in_order(F.when(own, F.struct("line", "t")), lambda s: s["t"]), " ").alias("text"),
                 in_order(F.when(~own, F.struct("line", "t")), lambda s: s["t"]).alias("prefixes"),
                 F.array_sort(F.flatten(F.collect_list(tokens))).alias("braces"))
            .filter(F.col("line_no").isNotNull()))


def match_braces(events: DataFrame) -> DataFrame:
    """``depth`` and ``lvl`` of the rows of a stream (``stmt``, ``pos``,
    ``tok``, ``line``, ``opens``, ``n_lines``), and ``end_line`` of what opens a
    block.

    Running depth = cumulative +1/-1 in text order; an opening brace at
    depth d and its closing brace share level d, so the partner of a ``{`` is
    the next brace of its level.  A head (``opens``) stands before its own
    ``{`` on the same level.  An unterminated block ends at the file's last
    line (ledger Q11).
    """
    order = Window.partitionBy(*FILE).orderBy("stmt", "pos")
    step = F.when(F.col("tok") == "{", 1).when(F.col("tok") == "}", -1).otherwise(0)
    t = events.withColumn("depth", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    t = t.withColumn("lvl", F.when(F.col("tok") == "{", F.col("depth")).when((F.col("tok") == "}") | F.col("opens"), F.col("depth") + 1))
    level = Window.partitionBy(*FILE, "lvl").orderBy("stmt", "pos")
    nxt = F.struct("tok", "line")
    ahead = F.when(F.col("opens"), F.lead(nxt, 2).over(level)).otherwise(F.lead(nxt).over(level))
    end = F.when(ahead["tok"] == "}", ahead["line"]).otherwise(F.col("n_lines"))
    return t.withColumn("end_line", F.when((F.col("tok") == "{") | F.col("opens"), end))


def brace_tokens(lines: DataFrame) -> DataFrame:
    """J3 over raw lines: every ``{``/``}`` with its matching partner."""
    t = lines.select(*FILE, "line_no", "n_lines", F.posexplode(F.regexp_extract_all("line", F.lit(r"[{}]"), 0)).alias("pos", "tok"))
    t = t.withColumn("stmt", F.col("line_no")).withColumn("line", F.col("line_no")).withColumn("opens", F.lit(False))
    return match_braces(t).drop("stmt", "line", "opens", "n_lines")


def scoped(stmts: DataFrame, kind: Column, scope: Column) -> DataFrame:
    """Definitions with spans and scopes: the statements that have a ``kind``
    and stand directly in the file or in scopes (E8: never inside a body), with
    ``ckind``, ``line_end`` and ``scopes``, the open scopes as (kind, name)
    from the outside in (J5).

    ``scope`` is a struct (kind, name) for statements whose block is a scope,
    null for others; one without a name is a scope that names nothing.  The
    block of a definition is the one that its first ``{`` opens, unless a ``;``
    stands before that.
    """
    first = F.get("braces", F.lit(0))["tok"]
    s = stmts.withColumn("ckind", kind).withColumn("scope", scope).withColumn("is_open", F.coalesce(first == "{", F.lit(False)))
    s = s.withColumn("braces", F.filter("braces", lambda b: b["tok"] != ";"))
    s = s.filter(F.col("ckind").isNotNull() | (F.size("braces") > 0))
    blank = F.lit(None).cast("string")
    head = F.struct(F.col("line_no").alias("line"), F.lit(-1).alias("at"), blank.alias("tok"))
    tail = F.transform("braces", lambda b: F.struct(b["line"].alias("line"), b["at"].alias("at"), b["tok"].alias("tok")))
    s = s.withColumn("events", F.when(F.col("ckind").isNotNull(), F.concat(F.array(head), tail)).otherwise(F.concat(F.array(head.cast("struct<line:int,at:int,tok:string>")), tail)))
    keep = ["line_no", "last", "n_lines", "text", "prefixes", "ckind"]
    e = s.select(*FILE, "stmt", "n_lines", "scope", "is_open", F.struct(*keep).alias("def"), F.posexplode("events").alias("pos", "e"))
    at_head = F.col("pos") == 0
    e = e.select(*FILE, "stmt", "n_lines", "pos", F.col("e.tok").alias("tok"), F.col("e.line").alias("line"), (at_head & F.col("is_open")).alias("opens"),
                 F.when(at_head & F.col("def.ckind").isNotNull(), F.col("def")).alias("def"),
                 F.when(F.col("e.tok") == "{", F.struct(F.col("scope").isNotNull().alias("is_scope"), F.col("scope.kind").alias("kind"),
                                                        F.when(F.col("pos") == 1, F.col("scope.name")).alias("name"))).alias("block"))
    t = match_braces(e).filter(F.col("def").isNotNull() | F.col("block").isNotNull())
    t = stage_parquet(t.select(*FILE, "stmt", "pos", "depth", "lvl", "opens", "end_line", "def", "block"), "blocks")
    # the stack: for every level that any scope reaches, the last block opened there
    deepest = t.filter("block.is_scope").agg(F.coalesce(F.max("lvl"), F.lit(0))).first()[0]
    t = t.filter(F.col("def").isNotNull() | (F.col("lvl") <= deepest))
    sofar = Window.partitionBy(*FILE).orderBy("stmt", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stack = F.array(*(F.last(F.when(F.col("lvl") == k, F.col("block")), ignorenulls=True).over(sofar) for k in range(1, deepest + 1)))
    t = t.withColumn("stack", F.slice(stack, 1, F.least(F.col("depth"), F.lit(deepest))) if deepest else F.array().cast("array<struct<is_scope:boolean,kind:string,name:string>>"))
    # a level below the deepest scope is a body; so is any that no scope opened
    inside = (F.col("depth") > deepest) | F.exists("stack", lambda b: ~b["is_scope"])
    t = t.filter(F.col("def").isNotNull() & ~F.coalesce(inside, F.lit(True)))
    return t.select(*FILE, "def.*", F.when(F.col("opens"), F.col("end_line")).otherwise(F.col("def.last")).alias("line_end"),
                    F.filter("stack", lambda b: b["name"].isNotNull()).alias("scopes"))


def scope_names(kind: str, sep: str) -> Column:
    """The names of the open scopes of one kind, outermost first ('' if none)."""
    return F.array_join(F.transform(F.filter("scopes", lambda b: b["kind"] == kind), lambda b: b["name"]), sep)
