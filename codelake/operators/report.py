"""Per-repo summaries and report sections.

Report sections are emitted as *ordered line rows* ``(repo, section, key,
line)``: the text of a section is the lines sorted by ``key``.  Nothing is
concatenated into one value per repo, so a repo holding a third of the
corpus never becomes one giant string in one task; writers sort and stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.functions import constants as K
from codelake.operators.patterns import missing_patterns

LINE_COLS = ["repo", "section", "key", "line"]


def repo_flags(repos: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Has functions / classes, and whether any is documented."""
    doc = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    fn = functions.groupBy("repo").agg(F.lit(True).alias("has_functions"),
                                       F.bool_or(doc("docstring")).alias("functions_documented"))
    cl = classes.groupBy("repo").agg(F.lit(True).alias("has_classes"),
                                     F.bool_or(doc("docstring")).alias("classes_documented"))
    return (repos.select("repo").distinct().join(fn, "repo", "left").join(cl, "repo", "left")
                 .select("repo", *[F.coalesce(c, F.lit(False)).alias(c) for c in
                                   ("has_functions", "functions_documented", "has_classes", "classes_documented")]))


def report_suggestions(repos: DataFrame, functions: DataFrame, classes: DataFrame, smells: DataFrame,
                       patterns: DataFrame) -> DataFrame:
    """Suggestion lines per repo, from a small rule set joined to the
    repo metrics (documentation flags, recurring smells I7 joined to the
    four-row smell rule dimension (ledger Q26), missing patterns K1)."""
    flags = repo_flags(repos, functions, classes)
    rule_rows = flags.select("repo", F.explode(F.array(
        F.when(~F.col("has_functions") & ~F.col("has_classes"),
               F.struct(F.lit("01").alias("key"), F.lit(K.SUGGEST_NO_CODE).alias("line"))),
        F.when(F.col("has_functions") & ~F.col("functions_documented"),
               F.struct(F.lit("02").alias("key"), F.lit(K.SUGGEST_FUNC_DOCS).alias("line"))),
        F.when(F.col("has_classes") & ~F.col("classes_documented"),
               F.struct(F.lit("03").alias("key"), F.lit(K.SUGGEST_CLASS_DOCS).alias("line"))))).alias("s"))
    rule_rows = rule_rows.filter(F.col("s").isNotNull()).select("repo", "s.key", "s.line")
    smell_dim = F.create_map(*[F.lit(x) for kv in K.SUGGEST_SMELL.items() for x in kv])
    order = F.create_map(*[F.lit(x) for i, t in enumerate(K.SUGGEST_SMELL) for x in (t, f"1{i}")])
    rec = (smells.groupBy("repo", "type").agg(F.count(F.lit(1)).alias("n"))
                 .filter((F.col("n") > 3) & F.element_at(smell_dim, F.col("type")).isNotNull())
                 .select("repo", F.element_at(order, F.col("type")).alias("key"),
                         F.replace(F.element_at(smell_dim, F.col("type")), F.lit("{n}"),
                                   F.col("n").cast("string")).alias("line")))
    miss = missing_patterns(repos, patterns)
    pat_lines = miss.select("repo", F.concat(F.lit("3"), F.col("ord").cast("string")).alias("key"),
                            F.element_at(F.create_map(*[F.lit(x) for kv in K.SUGGEST_PATTERN.items() for x in kv]),
                                         F.col("pattern")).alias("line"))
    header = miss.select("repo").distinct().select("repo", F.lit("20").alias("key"),
                                                   F.lit(K.SUGGEST_PATTERNS_HEADER).alias("line"))
    body = rule_rows.unionByName(rec).unionByName(header).unionByName(pat_lines)
    title = body.select("repo").distinct().select("repo", F.explode(F.array(
        F.struct(F.lit("00a").alias("key"), F.lit("Suggestions for Improvement:").alias("line")),
        F.struct(F.lit("00b").alias("key"), F.lit("-------------------------").alias("line")))).alias("t")
    ).select("repo", "t.key", "t.line")
    return title.unionByName(body).select("repo", F.lit("suggestions").alias("section"), "key", "line")


def report_smells(smells: DataFrame) -> DataFrame:
    """Per file ``path:``, then ``  - <type> at line <n>`` and the
    message line, ordered by path, then line."""
    head = smells.select("repo", "path").distinct().select(
        "repo", F.concat(F.col("path"), F.lit("\u0000")).alias("key"), F.concat(F.col("path"), F.lit(":")).alias("line"))
    k = F.concat(F.col("path"), F.lit("\u0001"), F.lpad(F.col("line").cast("string"), 10, "0"), F.lit("\u0001"),
                 F.col("type"), F.lit("\u0001"), F.coalesce(F.col("message"), F.lit("")))
    items = smells.select("repo", F.explode(F.array(
        F.struct(F.concat(k, F.lit("a")).alias("key"),
                 F.concat(F.lit("  - "), F.col("type"), F.lit(" at line "), F.col("line").cast("string")).alias("line")),
        F.struct(F.concat(k, F.lit("b")).alias("key"), F.concat(F.lit("    "), F.col("message")).alias("line"))))
        .alias("x")).select("repo", "x.key", "x.line")
    return head.unionByName(items).select("repo", F.lit("code_smells").alias("section"), "key", "line")


def function_metrics(functions: DataFrame, complexity: DataFrame, behaviour: DataFrame) -> DataFrame:
    """Name (``Class.`` prefix for methods), complexity, purity, side
    effects and handled exceptions per function; joined on position."""
    k = ["repo", "path", "def_pre"]
    return (functions.select(*k, "owner_class", "name")
                     .join(complexity.select(*k, "complexity"), k, "left")
                     .join(behaviour.select(*k, "is_pure", "side_effects", "handled_exceptions"), k, "left")
                     .select("repo", "path",
                             F.concat(F.coalesce(F.concat(F.col("owner_class"), F.lit(".")), F.lit("")),
                                      F.col("name")).alias("function"),
                             "complexity", "is_pure", "side_effects", "handled_exceptions"))


def export_json(tables: dict, out_dir: str, mode: str = "overwrite") -> None:
    """Write each analysis table as JSON lines under ``out_dir/<name>``
    (one record per row, distributed writes; no driver-side document)."""
    for name, df in tables.items():
        df.write.mode(mode).json(f"{out_dir.rstrip('/')}/{name}")


# ---------------------------------------------------------------- text sections as ordered lines

def _lines(df, section, key, line):
    return df.select("repo", F.lit(section).alias("section"), key.alias("key"), line.alias("line"))


def _header(repos: DataFrame, section: str, texts) -> DataFrame:
    """Fixed header lines for each repo that has the section."""
    arr = F.array(*[F.struct(F.lit(f"0{i:02d}").alias("k"), F.lit(t).alias("t")) for i, t in enumerate(texts)])
    return (repos.select("repo").distinct().select("repo", F.explode(arr).alias("h"))
                 .select("repo", F.lit(section).alias("section"), F.col("h.k").alias("key"), F.col("h.t").alias("line")))


def report_patterns(patterns: DataFrame) -> DataFrame:
    """``Design Patterns:`` then per file ``\\n<path>:`` and ``  - <pattern>``
    (only repos with patterns, ledger Q25)."""
    fk = F.concat(F.lit("1"), F.col("path"), F.lit("\u0001"))
    files = _lines(patterns.select("repo", "path").distinct(), "design_patterns",
                   F.concat(fk, F.lit("0")), F.concat(F.lit("\n"), F.col("path"), F.lit(":")))
    items = _lines(patterns, "design_patterns", F.concat(fk, F.lit("1"), F.lpad(F.col("ord").cast("string"), 3, "0")),
                   F.concat(F.lit("  - "), F.col("pattern")))
    return _header(patterns, "design_patterns", ["Design Patterns:", "-----------------"]) \
        .unionByName(files).unionByName(items)


def _yes(c):
    return F.when(c, F.lit("Yes")).otherwise(F.lit("No"))


def function_lines(functions: DataFrame, behaviour: DataFrame, flow: DataFrame, indent: str = "") -> DataFrame:
    """The per-function text block (signature, documentation, behaviour
    flags, variables) as rows ``(repo, path, def_pre, sub, line)``; the
    variable list is ordered by name."""
    k = ["repo", "path", "def_pre"]
    args = F.array_join(F.transform("args", lambda a: F.when(a["type"].isNotNull(),
                                                             F.concat(a["name"], F.lit(": "), a["type"]))
                                    .otherwise(a["name"])), ", ")
    f = functions.select(*k, "name", "args", "returns", "docstring").join(behaviour.select(*k, "is_pure", "side_effects", "handled_exceptions", "is_async",
                                        "is_generator", "is_recursive", F.lit(True).alias("_b")), k, "left")

    def none_if_empty(arr):
        return F.when(F.size(arr) > 0, F.array_join(arr, ", ")).otherwise(F.lit("None"))
    p = indent + "  "
    rows = F.array(
        F.struct(F.lit("0").alias("s"), F.concat(F.lit(p), F.col("name"), F.lit("("), args, F.lit(") -> "),
                                               F.coalesce(F.col("returns"), F.lit("None"))).alias("t")),
        F.struct(F.lit("1").alias("s"), F.concat(F.lit(p + "Documentation: "),
                                               F.coalesce(F.when(F.col("docstring") != "", F.col("docstring")),
                                                          F.lit("None"))).alias("t")),
        F.when(F.col("_b"), F.struct(F.lit("2").alias("s"), F.concat(F.lit(p + "Pure Function: "), _yes(F.col("is_pure"))).alias("t"))),
        F.when(F.col("_b"), F.struct(F.lit("3").alias("s"), F.concat(F.lit(p + "Side Effects: "), none_if_empty(F.col("side_effects"))).alias("t"))),
        F.when(F.col("_b"), F.struct(F.lit("4").alias("s"), F.concat(F.lit(p + "Raises: "), none_if_empty(F.col("handled_exceptions"))).alias("t"))),
        F.when(F.col("_b"), F.struct(F.lit("5").alias("s"), F.concat(F.lit(p + "Async: "), _yes(F.col("is_async"))).alias("t"))),
        F.when(F.col("_b"), F.struct(F.lit("6").alias("s"), F.concat(F.lit(p + "Generator: "), _yes(F.col("is_generator"))).alias("t"))),
        F.when(F.col("_b"), F.struct(F.lit("7").alias("s"), F.concat(F.lit(p + "Recursive: "), _yes(F.col("is_recursive"))).alias("t"))))
    main = (f.select(*k, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r"))
             .select(*k, F.col("r.s").alias("sub"), F.col("r.t").alias("line")))
    v = flow.select(*k, F.concat(F.lit("9"), F.col("name")).alias("sub"),
                    F.concat(F.lit(p + "  - "), F.col("name"), F.lit(" ("), F.col("scope"), F.lit("): assigned "),
                             F.size("assignments").cast("string"), F.lit(" times, read "),
                             F.size("reads").cast("string"), F.lit(" times")).alias("line"))
    vh = flow.select(*k).distinct().select(*k, F.lit("8").alias("sub"), F.lit(p + "Variables:").alias("line"))
    return main.unionByName(vh).unionByName(v)


def report_functions(functions: DataFrame, behaviour: DataFrame, flow: DataFrame) -> DataFrame:
    """``Function Analysis:`` then per file ``File: <path>`` and each
    file-level function's block (methods go to the classes section)."""
    fns = functions.filter(F.col("owner_class").isNull())
    body = function_lines(fns, behaviour, flow.join(fns.select("repo", "path", "def_pre"), ["repo", "path", "def_pre"]))
    fk = F.concat(F.lit("1"), F.col("path"), F.lit("\u0001"))
    lines = _lines(body, "functions", F.concat(fk, F.lpad(F.col("def_pre").cast("string"), 10, "0"), F.lit("\u0001"),
                                              F.col("sub")), F.col("line"))
    heads = fns.select("repo", "path").distinct()
    file_lines = (_lines(heads, "functions", F.concat(fk, F.lit("0")), F.lit(""))
                  .unionByName(_lines(heads, "functions", F.concat(fk, F.lit("00")),
                                      F.concat(F.lit("File: "), F.col("path")))))
    tail = _lines(heads.select("repo").distinct(), "functions", F.lit("2"), F.lit(""))
    return (_header(fns, "functions", ["", "Function Analysis:", "-----------------"])
            .unionByName(file_lines).unionByName(lines).unionByName(tail))


def function_flow(functions: DataFrame, behaviour: DataFrame, flow: DataFrame, control: DataFrame,
                  callers: DataFrame) -> DataFrame:
    """Per function the number of functions calling it (entry points,
    L30: name-level counts pre-aggregated per repo), its exit points, and
    its variable and control-flow summaries (bounded by the function)."""
    k = ["repo", "path", "def_pre"]
    n_callers = (callers.select("repo", "path", "caller_pre", "callee").distinct()
                        .groupBy("repo", F.col("callee").alias("name")).agg(F.count(F.lit(1)).alias("n_callers")))
    vars_ = (flow.groupBy(*k).agg(F.array_join(F.array_sort(F.collect_list(F.concat(
        F.col("name"), F.lit(" ("), F.col("scope"), F.lit(" assigned:"), F.size("assignments").cast("string"),
        F.lit(" read:"), F.size("reads").cast("string"), F.lit(")")))), "\n").alias("variables")))
    cf = (control.groupBy(*k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "line_no", F.when(F.col("condition").isNotNull(), F.concat(F.col("node_type"), F.lit(": "), F.col("condition")))
        .otherwise(F.col("node_type")).alias("t")))), lambda x: x["t"]), "\n").alias("control_flow")))
    return (functions.select(*k, "owner_class", "name")
                     .join(behaviour.select(*k, "exit_points"), k, "left")
                     .join(n_callers, ["repo", "name"], "left")
                     .join(vars_, k, "left").join(cf, k, "left")
                     .select(*k, F.concat(F.coalesce(F.concat(F.col("owner_class"), F.lit(".")), F.lit("")),
                                          F.col("name")).alias("function"),
                             F.coalesce("n_callers", F.lit(0)).cast("bigint").alias("n_entry_points"),
                             F.coalesce(F.array_join("exit_points", "\n"), F.lit("")).alias("exit_points"),
                             F.coalesce("variables", F.lit("")).alias("variables"),
                             F.coalesce("control_flow", F.lit("")).alias("control_flow")))


def report_classes(classes: DataFrame, functions: DataFrame, variables: DataFrame, behaviour: DataFrame,
                   flow: DataFrame) -> DataFrame:
    """``Class Analysis:`` then per file ``File: <path>`` and per class
    its signature, documentation, class variables and methods (each method
    rendered like a function, indented)."""
    ck = ["repo", "path", "class_pre"]
    fk = F.concat(F.lit("1"), F.col("path"), F.lit("\u0001"))
    ckey = F.concat(fk, F.lpad(F.col("class_pre").cast("string"), 10, "0"), F.lit("\u0001"))
    c = classes.select(*ck, "name", "base_classes", "docstring")
    head = c.select("repo", "path", "class_pre", F.explode(F.array(
        F.struct(F.lit("0").alias("s"), F.concat(F.lit("  "), F.col("name"), F.lit("("),
                                                 F.array_join("base_classes", ", "), F.lit(")")).alias("t")),
        F.struct(F.lit("1").alias("s"), F.concat(F.lit("  Documentation: "), F.coalesce(
            F.when(F.col("docstring") != "", F.col("docstring")), F.lit("None"))).alias("t")))).alias("r"))
    head = _lines(head, "classes", F.concat(ckey, F.col("r.s")), F.col("r.t"))
    cv = variables.filter(F.col("scope") == "class").join(
        c.select("repo", "path", "class_pre", F.col("class_pre").alias("owner_pre")), ["repo", "path", "owner_pre"])
    cv_lines = _lines(cv, "classes", F.concat(ckey, F.lit("3"), F.lpad(F.col("assign_pre").cast("string"), 10, "0")),
                      F.concat(F.lit("    - "), F.col("name"), F.lit(": "),
                               F.coalesce(F.col("type_hint"), F.lit("Unknown type"))))
    cv_head = _lines(cv.select(*ck).distinct(), "classes", F.concat(ckey, F.lit("2")), F.lit("  Class Variables:"))
    # methods: defs directly in a class body; the class is found by position (ledger Q3)
    meth = functions.filter(F.col("owner_class").isNotNull())
    mk = ["repo", "path", "def_pre"]
    mlines = function_lines(meth, behaviour, flow.join(meth.select(*mk), mk), indent="    ")
    owner = meth.select(*mk, F.col("owner_pre").alias("class_pre"))
    m = mlines.join(owner, mk)
    m_lines = _lines(m, "classes", F.concat(ckey, F.lit("5"), F.lpad(F.col("def_pre").cast("string"), 10, "0"),
                                            F.lit("\u0001"), F.col("sub")), F.col("line"))
    m_head = _lines(owner.select(*ck).distinct(), "classes", F.concat(ckey, F.lit("4")), F.lit("  Methods:"))
    files = c.select("repo", "path").distinct()
    file_lines = (_lines(files, "classes", F.concat(fk, F.lit("0")), F.lit(""))
                  .unionByName(_lines(files, "classes", F.concat(fk, F.lit("00")),
                                      F.concat(F.lit("File: "), F.col("path")))))
    tail = _lines(files.select("repo").distinct(), "classes", F.lit("2"), F.lit(""))
    return (_header(c, "classes", ["", "Class Analysis:", "--------------"])
            .unionByName(file_lines).unionByName(head).unionByName(cv_head).unionByName(cv_lines)
            .unionByName(m_head).unionByName(m_lines).unionByName(tail))


def report_overview(files: DataFrame, structure: DataFrame) -> DataFrame:
    """Name, file total, languages (``lang (n files)``, by name; the
    list is bounded by the language table), entry points -- one line each
    (``- path``), or ``None identified`` -- and the indented tree (K2/L38)
    keyed by ``tree_key``."""
    from codelake.operators.classify import entry_points, language_counts, tree_text
    langs = (language_counts(files).groupBy("repo").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("language", "n_files"))),
        lambda x: F.concat(x["language"], F.lit(" ("), x["n_files"].cast("string"), F.lit(" files)"))), ", ")
        .alias("langs"), F.sum("n_files").alias("n")))
    eps = entry_points(files)
    has_ep = eps.select("repo").distinct().withColumn("has_ep", F.lit(True))
    top = langs.join(has_ep, "repo", "left").select("repo", F.explode(F.array(
        F.struct(F.lit("000").alias("k"), F.lit("").alias("t")),
        F.struct(F.lit("001").alias("k"), F.lit("Project Overview:").alias("t")),
        F.struct(F.lit("002").alias("k"), F.lit("----------------").alias("t")),
        F.struct(F.lit("003").alias("k"), F.concat(F.lit("Name: "), F.col("repo")).alias("t")),
        F.struct(F.lit("004").alias("k"), F.concat(F.lit("Total Files: "), F.col("n").cast("string")).alias("t")),
        F.struct(F.lit("005").alias("k"), F.concat(F.lit("Languages: "), F.col("langs")).alias("t")),
        F.struct(F.lit("006").alias("k"), F.when(F.col("has_ep"), F.lit("Entry Points:"))
                 .otherwise(F.lit("Entry Points: None identified")).alias("t")),
        F.struct(F.lit("008").alias("k"), F.lit("").alias("t")),
        F.struct(F.lit("009").alias("k"), F.lit("Key Files:").alias("t")),
        F.struct(F.lit("3").alias("k"), F.lit("").alias("t")))).alias("h"))
    top = _lines(top, "project_overview", F.col("h.k"), F.col("h.t"))
    ep_lines = _lines(eps, "project_overview", F.concat(F.lit("007"), F.col("path")),
                      F.concat(F.lit("- "), F.col("path")))
    tree = _lines(tree_text(structure), "project_overview", F.concat(F.lit("2"), F.col("tree_key")), F.col("line"))
    return top.unionByName(ep_lines).unionByName(tree)


def report_architecture(files: DataFrame, structure: DataFrame, functions: DataFrame, classes: DataFrame,
                        edges: DataFrame) -> DataFrame:
    """Project structure (tree), entry points, per-file functions and
    classes, and per-file dependencies / dependents -- all as keyed lines.
    Blocks: 0 header, 1 tree, 2 entry points, 3 files, 4 dependencies."""
    from codelake.operators.classify import entry_points, tree_text
    repos = files.select("repo").distinct()
    eps = entry_points(files)
    has_ep = eps.select("repo").distinct().withColumn("has_ep", F.lit(True))
    fixed = repos.join(has_ep, "repo", "left").select("repo", F.explode(F.array(
        F.struct(F.lit("00").alias("k"), F.lit("Project Structure:").alias("t")),
        F.struct(F.lit("01").alias("k"), F.lit("-----------------").alias("t")),
        F.struct(F.lit("20").alias("k"), F.lit("\nEntry Points:").alias("t")),
        F.struct(F.lit("21").alias("k"), F.lit("-----------------").alias("t")),
        F.when(~F.coalesce(F.col("has_ep"), F.lit(False)),
               F.struct(F.lit("22").alias("k"), F.lit("No entry points identified").alias("t"))),
        F.struct(F.lit("30").alias("k"), F.lit("\nFile Organization:").alias("t")),
        F.struct(F.lit("31").alias("k"), F.lit("-----------------").alias("t")),
        F.struct(F.lit("40").alias("k"), F.lit("\nDependencies and Relationships:").alias("t")),
        F.struct(F.lit("41").alias("k"), F.lit("-----------------").alias("t")))).alias("h"))
    fixed = _lines(fixed.filter(F.col("h").isNotNull()), "architecture", F.col("h.k"), F.col("h.t"))
    tree = _lines(tree_text(structure), "architecture", F.concat(F.lit("1"), F.col("tree_key")), F.col("line"))
    ep = _lines(eps, "architecture", F.concat(F.lit("23"), F.col("path")), F.concat(F.lit("- "), F.col("path")))
    fk = F.concat(F.lit("32"), F.col("path"), F.lit("\u0001"))
    org = _lines(files.select("repo", "path"), "architecture", F.concat(fk, F.lit("0")),
                 F.concat(F.lit("\n"), F.col("path"), F.lit(":")))
    fns = functions.filter(F.col("owner_class").isNull())
    fn_h = _lines(fns.select("repo", "path").distinct(), "architecture", F.concat(fk, F.lit("1")), F.lit("  Functions:"))
    fn_l = _lines(fns, "architecture", F.concat(fk, F.lit("2"), F.lpad(F.col("line_start").cast("string"), 10, "0"),
                                                F.lit("\u0001"), F.col("name")),
                  F.concat(F.lit("    - "), F.col("name")))
    cl_h = _lines(classes.select("repo", "path").distinct(), "architecture", F.concat(fk, F.lit("3")), F.lit("  Classes:"))
    cl_l = _lines(classes, "architecture", F.concat(fk, F.lit("4"), F.lpad(F.col("line_start").cast("string"), 10, "0"),
                                                    F.lit("\u0001"), F.col("name")),
                  F.concat(F.lit("    - "), F.col("name")))
    dk_src = F.concat(F.lit("42"), F.col("src"), F.lit("\u0001"))
    dk_dst = F.concat(F.lit("42"), F.col("dst"), F.lit("\u0001"))
    dep_h = _lines(edges.select("repo", "src").distinct(), "architecture", F.concat(dk_src, F.lit("0")),
                   F.concat(F.lit("\n"), F.col("src"), F.lit(" depends on:")))
    dep_l = _lines(edges, "architecture", F.concat(dk_src, F.lit("1"), F.col("dst")), F.concat(F.lit("  - "), F.col("dst")))
    use_h = _lines(edges.select("repo", "dst").distinct(), "architecture", F.concat(dk_dst, F.lit("2")),
                   F.concat(F.lit("\n"), F.col("dst"), F.lit(" is used by:")))
    use_l = _lines(edges, "architecture", F.concat(dk_dst, F.lit("3"), F.col("src")), F.concat(F.lit("  - "), F.col("src")))
    out = fixed
    for d in (tree, ep, org, fn_h, fn_l, cl_h, cl_l, dep_h, dep_l, use_h, use_l):
        out = out.unionByName(d)
    return out


_SMELLS = "array<struct<line:int,type:string,name:string,message:string>>"


def file_summary(files: DataFrame, nodes: DataFrame, patterns: DataFrame, smells: DataFrame,
                 edges: DataFrame) -> DataFrame:
    """One row per file, like the analysed tool's ``File``:
    definition counts, design patterns and smell records (bounded per file),
    smell count, successors (bounded by the file's imports) and the number of dependents
    (a count, so a hot module never gathers its importers into one row)."""
    from codelake.operators.graph import dependency_adjacency
    from codelake.operators.pyfacts import file_definition_counts
    k = ["repo", "path"]
    pats = patterns.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "pattern"))),
                                                lambda x: x["pattern"]).alias("design_patterns"))
    sm = smells.groupBy(*k).agg(F.count(F.lit(1)).alias("n_smells"), F.sort_array(F.collect_list(
        F.struct("line", "type", "name", "message"))).alias("smells"))
    dep = edges.groupBy("repo", F.col("dst").alias("path")).agg(F.countDistinct("src").alias("n_dependents"))
    return (file_definition_counts(files, nodes)
            .join(files.select(*k, "language"), k)
            .join(dependency_adjacency(files, edges), k)
            .join(pats, k, "left").join(sm, k, "left").join(dep, k, "left")
            .select(*k, "language", "n_functions", "n_classes",
                    F.coalesce("design_patterns", F.array().cast("array<string>")).alias("design_patterns"),
                    F.coalesce("n_smells", F.lit(0)).cast("bigint").alias("n_smells"),
                    F.coalesce("smells", F.array().cast(_SMELLS)).alias("smells"), "dependencies",
                    F.coalesce("n_dependents", F.lit(0)).cast("bigint").alias("n_dependents")))
