"""C0 ``py_nodes``: one distributed job that flattens Python syntax trees.

This is the only per-row Python in the library.  It parses each file once
with the standard ``ast`` module and emits one row per syntax node with the
facts later operators need (kind, names, positions, parent, ancestor chain,
and source text for the few node roles whose text is reported).  Every
judgement -- complexity, nesting, smells, patterns, scopes, purity -- is
DataFrame code over this table.

Every file yields one ``kind = '__file__'`` row besides: its ``field`` is "ok" or
"error", and an error's kind, line and message are its ``name``, ``lineno`` and
``text`` (A8 per-file fault isolation).  So a file without facts and a file that
could not be parsed are never taken for one another.
"""

from __future__ import annotations

import ast
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, MapType, StringType, StructField,
                               StructType)

ANC_TYPE = StructType([
    StructField("pre", IntegerType()), StructField("kind", StringType()),
    StructField("name", StringType()), StructField("lineno", IntegerType())])
DEFS_TYPE = ArrayType(StructType([StructField("pre", IntegerType()), StructField("name", StringType())]))

PY_NODES_SCHEMA = StructType([
    StructField("repo", StringType()), StructField("path", StringType()),
    StructField("pre", IntegerType()), StructField("parent", IntegerType()),
    StructField("depth", IntegerType()), StructField("field", StringType()),
    StructField("ord", IntegerType()), StructField("kind", StringType()),
    StructField("name", StringType()), StructField("ctx", StringType()),
    StructField("lineno", IntegerType()), StructField("end_lineno", IntegerType()),
    StructField("col", IntegerType()), StructField("end_col", IntegerType()),
    StructField("text", StringType()), StructField("n_values", IntegerType()),
    StructField("attrs", MapType(StringType(), StringType())),
    StructField("p1", ANC_TYPE), StructField("p2", ANC_TYPE), StructField("p3", ANC_TYPE),
    StructField("defs", DEFS_TYPE),
    StructField("n_loops", IntegerType()), StructField("n_scopes", IntegerType()),
    StructField("scope", IntegerType()),
])

# node roles whose source text is reported (annotations, return types,
# decorators, bases, conditions, loop heads, assigned values)
_TEXT_FIELDS = frozenset({"annotation", "returns", "decorator_list", "bases", "test", "iter"})


def _all_subclasses(cls):
    out = set()
    for c in cls.__subclasses__():
        out.add(c)
        out |= _all_subclasses(c)
    return out


# context / operator singletons carry no facts: not emitted
_SKIP = frozenset().union(*[_all_subclasses(c) for c in
                            (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop)])
_DOC_KINDS = frozenset({"FunctionDef", "AsyncFunctionDef", "ClassDef", "Module"})
_DEF_KINDS = frozenset({"FunctionDef", "AsyncFunctionDef"})
# node kinds the operators read as rows; other expression nodes (constants,
# calls, operators, ``arguments``...) are still walked -- their facts reach
# their children through p1-p3 -- but only emitted when they carry reported
# text or sit in a statement list
KEEP_KINDS = frozenset({
    "Name", "Attribute", "arg", "alias", "FunctionDef", "AsyncFunctionDef", "ClassDef", "Lambda",
    "If", "For", "AsyncFor", "While", "With", "AsyncWith", "Match", "Try", "TryStar", "ExceptHandler",
    "BoolOp", "Return", "Yield", "YieldFrom", "Await", "Global", "Nonlocal", "Import", "ImportFrom",
    "Assign", "AnnAssign", "AugAssign", "MatchAs", "MatchStar", "MatchMapping"})
_DEFS = {"FunctionDef", "AsyncFunctionDef", "ClassDef"}
# what one group of operators reads: node kinds, child roles whose nodes are
# emitted whatever their kind, whether expressions are walked, whether texts
# and docstrings are written
FACTS = {
    "imports": (frozenset({"Import", "ImportFrom", "alias"}), frozenset(), False, False),
    "defs": (frozenset(_DEFS | {"arg"}), frozenset({"annotation", "returns", "decorator_list", "bases"}), False, True),
    "smells": (frozenset(_DEFS | {"arg", "If", "For", "While"}), frozenset(), False, False),
    "patterns": (frozenset(_DEFS), frozenset({"decorator_list", "bases", "target"}), False, False),
    "behaviour": (frozenset(_DEFS | {"Name", "arg", "alias", "Global", "Nonlocal", "Yield", "Return", "If", "While", "For", "ExceptHandler",
                                     "MatchAs", "MatchStar", "MatchMapping"}), frozenset({"annotation"}), True, True),
    "complexity": (frozenset(_DEFS | {"If", "For", "While", "Match", "ExceptHandler", "BoolOp"}), frozenset(), True, False),
    "counts": (frozenset(_DEFS), frozenset(), False, False),
    "calls": (frozenset(_DEFS), frozenset({"func"}), True, False),
    "returns": (frozenset({"Return", "If", "For", "While"}), frozenset(), False, False),
    # with the heads and branch lines of if, for and while in a def (``attrs``)
    "flow": (frozenset({"Return", "If", "For", "While"}), frozenset(), False, False),
    # targets and values of assignments at module level and in class bodies
    "variables": (frozenset(), frozenset(), False, False),
}
_NOTHING = (frozenset(), None)
_STMT_FIELDS = frozenset({"body", "orelse", "handlers", "finalbody"})
_LOOP_KINDS = frozenset({"If", "For", "While"})
_COMPREHENSIONS = frozenset({"ListComp", "SetComp", "DictComp", "GeneratorExp"})
# how a Name meets the scopes inside its def (``n_values`` of Name rows)
INNER, IN_CLASS = 1, 2
# all plain uses of a name in a def as one row: ``name``, ``scope`` and, as ``text``,
# "<position> <line> <context>" of each, joined by commas; a context in a comprehension
# or lambda that binds the name begins with "i", one in a class body with "c"
USES = "__uses__"
_SCOPE_KINDS = frozenset({"FunctionDef", "AsyncFunctionDef", "ClassDef", "Lambda"})
_NAME_ATTR = {"FunctionDef": "name", "AsyncFunctionDef": "name", "ClassDef": "name", "Name": "id",
              "Attribute": "attr", "alias": "name", "arg": "arg", "keyword": "arg", "ExceptHandler": "name",
              "MatchAs": "name", "MatchStar": "name", "MatchMapping": "rest"}
_CTX_NAME = {c: c.__name__ for c in _all_subclasses(ast.expr_context)}
_HEADS = {"If": ("test",), "While": ("test",), "For": ("target", "iter")}
_WALKED = frozenset(_all_subclasses(ast.AST)) - _SKIP
_EXPRS = frozenset(_all_subclasses(ast.expr))
# fields that never hold a walked node
_PLAIN_FIELDS = frozenset({"ctx", "id", "op", "ops", "kind", "level", "module", "type_comment", "simple", "asname", "is_async", "conversion"})
_CHILD_FIELDS = {c: tuple(f for f in c._fields if f not in _PLAIN_FIELDS) for c in _WALKED}


class _Group:
    """What one or several groups of ``FACTS`` read, and which node classes
    hold none of it (``dead``: their nodes are no further looked into, and but
    for ``exact`` positions not even numbered)."""

    def __init__(self, names: tuple[str, ...], exact: bool):
        groups = [FACTS[n] for n in names]
        self.keep = frozenset().union(*(g[0] for g in groups))
        self.roles = frozenset().union(*(g[1] for g in groups))
        self.deep = exact or any(g[2] for g in groups)
        self.docs = any(g[3] for g in groups)
        self.text_roles = frozenset().union(*(g[1] for g in groups if g[3]))
        self.variables, self.branches = "variables" in names, "flow" in names
        self.names = "Name" in self.keep
        self.uses = "behaviour" in names

        def without(c, *kinds):
            return not self.keep & {c.__name__, *kinds} and not self.roles & set(c._fields)
        simple = [ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias]
        dead = {c for c in simple if without(c)} | {c for c in (ast.Import, ast.ImportFrom) if without(c, "alias")}
        if self.deep:
            dead |= {c for c in (ast.Constant, ast.Name) if without(c)}
        else:
            dead |= _EXPRS | {c for c in (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Expr, ast.Return, ast.Raise, ast.Delete, ast.Assert,
                                          ast.arg, ast.keyword, ast.withitem) if without(c)}
            dead |= {c for c in (ast.arguments,) if without(c, "arg") and "annotation" not in self.roles}
            if self.variables:
                dead -= {ast.Assign}
        self.dead = frozenset(dead)
        self.walked = _WALKED if exact else _WALKED - self.dead
        # an assignment of dead nodes to dead nodes holds no fact either (for
        # variables, one in a def or below another statement of a class)
        self.plain = not exact and "Assign" not in self.keep and not self.roles & {"targets", "value"}


class _Everything:
    keep, roles, text_roles, deep, docs, variables, branches, names, uses = KEEP_KINDS, _STMT_FIELDS, frozenset(), True, True, False, True, True, False
    dead, walked, plain = frozenset(), _WALKED, False


@lru_cache(None)
def _group(facts: str | tuple[str, ...] | None, exact: bool):
    return _Everything if facts is None else _Group((facts,) if isinstance(facts, str) else tuple(facts), exact)


def _unparse(node, content):
    """Source text of a node; where the tree cannot be written back (nesting
    beyond the interpreter's limit), the node's own source segment."""
    try:
        return ast.unparse(node)
    except (RecursionError, ValueError):
        return ast.get_source_segment(content, node) or type(node).__name__


def _branches(node, kind, content, heads):
    """The heads of an if, for or while as text and the lines its branches'
    statements begin on; ``heads`` keeps the texts by node."""
    attrs = {}
    for f in _HEADS[kind]:
        head = getattr(node, f)
        attrs[f] = heads[id(head)] = _unparse(head, content)
    for f in ("body", "orelse"):
        lines = getattr(node, f)
        if lines:
            attrs[f] = ",".join([str(x.lineno) for x in lines])
    return attrs


def _bound_inside(node, kind):
    """Names that a comprehension or a lambda binds for itself."""
    if kind == "Lambda":
        a = node.args
        return frozenset(x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x is not None)
    return frozenset(x.id for g in node.generators for x in ast.walk(g.target) if isinstance(x, ast.Name))


def _flatten_one(content: str, all_nodes: bool = False, facts: str | tuple[str, ...] | None = None, exact: bool = False):
    """Node tuples of one file in pre-order (``iter_child_nodes`` order).

    Tuple layout: pre, parent, depth, field, ord, kind, name, ctx, lineno,
    end_lineno, col, end_col, text, n_values, attrs, up, defs, n_loops,
    n_scopes, scope.  ``up`` holds the nearest three ancestors as
    (pre, kind, name, lineno), nearest last; ``defs`` the enclosing defs as
    (pre, name), outermost first; ``n_loops`` / ``n_scopes`` count enclosing
    if/for/while and def/class/lambda nodes.  ``n_values`` counts the operands
    of a BoolOp; of a Name it tells whether a comprehension or lambda within its
    def binds it (``INNER``), or else whether it stands in a class body
    (``IN_CLASS``).  The ``attrs`` of an if, for or while in a def hold its
    heads (``test``, ``target``, ``iter``) and the lines of its branches.

    With ``facts`` only what those groups of operators read is emitted (for
    "behaviour" the uses of a name that are no more than that as one ``USES``
    row a def, of the position before the first node), and
    nodes that cannot hold any of it are not walked; positions then number the
    walked nodes, or with ``exact`` all nodes, as without ``facts``.
    """
    tree = ast.parse(content)
    some = facts is not None
    g = _group(facts, exact)
    keep, roles, text_roles, docs, dead, walked = g.keep, g.roles, g.text_roles, g.docs, g.dead, g.walked
    variables, branches, bound_names, plain, deep = g.variables, g.branches, g.names, g.plain, g.deep
    heads = {}
    out = []
    append = out.append
    uses = {} if g.uses and not all_nodes else None
    # stack items: (node, parent_pre, depth, field, ord, parent_kind, up, defs,
    # n_loops, n_scopes, scope, inner, in_class); scope = innermost def whose
    # *body* (not signature) holds the node; inner = (names bound by
    # comprehensions and lambdas around it, the same outside of the nearest)
    stack = [(tree, None, 0, None, None, None, (), (), 0, 0, None, _NOTHING, False)]
    pop, push = stack.pop, stack.append
    pre = 0
    imp_level = "0"
    while stack:
        node, parent, depth, field, ordn, pkind, up, defs, n_loops, n_scopes, scope, inner, in_class = pop()
        cls = type(node)
        kind = cls.__name__
        emit = all_nodes or kind in keep or field in roles
        emitted, text = False, None
        if some:
            if docs and field in text_roles:
                text = _unparse(node, content)
            if variables and pkind == "Assign" and (field == "targets" or field == "value") and (n_scopes == 0 or up[-2][1] == "ClassDef"):
                emit = emitted = True
                if field == "value" and text is None:
                    text = _unparse(node, content)
        # assigned-value text is reported for module / class-body variables only
        elif field in _TEXT_FIELDS or (field == "target" and (pkind == "For" or pkind == "AsyncFor")) or \
                (field == "value" and (pkind == "Assign" or pkind == "AnnAssign") and
                 (n_scopes == 0 or (len(up) >= 2 and up[-2][1] == "ClassDef"))):
            text = heads.pop(id(node), None) or _unparse(node, content)
            emit = True
        if uses is not None and kind == "Name" and scope is not None and text is None and field not in roles and not emitted:
            ctx = _CTX_NAME[type(node.ctx)]
            if ctx == "Store" or (len(defs) < 2 and field != "func" and pkind != "ExceptHandler" and pkind != "Tuple"):
                mark = "i" if node.id in inner[0] else "c" if in_class else ""
                uses.setdefault((scope, node.id), []).append(f"{pre} {node.lineno} {mark}{ctx}")
                pre += 1
                continue
        leaf = cls in dead
        if leaf and not emit:
            pre += 1
            continue
        na = _NAME_ATTR.get(kind)
        if na is not None:
            name = getattr(node, na)
        elif kind == "ImportFrom":
            name = node.module or ""
            imp_level = str(node.level or 0)
        elif kind == "Global" or kind == "Nonlocal":
            name = ",".join(node.names)
        else:
            name = None
        lineno = getattr(node, "lineno", None)
        if emit:
            attrs = None
            if kind in _DOC_KINDS and docs:
                doc = ast.get_docstring(node)
                if doc is not None:
                    attrs = {"docstring": doc}
            elif kind == "alias":
                attrs = {"asname": node.asname} if node.asname else {}
                if pkind == "ImportFrom":
                    attrs["module"] = up[-1][2]
                    attrs["level"] = imp_level
                attrs = attrs or None
            elif kind == "ImportFrom":
                attrs = {"level": imp_level}
            elif branches and scope is not None and kind in _LOOP_KINDS:
                attrs = _branches(node, kind, content, heads)
            ctx = getattr(node, "ctx", None)
            append((pre, parent, depth, field, ordn, kind, name,
                    _CTX_NAME.get(type(ctx)) if ctx is not None else None,
                    lineno, getattr(node, "end_lineno", None),
                    getattr(node, "col_offset", None), getattr(node, "end_col_offset", None),
                    text, len(node.values) if kind == "BoolOp" else None if kind != "Name" else
                    INNER if name in inner[0] else IN_CLASS if in_class else None, attrs, up, defs, n_loops,
                    n_scopes, scope))
        if leaf:
            pre += 1
            continue
        # targets and values are rows whatever their kind
        every = variables and kind == "Assign" and (n_scopes == 0 or pkind == "ClassDef")
        unread = plain and variables and (n_scopes > 0 or kind in _SCOPE_KINDS) and kind != "ClassDef"
        children = []
        for fname in _CHILD_FIELDS[cls]:
            value = getattr(node, fname, None)
            if value is None:
                continue
            some_of = _WALKED if every or fname in roles else walked
            if type(value) is list:
                for i, item in enumerate(value):
                    t = type(item)
                    if t in some_of:
                        if t is ast.Assign and plain and (unread or not variables) and (not deep or type(item.value) in dead and all(type(x) in dead for x in item.targets)):
                            continue
                        children.append((item, fname, i))
            elif type(value) in some_of:
                children.append((value, fname, 0))
        if children:
            d1 = depth + 1
            my_up = (up + ((pre, kind, name, lineno),))[-3:]
            is_def = kind in _DEF_KINDS
            my_defs = defs + ((pre, name),) if is_def else defs
            my_loops = n_loops + 1 if kind in _LOOP_KINDS else n_loops
            my_scopes = n_scopes + 1 if kind in _SCOPE_KINDS else n_scopes
            if bound_names and (kind in _COMPREHENSIONS or kind == "Lambda"):
                inner = (inner[0] | _bound_inside(node, kind), inner)
                in_class = False
            # what is evaluated outside: the first iterable, a lambda's defaults
            first = bound_names and kind == "comprehension" and ordn == 0
            defaults = bound_names and kind == "arguments" and pkind == "Lambda"
            for child, fname, i in reversed(children):
                body = fname == "body"
                outside = (first and fname == "iter") or (defaults and fname in ("defaults", "kw_defaults"))
                push((child, pre, d1, fname, i, kind, my_up, my_defs, my_loops, my_scopes,
                      pre if is_def and body else scope, _NOTHING if is_def and body else inner[1] if outside else inner,
                      kind == "ClassDef" if body and (is_def or kind == "ClassDef") else in_class))
        pre += 1
    if uses:
        for (scope, name), at in uses.items():
            append((-1, None, 0, None, None, USES, name, None, None, None, None, None, ",".join(at), None, None, (), (), 0, 0, scope))
    return out


_P_ARROW = pa.struct([("pre", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("lineno", pa.int32())])
_ARROW_SCHEMA = pa.schema([
    ("repo", pa.string()), ("path", pa.string()), ("pre", pa.int32()), ("parent", pa.int32()),
    ("depth", pa.int32()), ("field", pa.string()), ("ord", pa.int32()), ("kind", pa.string()),
    ("name", pa.string()), ("ctx", pa.string()), ("lineno", pa.int32()),
    ("end_lineno", pa.int32()), ("col", pa.int32()), ("end_col", pa.int32()),
    ("text", pa.string()), ("n_values", pa.int32()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("p1", _P_ARROW), ("p2", _P_ARROW), ("p3", _P_ARROW),
    ("defs", pa.list_(pa.struct([("pre", pa.int32()), ("name", pa.string())]))),
    ("n_loops", pa.int32()), ("n_scopes", pa.int32()),
    ("scope", pa.int32()),
])


def _strings(values):
    """A string column; lone surrogates (legal in Python literals, not in
    UTF-8) are written as backslash escapes."""
    try:
        return pa.array(values, type=pa.string())
    except UnicodeEncodeError:
        return pa.array([v if v is None else v.encode("utf-8", "backslashreplace").decode() for v in values], type=pa.string())


def _batch(repos, paths, rows):
    """Transpose node tuples into one Arrow batch with C-level loops; the
    ancestor chains become flat child arrays plus offsets."""
    from itertools import accumulate, chain
    cols = list(zip(*rows))
    arrays = [_strings(repos), _strings(paths)]
    for i in range(14):
        kind = _ARROW_SCHEMA.field(i + 2).type
        arrays.append(_strings(cols[i]) if kind == pa.string() else pa.array(cols[i], type=kind))
    attrs = cols[14]
    valid = [a is not None for a in attrs]
    keys = list(chain.from_iterable(a.keys() for a in attrs if a))
    vals = list(chain.from_iterable(a.values() for a in attrs if a))
    aoff = [0, *accumulate(len(a) if a else 0 for a in attrs)]
    arrays.append(pa.MapArray.from_arrays(pa.array(aoff, type=pa.int32()), _strings(keys),
                                          _strings(vals),
                                          mask=pa.array([not v for v in valid], type=pa.bool_())))
    ups = cols[15]
    none4 = (None, None, None, None)
    for k in (1, 2, 3):
        ps = [u[-k] if len(u) >= k else none4 for u in ups]
        f = list(zip(*ps))
        arrays.append(pa.StructArray.from_arrays(
            [pa.array(f[0], type=pa.int32()), _strings(f[1]), _strings(f[2]), pa.array(f[3], type=pa.int32())],
            fields=list(_P_ARROW), mask=pa.array([len(u) < k for u in ups], type=pa.bool_())))
    defs = cols[16]
    flat = list(chain.from_iterable(defs))
    f = list(zip(*flat)) if flat else [[], []]
    st = pa.StructArray.from_arrays([pa.array(f[0], type=pa.int32()), _strings(f[1])],
                                    fields=list(_ARROW_SCHEMA.field("defs").type.value_type))
    arrays.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, defs))], type=pa.int32()), st))
    arrays.append(pa.array(cols[17], type=pa.int32()))
    arrays.append(pa.array(cols[18], type=pa.int32()))
    arrays.append(pa.array(cols[19], type=pa.int32()))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


STATUS = "__file__"


def _status_row(n_rows: int, e: Exception | None = None):
    """The status of one file; ``n_values`` is the number of its node rows."""
    if e is None:
        return (-1, None, 0, "ok", None, STATUS, None, None, None, None, None, None, None, n_rows, None, (), (), 0, 0, None)
    return (-1, None, 0, "error", None, STATUS, type(e).__name__, None, getattr(e, "lineno", None), None, None, None,
            str(e), 0, None, (), (), 0, 0, None)


def _emit(held):
    """The batch of (repo, path, rows) files, each of which has its status row
    at least.  If the conversion fails, file by file, so that only the file at
    fault becomes an error."""
    try:
        repos = [r for r, _, rows in held for _ in rows]
        paths = [p for _, p, rows in held for _ in rows]
        yield _batch(repos, paths, [row for _, _, rows in held for row in rows])
    except Exception as e:  # noqa: BLE001 - one bad file never fails the job
        if len(held) > 1:
            for one in held:
                yield from _emit([one])
        else:
            yield _batch([held[0][0]], [held[0][1]], [_status_row(0, e)])


def _flatten_batches(batches, flush_rows: int = 50_000, all_nodes: bool = False, facts: str | tuple[str, ...] | None = None,
                     exact: bool = False):
    import gc
    for batch in batches:
        held, size = [], 0
        # the walk allocates millions of short-lived, cycle-free tuples:
        # pause the cyclic collector for the batch (refcounting frees them)
        gc_on = gc.isenabled()
        gc.disable()
        try:
            for repo, path, content in zip(*(batch.column(c) for c in ("repo", "path", "content"))):
                content = content.as_py()
                if content is None:
                    continue
                try:
                    rows = _flatten_one(content, all_nodes, facts, exact)
                    rows.append(_status_row(len(rows)))
                except Exception as e:  # noqa: BLE001 - one bad file never fails the job
                    rows = [_status_row(0, e)]
                held.append((repo.as_py(), path.as_py(), rows))
                size += len(rows)
                if size >= flush_rows:
                    yield from _emit(held)
                    held, size = [], 0
            if held:
                yield from _emit(held)
        finally:
            if gc_on:
                gc.enable()


def py_nodes(files: DataFrame, all_nodes: bool = False, facts: str | tuple[str, ...] | None = None, exact: bool = False) -> DataFrame:
    """Flatten every Python file of ``files`` into syntax-node rows.

    The flatten is a narrow ``mapInArrow`` stage over the scan splits: no
    shuffle of file text.  All rows of one file come out of one task.

    ``facts`` names the groups of ``FACTS`` whose operators read the table, one
    or several.  Its positions order the nodes of a file as ever; where they
    are reported, ``exact`` makes them those of the whole table.
    """
    src = (files.filter((F.col("language") == "python") & F.col("content").isNotNull())
                .select("repo", "path", "content"))
    return src.mapInArrow(lambda it: _flatten_batches(it, all_nodes=all_nodes, facts=facts, exact=exact), PY_NODES_SCHEMA)


def parse_errors(nodes: DataFrame) -> DataFrame:
    """Files that could not be parsed (A8), with the error text."""
    return nodes.filter((F.col("kind") == STATUS) & (F.col("field") == "error")).select(
        "repo", "path", F.col("name").alias("error"), F.col("lineno").alias("line"),
        F.col("text").alias("message"))


def file_status(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for every file of the corpus: ``status`` is "undecodable",
    "unreadable" (no content, though it is no binary), "parse error", "no
    facts", "parsed", or "not parsed" for other languages; ``error`` names the
    parser's exception."""
    status = nodes.filter(F.col("kind") == STATUS).select("repo", "path", F.col("field").alias("state"), F.col("name").alias("error"),
                                                         F.col("n_values").alias("n_facts"))
    s = (F.when(F.col("is_binary"), "undecodable").when(~F.col("readable"), "unreadable").when(F.col("language") != "python", "not parsed")
         .when(F.col("state") == "error", "parse error").when(F.col("n_facts") == 0, "no facts").when(F.col("state") == "ok", "parsed"))
    return (files.select("repo", "path", "language", "is_binary", F.col("content").isNotNull().alias("readable"))
            .join(status, ["repo", "path"], "left").select("repo", "path", "language", s.alias("status"), "error"))
