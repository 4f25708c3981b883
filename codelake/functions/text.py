"""Column expressions for path and text handling (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codelake.functions import constants as K

# --- FIXED VALUE: the characters that Python's str.strip() removes
PY_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
            "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.btrim(col(c), F.lit(PY_SPACE))


def py_lstrip_chars(c, chars: str) -> Column:
    """``str.lstrip(chars)``."""
    return F.ltrim(col(c), F.lit(chars))


def py_rstrip_chars(c, chars: str) -> Column:
    """``str.rstrip(chars)``."""
    return F.rtrim(col(c), F.lit(chars))


def py_strip_chars(c, chars: str) -> Column:
    """``str.strip(chars)``."""
    return F.btrim(col(c), F.lit(chars))


def base_name(path) -> Column:
    """Last path component."""
    return F.substring_index(col(path), "/", -1)


def parent_dir(path) -> Column:
    """Directory part of a relative path ('' at the root)."""
    p = col(path)
    return F.when(F.locate("/", p) > 0, F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def suffix(name) -> Column:
    """``Path.suffix.lower()``: last '.xxx' of the name; names that start with a
    dot and have no other dot have no suffix."""
    return F.lower(F.regexp_extract(col(name), r"^.+(\.[^.]*)$", 1))


def language_of(name) -> Column:
    """Extension -> language lookup with 'unknown' default (B1)."""
    m = F.create_map(*[F.lit(x) for kv in K.EXTENSION_LANGUAGE.items() for x in kv])
    return F.coalesce(F.element_at(m, suffix(name)), F.lit(K.UNKNOWN_LANGUAGE))


def is_ignored(path) -> Column:
    """Ignore rule on a *relative* path (B2, ledger Q2): any component is an
    ignore name or starts with a dot."""
    parts = F.split(col(path), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in K.IGNORE_NAMES])) | \
        F.exists(parts, lambda p: p.startswith("."))


# --- FIXED VALUE: the line ends of Python's ``str.splitlines()`` besides CR
LINE_ENDS = "[\\n\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def split_lines(c) -> Column:
    """``str.splitlines()`` after newline normalisation: no line follows the
    last line end."""
    parts = F.split(col(c), LINE_ENDS, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def newline_normalise(c) -> Column:
    """Text-mode reading: CRLF and lone CR become LF (A2)."""
    return F.regexp_replace(col(c), "\r\n?", "\n")


def count_sub(c, literal: str) -> Column:
    """Non-overlapping substring count (``str.count``)."""
    import re
    return F.regexp_count(col(c), F.lit(re.escape(literal)))

