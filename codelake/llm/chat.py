r"""Chat formatting with a grammar round trip, in built-in functions only.

Template, one turn after the other::

    ### role: text
    </turn>

``### `` and ``</turn>`` are control strings; a backslash before one makes it
plain text.  Each turn is rendered as it is and reparsed by the grammar; where
the parse does not give back the turn, the text is escaped (one more backslash
before every control string, whatever backslashes stand there already, so
that the parser's removal of one is its inverse) and the escaped rendering is
reparsed in turn.  The whole conversation is parsed again at the end, and a
difference from the source is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm.common import read

OPEN, CLOSE = "### ", "</turn>"
_CONTROL = r"(\\*)(### |</turn>)"
_FREE = r"(?<!\\)(?:### |</turn>)"       # a control string that is not escaped
_END = r"\n</turn>\n"                   # inside a text it would be escaped
# characters of a role that would end it early
_ROLE_OUT = [("\\", "\\\\"), (":", "\\c"), ("\n", "\\n"), ("#", "\\h"), ("<", "\\l")]


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1$2")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(### |</turn>)", "$1$2")


def _role_out(role: Column) -> Column:
    for a, b in _ROLE_OUT:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _role_in(role: Column) -> Column:
    # a mark that no role can hold after escaping keeps doubled backslashes apart
    parts = F.split(role, r"\\\\")
    def back(x):
        for a, b in reversed(_ROLE_OUT[1:]):
            x = F.replace(x, F.lit(b), F.lit(a))
        return x
    return F.array_join(F.transform(parts, back), "\\")


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), _role_out(role), F.lit(": "), body, F.lit("\n" + CLOSE + "\n"))


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation.  What does not
    follow the grammar parses to a turn of null role and text.

    Ends of turns are free ``</turn>`` strings between newlines; within a
    segment the role runs to the first ``: ``, and a free control string in
    the rest breaks the grammar.
    """
    segments = F.split(formatted, _END)
    # the text behind the last end must be empty
    segments = F.when(F.element_at(segments, -1) == "", F.slice(segments, 1, F.size(segments) - 1)).otherwise(segments)
    return F.transform(segments, _turn)


def _turn(segment: Column) -> Column:
    at = F.locate(": ", segment)
    role = F.substring(segment, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
    body = F.substring(segment, at + 2, F.length(segment))
    fine = segment.startswith(OPEN) & (at > len(OPEN)) & ~body.rlike(_FREE)
    return F.struct(F.when(fine, _role_in(role)).alias("role"), F.when(fine, _unescape(body)).alias("text"))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, parsed (the turns read
    back from ``formatted``), mask (array<struct<head, body, tail, loss>>: for
    every turn the code points of ``formatted`` before, in and after its text,
    and whether the text takes loss, as those of ``loss_role`` do), n_escaped (turns whose text had to be escaped).

    Defined cases: null role or text is empty; turns are ordered by turn
    number, nulls first, ties by role and text; repeated rows are turns each;
    a null conv_id is one conversation of its own; an empty table gives no
    rows.  Other columns are not read.  A conversation is one value of the
    result, so its size is what bounds a task.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # turn by turn: as it is, or escaped if that does not come back
    back = parse_chat(_render(F.col("role"), F.col("text")))
    plain = (F.size(back) == 1) & back[0]["role"].eqNullSafe(F.col("role")) & back[0]["text"].eqNullSafe(F.col("text"))
    t = t.withColumn("plain", plain)
    t = t.withColumn("body", F.when(F.col("plain"), F.col("text")).otherwise(_escape(F.col("text"))))
    t = t.select("conv_id", F.struct("turn", "role", "text", _render(F.col("role"), F.col("body")).alias("rendered"),
                                     F.length("body").cast("long").alias("n_body"), "plain").alias("row"))
    c = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    c = c.withColumn("formatted", F.array_join(F.col("rows.rendered"), ""))
    c = c.withColumn("parsed", parse_chat(F.col("formatted")))
    source = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))
    tail = len(CLOSE) + 2
    mask = F.transform("rows", lambda r: F.struct(
        (F.length(r["rendered"]) - r["n_body"] - tail).cast("long").alias("head"), r["n_body"].alias("body"),
        F.lit(tail).cast("long").alias("tail"), (r["role"] == loss_role).alias("loss")))
    checked = F.when(F.col("parsed") == source, F.col("formatted")).otherwise(F.raise_error(F.concat(
        F.lit("chat round trip failed for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    return c.select("conv_id", checked.alias("formatted"), "parsed", mask.alias("mask"),
                    F.size(F.filter("rows", lambda r: ~r["plain"])).cast("long").alias("n_escaped"))


def loss_text(parsed: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped and put together: the turns
    that the parser read, where the mask's run of the turn is set."""
    marked = F.filter(F.arrays_zip(parsed.alias("turn"), mask.alias("run")), lambda x: x["run"]["loss"])
    return F.array_join(F.transform(marked, lambda x: x["turn"]["text"]), "")


# the conversation that the contract adds: both of its texts hold control strings
EXTRA_ID, EXTRA_TEXT = -7, r"\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(EXTRA_TEXT).alias("text"))
    c = format_chat(turns.unionByName(extra)).withColumn("loss", loss_text(F.col("parsed"), F.col("mask")))
    text = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"))


# per turn: "### ", role, ": ", text, a backslash per control string, "\n</turn>\n"
OP2_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}'
  UNION ALL SELECT {EXTRA_ID}, 1, 'assistant', '{EXTRA_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(length(role) + length(text) + 15 + len(regexp_extract_all(text, '### |</turn>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
