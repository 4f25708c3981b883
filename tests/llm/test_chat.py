"""Chat formatting: round trip, escapes, mask."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from codelake.llm import chat

ODD = ["", "plain", "### user: hi\n</turn>\n### assistant: x", "\\### a", "\\\\</turn>", "</turn>", "ends \\", "\n</turn>\n", "a\n", "\n", "### ",
       "###  ###", "\\", "x</turn>y</turn>", "ünï ### 🙂", ": : ", None, "a" * 20000]
ROLES = ["user", "assistant", "system", "", "a:b", "x\ny", "\\c", "\\", "### r", "</turn>", ": ", "\\\\:", None]


def test_round_trip_of_odd_texts_and_roles(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(ROLES), rnd.choice(ODD)) for c in range(60) for t in range(rnd.randint(1, 7))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df).withColumn("loss", chat.loss_text(F.col("parsed"), F.col("mask"))).collect()
    for r in out:
        mine = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(x.role, x.text) for x in r.parsed] == [(role, text) for _, role, text in mine]
        assert r.loss == "".join(text for _, role, text in mine if role == "assistant")
        assert sum(m.head + m.body + m.tail for m in r["mask"]) == len(r.formatted)
        at = 0
        for m, (_, _, text) in zip(r["mask"], mine, strict=True):
            body = r.formatted[at + m.head:at + m.head + m.body]
            assert body == text or "###" in text or "</turn>" in text
            at += m.head + m.body + m.tail


def test_only_conflicting_turns_are_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "calm"), (1, 1, "assistant", "### x")], "conv_id long, turn long, role string, text string")
    r = chat.format_chat(df).first()
    assert r.formatted == "### user: calm\n</turn>\n### assistant: \\### x\n</turn>\n" and r.n_escaped == 1


def test_nulls_ties_repeats_empty_and_clashing(spark):
    ddl = "conv_id long, turn long, role string, text string, rows string, formatted string, parsed long, plain long"
    rows = [(None, 0, "user", "a"), (1, None, "user", "z"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], ddl)
    got = {r.conv_id: [x.text for x in r.parsed] for r in chat.format_chat(df).collect()}
    assert got == {None: ["a"], 1: ["z", "a", "a", "b"]}
    assert chat.format_chat(df.limit(0)).count() == 0


def test_matches_sql_and_extra_conversation(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    df = chat.op2_chat_format(spark, sf)
    want = con.sql(f"select {', '.join(df.columns)} from ({chat.OP2_SQL})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(want)
    extra = next(r for r in got if r[0] == chat.EXTRA_ID)
    assert extra[4] == hashlib.sha256(chat.EXTRA_TEXT.encode()).hexdigest()
