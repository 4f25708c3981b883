"""Brute-force helpers of the tests in this folder."""

import random
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EN = "the of and to in is that for it on with as was be by this are from or an".split()
DE = "der die und das ist nicht ein eine mit auf für von zu den dem sich auch über".split()
# extra columns whose names clash with what operators use inside
CLASHING = "doc_id long, text string, n long, key long, rid long, label long, kept boolean, score double, w string, token long, row long, part long, ids binary"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def remainder(doc_id, divisor):
    return zlib.crc32(str(doc_id).encode()) % divisor


def sentence(rnd, n, source=EN, invent=0.4):
    made = lambda: "".join(rnd.choice("ab ec id of ug ra te lo mi nu".split()) for _ in range(rnd.randint(2, 4)))
    return " ".join(made() if rnd.random() < invent else rnd.choice(source) for _ in range(n))


def documents(seed=7, n=60):
    """Texts with copies, near copies, shared passages and odd cases."""
    rnd = random.Random(seed)
    out, passage = [], sentence(rnd, 60)
    for _ in range(n):
        out.append(sentence(rnd, rnd.randint(20, 300), EN if rnd.random() < 0.6 else DE))
    base = sentence(rnd, 200)
    for i in range(25):  # near copies of differing nearness
        w = base.split(" ")
        for _ in range(i % 9):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(1000)}"
        out.append(" ".join(w))
    out += [base] * 5 + [base.upper(), "  " + base.replace(" ", "\n\t") + " "]
    out += [f"{passage} {sentence(rnd, 80)}" for _ in range(6)]
    out += [None, "", "   \n\t", "one", "one two three four", "one two three four", "One Two three four five", "a b c d e f", "a\x1cb c\x85d e\xa0f g",
            "日本 語 — ñandú ÉCOLE", "x" * 5000, " ".join(["same"] * 300), "<|endoftext|> and </s> <unk>", "🙂 🙂🙂 é ​"]
    out.append(" ".join(sentence(rnd, 400) for _ in range(20)))
    return out


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
