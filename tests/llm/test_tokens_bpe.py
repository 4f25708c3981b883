"""Token counts, BPE and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASHING, documents, frame

from codelake.llm import bpe, packing, tokens

TEXTS = documents(11, 20)


@pytest.fixture(scope="module")
def piece_model():
    return tokens.load(tokens.tokenizer_path(tokens.MODEL))


def library(name):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.tokenizer_path(name))


def test_counts_equal_the_library(spark, piece_model):
    df = tokens.token_counts(frame(spark, TEXTS), tokens.tokenizer_path(tokens.MODEL), chunk=500, overlap=16)
    for r in df.collect():
        t = TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(piece_model.encode(t)))
        assert r.over_limit == (r.n_tokens > 4096)


def test_resynchronisation_on_hard_texts(piece_model):
    rnd = random.Random(2)
    hard = ["ab" * 4000 + " c d", " " * 3000 + "a", "x\n" * 3000, "▁a " * 2000, "a  b   " * 900, "日本語" * 900 + " x",
            "".join(rnd.choice("ab \n▁é🙂") for _ in range(6000)), " ".join("w" * rnd.randint(1, 300) for _ in range(60))]
    for t in hard + [t for t in TEXTS if t and len(t) > 400]:
        for chunk, overlap in ((300, 8), (1000, 64)):
            assert tokens.count_long(piece_model, t, chunk, overlap) == len(piece_model.encode(t))


def test_bpe_equals_the_library(spark):
    path, lib = tokens.tokenizer_path(bpe.VOCABULARY), library(bpe.VOCABULARY)
    spaces = ["a" + chr(c) + " b" + chr(c) * 2 + "c" for c in [*range(0x21), *range(0x7F, 0xA2), 0x1680, *range(0x2000, 0x2030), 0x3000]]
    texts = TEXTS + spaces + ["<|endoftext|>a<|endoftext|> b", "it's 'll we'Ve", "  lead", "trail  ", "x" * 200 + " y"]
    df = frame(spark, texts)
    ids = {r.doc_id: list(r.ids) for r in bpe.bpe_encode(df, path).collect()}
    back = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()}
    digests = {r.doc_id: r for r in bpe.bpe_digests(df, path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        decoded = lib.decode(want, skip_special_tokens=False)
        assert ids[i] == want and back[i] == decoded == (t or "")
        assert tuple(digests[i])[1:] == (len(want), sha(",".join(map(str, want))), sha(decoded))


def test_decode_of_broken_bytes(spark):
    path, lib = tokens.tokenizer_path(bpe.VOCABULARY), library(bpe.VOCABULARY)
    ids = [[i] for i in range(0, 400)] + [[], None]
    df = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    for r in bpe.bpe_decode(df, path).collect():
        assert r.text == lib.decode(ids[r.doc_id] or [], skip_special_tokens=False)


def check_packing(rows, texts, window):
    lib = library(packing.VOCABULARY)
    ids = [lib.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[d][at:at + r.length], dtype="<u4")
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d]) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0


@pytest.mark.parametrize("window,n_open,parts", [(64, 2, 3), (128, 16, 9), (4096, 16, 1)])
def test_packing(spark, window, n_open, parts, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_GROUP", 2)
    df = frame(spark, TEXTS).repartition(parts)
    check_packing(packing.pack(df, tokens.tokenizer_path(packing.VOCABULARY), window, n_open).collect(), TEXTS, window)


def test_packed_ids_are_given_on_request(spark):
    df = frame(spark, TEXTS[:9])
    for r in packing.pack(df, tokens.tokenizer_path(packing.VOCABULARY), 64, with_ids=True).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32


def test_word_ids_forget_and_learn_again():
    w, lib = packing.WordIds(tokens.tokenizer_path(packing.VOCABULARY)), library(packing.VOCABULARY)
    w.words.size = 20
    texts = [t or "" for t in TEXTS]
    for part in (texts[:1], texts, [], ["", " "], *([t] for t in texts)):
        ids, first = w.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in part]
    ids, first = w.encode(pa.array(texts).slice(3, 9))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids for t in texts[3:12]]


def test_null_ids_repeats_empty_and_clashing(spark):
    rows = [(1, "a b", *([None] * 11)), (1, "a b", *([None] * 11)), (None, None, *([None] * 11))]
    df = spark.createDataFrame(rows, CLASHING)
    count = tokens.token_counts(df, tokens.tokenizer_path(tokens.MODEL))
    digest = bpe.bpe_digests(df, tokens.tokenizer_path(bpe.VOCABULARY))
    packed = packing.pack(df, tokens.tokenizer_path(packing.VOCABULARY))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in count.collect()) == [(0, 0), (1, 2), (1, 2)]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in digest.collect()) == [(0, 0), (1, 2), (1, 2)]
    assert sum(r.length for r in packed.collect()) == 7
    for f, name in ((tokens.token_counts, tokens.MODEL), (bpe.bpe_digests, bpe.VOCABULARY), (packing.pack, packing.VOCABULARY)):
        assert f(df.limit(0), tokens.tokenizer_path(name)).count() == 0
