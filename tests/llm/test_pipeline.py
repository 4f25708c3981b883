"""The pipeline's stages against brute force on a small table."""

import random

import corpus_pipeline
from helpers import DE, EN, documents, sentence
from test_minhash import brute
from test_tokens_bpe import check_packing

import __spark_entry__
from codelake.llm import classifier, langid
from codelake.llm.tokens import tokenizer_path


def table(spark, folder):
    rnd = random.Random(3)
    rows = [(i, t, None, "s", 0) for i, t in enumerate(documents(21, 30))]
    n = len(rows)
    rows += [(n + i, sentence(rnd, 60, EN if i % 2 else DE, 0.2), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    rows += [(n + 80 + i, sentence(rnd, 60, [w.upper() + "!!" for w in EN], 0), "en", "s", 0) for i in range(15)]
    rows += [rows[5], (None, sentence(rnd, 60, EN), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(n, n + 80, 2)] + [(i, 0, 0) for i in range(n + 80, n + 95, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    rows = table(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        before, docs = docs, spark.read.parquet(f"{sf}/{name}")
        kept[name] = (before.collect(), docs.collect())
    b, a = kept["quality_classifier"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    first = spark.read.parquet(f"{sf}/documents.parquet")
    model = classifier.train(classifier.training(first), classifier.training(labels))
    want = [r.doc_id for r in classifier.classify(first, model).collect() if r.score >= 0.5]
    assert sorted(map(str, (r.doc_id for r in a))) == sorted(map(str, want)) and len(b) == len(rows)
    clean = {r[0] for r in rows if r[2] and "!!" not in r[1]}
    assert len(clean & {r.doc_id for r in a}) >= 0.9 * len(clean)
    b, a = kept["language_id"]
    # without a letter, or rarer a character than what was learned
    path = tokenizer_path(langid.VOCABULARY)
    learned = langid.training(spark.read.parquet(f"{sf}/quality_classifier"))
    langs, table_of = model = langid.train_languages(learned, path)
    least = langid.floors(learned, model, path)

    def stays(text):
        low = (text or "").lower().split()
        if not langid._LETTER.search(text or ""):
            return False
        sums = langid.log_probabilities(low, langid.pieces(path), table_of).sum(axis=0)
        n = sum(len(w) + 1 for w in low)
        return sums.max() / n + langid.SHORT / n ** 0.5 >= least[langs[int(sums.argmax())]]
    assert {r.doc_id for r in a} == {r.doc_id for r in b if stays(r.text)}
    assert clean & {r.doc_id for r in b} <= {r.doc_id for r in a}
    assert not any("日本" in (r.text or "") for r in a)
    b, a = kept["minhash_dedup"]
    known = sorted({(r.doc_id, r.text) for r in b if r.doc_id is not None})
    want = [i for i, _, _, stays in brute(known, 80) if stays]
    assert sorted(r.doc_id for r in a if r.doc_id is not None) == want and sum(r.doc_id is None for r in a) == sum(r.doc_id is None for r in b)
    b, a = kept["packing"]
    number = {r.doc_id: i for i, r in enumerate(b)}
    check_packing([_Piece(r, number) for r in a], [r.text for r in b], 4096)


class _Piece:
    def __init__(self, row, number):
        self.__dict__ = row.asDict() | {"doc_id": number[row.doc_id]}


def test_registered(spark):
    q = __spark_entry__.queries()
    assert q["pipeline"] is corpus_pipeline.run and sum(n.startswith("op") and n[2].isdigit() for n in q) == 13
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
