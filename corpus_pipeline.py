"""A corpus pipeline of four of the operators: quality classifier, language
identification, near-duplicates, packing.

Each stage works on all rows that its predecessor kept, written as Parquet and
read again.  All but the last return rows of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codelake.llm import classifier, langid, minhash, packing
from codelake.llm.common import read, stage
from codelake.llm.tokens import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier, learned from the
    texts at hand and ``labels``, does not reject (score of 0.5 or more)."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = classifier.train(classifier.training(docs), classifier.training(labels))
    return classifier.keep_quality(docs, model)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined: they have a letter, one language
    has at least half of the posterior, and they are no rarer in it, a
    character, than what was learned as that language."""
    path, learned = tokenizer_path(langid.VOCABULARY), langid.training(docs)
    model = langid.train_languages(learned, path)
    return langid.keep_identified(docs, model, path, least_rates=langid.floors(learned, model, path))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: five-word shingles, a
    similarity of 0.8 or more."""
    return minhash.one_of_each(docs, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    return packing.pack(docs, tokenizer_path(packing.VOCABULARY)).drop("ids")


STAGES = [("quality_classifier", quality_classifier), ("language_id", language_id), ("minhash_dedup", minhash_dedup), ("packing", pack)]

# the classifier, the language model and the tokenizer cannot be said in SQL:
# tests/llm/test_pipeline.py compares the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
