"""A corpus clean-up pipeline: STAGES in order, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir), docs having the columns of ``documents``, and returns a DataFrame,
which is written as Parquet and read again as the next one's docs.  All but the last return the columns
of ``documents``; the last returns the encoding's digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodegrain.llm import bpe, decontaminate, language_id, ngram_join, substring_dedup
from lodegrain.llm.common import discard, settle, table, work_path
from lodegrain.llm.registry import TOKENIZER


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those in no language that was learnt from the labelled ones.  Where no document
    has a label nothing is learnt and nothing is decided: all stay."""
    model = language_id.fit(docs)
    if model is None:
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    found = language_id.identify(docs.toDF(*names), model, at["doc_id"], at["text"], keep=tuple(n for n in names if n != at["doc_id"]), learnt_only=True)
    return found.where("lang_pred <> 'und'").select(*names).toDF(*docs.columns)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return substring_dedup.remove_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    settle(spark)
    return bpe.encode_documents(docs, TOKENIZER)


STAGES = [
    ("language ID", by_language),
    ("n-gram Jaccard join", one_of_similar),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding", encoded),
]

#: Training, components and tokenization are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; what a stage returned goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, step) in enumerate(STAGES):
        path = work_path(spark, f"pipeline-{k}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, before)
        before = path
    return docs
