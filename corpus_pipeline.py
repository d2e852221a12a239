"""The corpus pipeline: from raw documents to packed sequences, one operator a stage.

Every stage takes (spark, docs, sf_dir) and returns a table, which run() writes as Parquet into the shared folder and
reads again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import common, decontamination, langid, ngram_join, packing, queries, suffix_dedup


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Columns as documents has them; n_chars, if there, says the length of the text as it is now."""
    return df.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on a sample of the labelled ones."""
    return langid.accepted(docs, langid.train(docs, common.crc32_fold("doc_id", 5) != 0))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 on five-word shingles, the one of least doc_id."""
    return ngram_join.one_of_each(docs, num=4, den=5, n=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a 100-byte string repeats from earlier ones; texts of which nothing is left go."""
    return _as_documents(suffix_dedup.cleaned(docs, window=100), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, *queries.tokenizer())


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisation and the trained model are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with common.passing():  # a stage's scratch tables go as soon as its output stands
            docs = common.written(stage(spark, docs, sf_dir), name, outside=True)
    return docs
