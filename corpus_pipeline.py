"""The corpus pipeline: toxicity, line deduplication, similarity join, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's documents. All but the last return the columns of
``documents``. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, line_dedup, ngram_join, suffixes, toxicity
from assayer.llm.common import staged, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.without_toxic(docs, docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in three or more; ``n_chars`` counts what is left."""
    out = line_dedup.dedup_lines(docs).drop("ld_lines", "ld_dropped")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def similarity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, a similarity of 0.8)."""
    return ngram_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the number and digest of their ids and the digest of the decoded text."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", similarity_stage),
    ("decontamination", benchmark_stage),
    ("bpe", encoding_stage),
]

#: Classifiers and byte-pair encoding can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
