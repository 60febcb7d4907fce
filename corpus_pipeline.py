"""From raw documents to token ids: quality rules, exact and near dedup, mixing, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
gives a DataFrame, which is written as Parquet and read again as the next one's
docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrove.llm import op1_repetition, op5_bpe, op6_ngram_join, op8_radix_dedup, op10_mixing
from lexgrove.llm.common import held, release, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without excessive repetition."""
    return op1_repetition.keep_rows(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return op8_radix_dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return op6_ngram_join.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return op10_mixing.mixed_rows(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return op5_bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("ngram jaccard join", near_dedup),
    ("mixing to target weights", mixing),
    ("byte-level BPE", byte_bpe),
]

#: Suffix arrays and BPE merges have no sensible SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents that all stages keep; tables of earlier stages are removed as it goes."""
    docs, before = table(spark, sf_dir, "documents"), held()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, keep=docs, since=before)
    return docs
