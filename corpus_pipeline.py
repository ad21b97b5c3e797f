"""Corpus pipeline: documents -> quality -> exact dedup -> near-dedup -> decontamination -> token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikehaz.llm import decontaminate, exact_dedup, piece_codec, quality, simhash
from strikehaz.llm.common import stored_table, table
from strikehaz.llm.queries import piece_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.trained(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the smallest id."""
    return exact_dedup.exact_kept(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return simhash.near_kept(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each text, and of the text decoded from them."""
    return piece_codec.encoded(docs, piece_model(), keep=False)


STAGES = [
    ("quality classifier", quality_stage), ("exact dedup", exact_stage), ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage), ("SentencePiece tokens", token_stage),
]

#: The learnt classifier and the fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
