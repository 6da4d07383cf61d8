"""A training-data pipeline over ``documents`` from five operators of ``textloom.llm``.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all rows
that the one before it kept; what it returns is written as Parquet in the shared
folder and read again as the next one's docs, and what it staged itself is
deleted then.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, decontamination, factorisation, near_duplicates, pseudonyms
from textloom.llm.common import table, temporaries


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine accepts."""
    return factorisation.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), shortest=1)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts."""
    return pseudonyms.replaced(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of all documents."""
    return bpe.encoded(docs).drop("decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicate), ("decontamination", benchmark), ("pii", pii), ("bpe", encoding)]

#: The stages are not expressible in SQL; ``tests/llm`` holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporaries(spark) as kept:
            docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
