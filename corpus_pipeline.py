"""From raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and is stored before the next one reads it.  All
but the last return the columns of documents; a column that a stage does not work on passes through, null rows included.  How
each stage treats odd rows is said in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartwave.llm import decontaminate, neardup, packing, quality, secrets
from cartwave.llm.common import table
from cartwave.session import cut


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones outside the held-out fold, accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.without_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences."""
    return packing.pack(docs, packing.public_coder())


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secret_masking),
    ("packing", best_fit_packing),
]

# models, sketches and the genetic search are not expressed in SQL; the tests hold every stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
