"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# rows whose crc32 of the id leaves this remainder are held out of training
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand texts to Python in batches of so many rows, so that neither side holds many at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def held_out(key: str = "doc_id") -> Column:
    """True for rows that no model may learn from; a null id is not held out."""
    rest = F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(FOLDS)
    return F.coalesce(rest == F.lit(HELD_OUT), F.lit(False))


def full_text(name: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def span_list(name: str = "spans") -> Column:
    """``kind:start:end`` of each struct in the array ``name``, comma-joined in its order."""
    return F.array_join(
        F.transform(
            F.col(name),
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows a model may learn from.

    Null ids and labels outside 0 and 1 are left out, and so are ids whose rows disagree; repeated rows count once.
    """
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_high"))
        .where(F.col("label") == F.col("_high"))
        .drop("_high")
    )
