"""Targets taken from the month after the feature window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cartwave.sources.trade import in_months


def bought(trade: DataFrame, month: int, keys: Sequence[str]) -> DataFrame:
    """Keys seen in the label month, with target 1."""
    rows = in_months(trade, month)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.select(*keys).distinct().withColumn("target", F.lit(1))


def spent(trade: DataFrame, month: int) -> DataFrame:
    """Amount per user in the label month, from the log or the month cube."""
    amount = F.sum("amt") if "amt" in trade.columns else F.sum("a").cast("decimal(38,2)") / 100
    return (
        in_months(trade, month)
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(amount.cast("double").alias("target"))
    )


def target_counts(df: DataFrame, target: str = "target") -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def distinct_entities(trade: DataFrame, months: Sequence[int], key: str) -> DataFrame:
    return in_months(trade, months).select(key).distinct()
