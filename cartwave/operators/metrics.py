"""Scores of predictions, each as one small aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwave.functions.geo import haversine
from cartwave.operators.ranking import sorted_runs


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def class_scores(
    df: DataFrame, groups: Sequence[str] = (), target: str = "target", pred: str = "prediction"
) -> DataFrame:
    """Accuracy, recall and AUC of hard 0/1 predictions: (TPR + TNR) / 2."""
    t, p = F.col(target), F.col(pred)
    counts = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        _count((t == 1) & (p == 1)).alias("tp"),
        _count((t == 1) & (p != 1)).alias("fn"),
        _count((t == 0) & (p == 0)).alias("tn"),
        _count((t == 0) & (p != 0)).alias("fp"),
    )
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = _ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return counts.select(
        *groups,
        "n",
        _ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        recall.alias("recall"),
        ((recall + specificity) / 2).alias("auc"),
    )


def rank_auc(df: DataFrame, groups: Sequence[str], score: str, target: str = "target") -> DataFrame:
    """``rank_auc`` per group: the chance that a row of class 1 has a larger score than one of class 0, ties count half.

    From the mean ranks of runs of equal scores; 0 for a group that lacks a class, as for the other scores.
    """
    keys = [*groups, score]
    ones = df.where(F.col(score).isNotNull()).groupBy(*keys).agg(_count(F.col(target) == 1).alias("_ones"))
    runs = sorted_runs(df, groups, score).join(ones, keys)
    sums = runs.groupBy(*groups).agg(
        F.sum("_ones").cast("double").alias("p"),
        F.sum(F.col("n") - F.col("_ones")).cast("double").alias("q"),
        F.sum(F.col("_ones") * (F.col("rank_from") + (F.col("n") + 1) / 2)).alias("r"),
    )
    above = F.col("r") - F.col("p") * (F.col("p") + 1) / 2
    return sums.select(*groups, _ratio(above, F.col("p") * F.col("q")).alias("rank_auc"))


def fold_scores(df: DataFrame, groups: Sequence[str] = (), fold: str = "fold", score: str | None = None) -> DataFrame:
    """Mean and population deviation of the scores over folds; with ``score`` also those of its rank AUC."""
    per_fold = class_scores(df, [*groups, fold])
    names = ["recall", "accuracy", "auc"]
    if score is not None:
        per_fold = per_fold.join(rank_auc(df, [*groups, fold], score), [*groups, fold])
        names.append("rank_auc")
    aggs = []
    for s in names:
        aggs += [F.avg(s).alias(f"{s}_mean"), F.stddev_pop(s).alias(f"{s}_std")]
    return per_fold.groupBy(*groups).agg(*aggs)


def prediction_distribution(
    df: DataFrame, target: str = "target", pred: str = "prediction", wrong_by_truth: bool = False
) -> DataFrame:
    """Right and wrong counts per class, wrong ones by the predicted class."""
    right = F.col(target) == F.col(pred)
    wrong_label = F.col(target) if wrong_by_truth else F.col(pred)
    return (
        df.withColumn("correct", right.cast("int"))
        .withColumn("label", F.when(right, F.col(target)).otherwise(wrong_label).cast("long"))
        .groupBy("correct", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distribution_maps(distribution: DataFrame) -> DataFrame:
    """One row: totals and class-count maps; classes of a binary target are few."""
    def entries(flag: int) -> Column:
        return F.map_from_entries(
            F.sort_array(
                F.collect_list(F.when(F.col("correct") == flag, F.struct("label", "n")))
            )
        )

    return distribution.agg(
        F.coalesce(F.sum(F.when(F.col("correct") == 1, F.col("n"))), F.lit(0)).alias("correct"),
        F.coalesce(F.sum(F.when(F.col("correct") == 0, F.col("n"))), F.lit(0)).alias("error"),
        entries(1).alias("correct_counts"),
        entries(0).alias("error_counts"),
    )


def regression_scores(
    df: DataFrame, groups: Sequence[str] = (), target: str = "target", pred: str = "prediction", exact: bool = False
) -> DataFrame:
    """Explained variance, mean absolute and mean squared error.

    ``exact`` sums errors as decimals of six places, so that the order of rows does not show in the result.
    """
    err = F.col(target) - F.col(pred)
    if exact:
        err = err.cast("decimal(18,6)")
    spread = F.var_pop(F.col(target))
    mean = lambda c: F.sum(c).cast("double") / F.count(c)
    return df.groupBy(*groups).agg(
        F.coalesce(1 - F.try_divide(F.var_pop(err), spread), F.lit(0.0)).alias("evs"),
        mean(F.abs(err)).alias("mae"),
        mean(err * err).alias("mse"),
    )


def top_values(df: DataFrame, value: str, k: int, name: str = "n") -> DataFrame:
    """The ``k`` most frequent values; ties go to the smaller value."""
    return (
        df.groupBy(value)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.col(name).desc(), F.col(value))
        .limit(k)
    )


def top_cell_scores(
    df: DataFrame, target: str = "target", pred: str = "prediction", k: int = 10
) -> DataFrame:
    """Recall, precision and F over the ``k`` most predicted cells, and accuracy.

    One pass turns each record into its predicted cell, its true cell and, if they
    agree, a hit; the per-cell counts are small.
    """
    hit = (F.col(target) == F.col(pred)).cast("long")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col(pred).cast("long").alias("cell"), one.alias("p"), none.alias("t"), hit.alias("h")),
        F.struct(F.col(target).cast("long").alias("cell"), none.alias("p"), one.alias("t"), none.alias("h")),
    )
    cells = (
        df.select(F.explode(sides).alias("s"))
        .groupBy("s.cell")
        .agg(F.sum("s.p").alias("p"), F.sum("s.t").alias("t"), F.sum("s.h").alias("h"))
    )
    total = cells.agg(_ratio(F.sum("h"), F.sum("p")).alias("a")).scalar()
    top = cells.where("p > 0").orderBy(F.col("p").desc(), "cell").limit(k)
    sums = top.agg(F.sum("h").alias("h"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    r, p = _ratio(F.col("h"), F.col("t")), _ratio(F.col("h"), F.col("p"))
    return sums.select(
        r.alias("recall"),
        _ratio(2 * r * p, r + p).alias("f"),
        p.alias("precision"),
        total.alias("accuracy"),
    )


def with_distance(
    df: DataFrame,
    pred_lat: str = "pred_latitude",
    pred_lon: str = "pred_longitude",
    lat: str = "Latitude_m",
    lon: str = "Longitude_m",
) -> DataFrame:
    """Add ``dist``, the error in metres."""
    away = haversine(F.col(pred_lat), F.col(pred_lon), F.col(lat), F.col(lon))
    return df.withColumn("dist", away)


def error_range(df: DataFrame, groups: Sequence[str], value: str = "dist") -> DataFrame:
    return df.groupBy(*groups).agg(
        F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count(value).alias("n")
    )


def first_of_group(df: DataFrame, groups: Sequence[str], by: str, k: int) -> DataFrame:
    """The ``k`` smallest distinct ``by`` values per group."""
    order = Window.partitionBy(*groups).orderBy(by)
    return (
        df.select(*groups, by)
        .dropDuplicates()
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k)
        .drop("_r")
    )
