"""Named models with their settings, feature selection and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, functions as F

from cartwave.functions.columns import feature_columns
from cartwave.learners import extra
from cartwave.learners.boosting import BoostedClassifier, BoostedRegressor
from cartwave.learners.neighbours import average, nearest_vectors, vote
from cartwave.session import cut


def to_vectors(
    df: DataFrame, keys: Sequence[str], target: str = "target", features: Sequence[str] | None = None
) -> DataFrame:
    """Keys, target (if any) and one ``features`` vector."""
    cols = list(features) if features is not None else feature_columns(df, keys, target)
    out = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    kept = [*keys, *([target] if target in df.columns else [])]
    return out.select(*kept, "features")


def with_balance(df: DataFrame, target: str = "target") -> DataFrame:
    """Add ``weight`` = rows / (2 * rows of the class), from two counts."""
    n = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("all"),
            F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("ones"),
        ).alias("n")
    ).scalar()
    out = df.withColumn("_n", n)
    mine = F.when(F.col(target) == 1, F.col("_n.ones")).otherwise(
        F.col("_n.all") - F.col("_n.ones")
    )
    return out.withColumn("weight", F.col("_n.all") / (2.0 * mine)).drop("_n")


@dataclass
class Balanced:
    """Fit an estimator with class-balanced weights."""

    estimator: object

    def fit(self, df: DataFrame):
        return self.estimator.copy().setWeightCol("weight").fit(with_balance(df))


@dataclass
class NeighbourModel:
    train: DataFrame
    k: int
    combine: Callable

    def transform(self, df: DataFrame) -> DataFrame:
        arrays = vector_to_array("features").alias("x")
        # every distinct vector is searched once; its copies share the answer
        asked = cut(df.select(arrays).distinct().withColumn("test_id", F.monotonically_increasing_id()))
        # the key orders equal distances only; rows that share it are copies of each other
        known = self.train.select(F.col("target").cast("double").alias("label"), arrays).withColumn("key", F.xxhash64("x", "label"))
        found = self.combine(nearest_vectors(known, asked, self.k), "test_id")
        named = asked.join(found, "test_id", "left").drop("test_id").withColumnRenamed("x", "_x")
        return df.withColumn("_x", vector_to_array("features")).join(named, "_x", "left").drop("_x")


@dataclass
class Neighbours:
    """k nearest neighbours by vector."""

    k: int = 3
    regress: bool = False

    def fit(self, df: DataFrame) -> NeighbourModel:
        return NeighbourModel(df, self.k, average if self.regress else vote)


# fixed values: number of boosting rounds
FULL = {"ada": 50, "gbt": 100, "ada_reg": 60}


def classifiers(task: str = "user_brand", rounds: dict[str, int] = FULL) -> list[tuple[str, object]]:
    """The seven ranked classifiers with the settings of a task."""
    label = {"labelCol": "target", "seed": 6}
    if task == "user":
        forest = Balanced(RandomForestClassifier(numTrees=35, maxDepth=10, **label))
        tree, k = Balanced(DecisionTreeClassifier(maxDepth=10, **label)), 1
    else:
        forest = RandomForestClassifier(numTrees=30, maxDepth=10, featureSubsetStrategy="log2", **label)
        tree, k = Balanced(DecisionTreeClassifier(maxDepth=10, **label)), 3
    return [
        ("RandomForestClassifier", forest),
        ("GradientBoostingClassifier", GBTClassifier(
            maxIter=rounds["gbt"], maxDepth=3, stepSize=0.1, **label)),
        ("BaggingClassifier", RandomForestClassifier(
            numTrees=10, featureSubsetStrategy="all", maxDepth=10, **label)),
        ("AdaBoostClassifier", BoostedClassifier(rounds=rounds["ada"])),
        ("DecisionTreeClassifier", tree),
        ("GaussianNB", NaiveBayes(modelType="gaussian", labelCol="target")),
        ("KNeighborsClassifier", Neighbours(k)),
    ]


def l1_logistic(c: float, rows: int, balanced: bool = False):
    """L1 logistic regression with inverse strength ``c`` on unscaled features; ``rows`` is the number trained on."""
    model = LogisticRegression(
        labelCol="target", elasticNetParam=1.0, regParam=1.0 / (c * rows), maxIter=100, standardization=False
    )
    return Balanced(model) if balanced else model


def buy_models(rows: int) -> list[tuple[str, object]]:
    """The older buy-or-not list: L1 logistic, balanced tree, naive Bayes, forest."""
    label = {"labelCol": "target", "seed": 6}
    return [
        ("LR", l1_logistic(0.9, rows, balanced=True)),
        ("CART", Balanced(DecisionTreeClassifier(maxDepth=10, **label))),
        ("NB", NaiveBayes(modelType="gaussian", labelCol="target")),
        ("RF", RandomForestClassifier(numTrees=10, maxDepth=10, **label)),
    ]


def regressors(rounds: dict[str, int] = FULL) -> list[tuple[str, object]]:
    """Spend models; a depth of 9 stands for the 400-leaf limit."""
    label = {"labelCol": "target", "seed": 12}
    return [
        ("RandomForestRegressor", RandomForestRegressor(
            numTrees=20, featureSubsetStrategy="all", maxDepth=9, **label)),
        ("BaggingRegressor", RandomForestRegressor(
            numTrees=55, featureSubsetStrategy="0.4", maxDepth=7, **label)),
        ("AdaBoostRegressor", BoostedRegressor(rounds=rounds["ada_reg"])),
        # a single tree takes every feature; one-tree forests look at log2 of them
        ("DecisionTreeRegressor", RandomForestRegressor(
            numTrees=1, featureSubsetStrategy="log2", maxDepth=5, subsamplingRate=1.0, **label)),
        ("GradientBoostingRegressor", GBTRegressor(
            maxIter=rounds["gbt"], maxDepth=3, stepSize=0.1, **label)),
        ("KNeighborsRegressor", Neighbours(5, regress=True)),
    ]


def linear(
    kind: str = "linear", alpha: float = 0.5, rows: int = 1, spread: float = 1.0, intercept: bool = True
) -> LinearRegression:
    """Linear, ridge or lasso regression on unscaled features.

    Ridge minimises the sum of squares + alpha |w|^2.  Spark takes half the mean of squares and divides the strength of the square
    by the target's population deviation, so it depends on ``rows``, the number trained on, and ``spread``, that deviation.  Lasso
    minimises half the mean of squares + alpha |w|, as Spark does.
    """
    strength = {"linear": 0.0, "ridge": alpha / rows * spread, "lasso": alpha}[kind]
    return LinearRegression(
        labelCol="target",
        elasticNetParam=1.0 if kind == "lasso" else 0.0,
        regParam=strength,
        fitIntercept=intercept,
        standardization=False,
    )


def important_features(
    table: DataFrame, names: Sequence[str], threshold: str = "mean", trees: int = 10, depth: int = 10, seed: int = 6
) -> list[str]:
    """Columns whose importance in extremely randomised trees reaches ``mean``, a multiple (``0.7*mean``) or the ``median``.

    ``table`` has the columns and a 0/1 ``target``; trees end at ``depth`` levels.
    """
    scores = extra.importances(extra.grown(extra.stored_rows(table, names), len(names), 2, trees, depth, seed), len(names))
    factor, _, kind = threshold.rpartition("*")
    edge = float(np.median(scores) if kind == "median" else np.mean(scores)) * float(factor or 1)
    return [n for n, s in zip(names, scores, strict=True) if s >= edge]
