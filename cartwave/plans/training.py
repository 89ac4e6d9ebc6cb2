"""Train, evaluate, rank, tune and score."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cartwave.functions.columns import half_even, yes_no
from cartwave.operators import metrics
from cartwave.operators.sampling import with_fold
from cartwave.session import cut

CLASS_BOARD = (
    "Model string, Test_auc double, Test_precision double, Time double, CV_recall double, "
    "CV_accuracy double, CV_auc double, Correct long, Error long, "
    "Correct_counts map<long,long>, Error_counts map<long,long>, Problem string"
)
SPEND_BOARD = "Model string, Test_EVS double, Test_MAE double, Test_MSE double, Time double, Problem string"


def cross_validate(model, train: DataFrame, keys: Sequence[str], folds: int) -> dict[str, float]:
    """Mean recall, accuracy, hard-label AUC and rank AUC (of the model's scores) over hash folds."""
    folded = with_fold(train, keys, folds)
    # some models fit all folds in the same jobs
    together = model.fit_folds(cut(folded), folds) if hasattr(model, "fit_folds") else None
    parts = None
    for f in range(folds):
        fitted = together[f] if together else model.fit(folded.where(F.col("fold") != f))
        held = fitted.transform(folded.where(F.col("fold") == f))
        held = held.select("target", "prediction", "fold", _score_of(held).alias("_score"))
        parts = held if parts is None else parts.unionByName(held)
    row = metrics.fold_scores(cut(parts), score="_score").first()
    return row.asDict()


def _score_of(scored: DataFrame):
    """What orders the rows by how likely class 1 is."""
    if "probability" in scored.columns:
        return vector_to_array("probability")[1]
    return F.col("score" if "score" in scored.columns else "prediction").cast("double")


def _each(
    spark: SparkSession, models: Sequence[tuple[str, object]], run: Callable, parallelism: int
) -> list:
    """``run(name, model)`` for every model, or (name, problem) for one that fails: no model ends or leaves the board.

    The jobs of up to ``parallelism`` models share the cluster.
    """

    def safe(entry):
        name, model = entry
        try:
            return run(name, model)
        except Exception as problem:  # noqa: BLE001 - stands in the board
            return name, str(problem)[:300]

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(inheritable_thread_target(spark)(safe), models))


def _board(spark: SparkSession, found: list, schema: str) -> DataFrame:
    """One row per model, a failing one with nothing but its problem."""
    width = len(StructType.fromDDL(schema).fields)
    rows = [(f[0], *[None] * (width - 2), f[1]) if isinstance(f[1], str) else (*f[0], None) for f in found]
    return spark.createDataFrame(rows, schema)


def rank_classifiers(
    models: Sequence[tuple[str, object]],
    train: DataFrame,
    test: DataFrame,
    keys: Sequence[str],
    folds: int = 3,
    wrong_by_truth: bool = False,
    parallelism: int = 1,
) -> tuple[DataFrame, dict[str, object]]:
    """Leaderboard by AUC and the fitted models by name.

    Only one row of scores per model reaches the driver.
    """

    def run(name, model):
        cv = cross_validate(model, train, keys, folds) if folds > 1 else {}
        start = time.time()
        done = model.fit(train)
        scored = cut(done.transform(test).select("target", "prediction"))
        score = metrics.class_scores(scored).first()
        spread = metrics.distribution_maps(
            metrics.prediction_distribution(scored, wrong_by_truth=wrong_by_truth)
        ).first()
        row = (
            name, score["auc"], score["accuracy"], time.time() - start,
            cv.get("recall_mean"), cv.get("accuracy_mean"), cv.get("rank_auc_mean"),
            spread["correct"], spread["error"], spread["correct_counts"], spread["error_counts"],
        )
        return row, done

    found = _each(train.sparkSession, models, run, parallelism)
    board = _board(train.sparkSession, found, CLASS_BOARD)
    fitted = {f[0][0]: f[1] for f in found if not isinstance(f[1], str)}
    return board.orderBy(F.col("Test_auc").desc_nulls_last(), "Model"), fitted


def two_stage(spend: DataFrame, buys: DataFrame, key: str = "user_id") -> DataFrame:
    """Predicted amount times predicted buy flag, matched by user."""
    flags = buys.select(key, F.col("prediction").alias("_buys"))
    return (
        spend.join(flags, key)
        .withColumn("prediction", F.col("prediction") * F.col("_buys"))
        .drop("_buys")
    )


def rank_regressors(
    models: Sequence[tuple[str, object]],
    train: DataFrame,
    test: DataFrame,
    buys: DataFrame | None = None,
    key: str = "user_id",
    parallelism: int = 1,
) -> tuple[DataFrame, dict[str, object], dict[str, DataFrame]]:
    """Leaderboard by squared error, fitted models, and test predictions by name."""

    def run(name, model):
        start = time.time()
        done = model.fit(train)
        scored = done.transform(test)
        if buys is not None:
            scored = two_stage(scored, buys, key)
        scored = cut(scored.select(key, "target", "prediction"))
        score = metrics.regression_scores(scored).first()
        return (name, score["evs"], score["mae"], score["mse"], time.time() - start), done, scored

    found = _each(train.sparkSession, models, run, parallelism)
    board = _board(train.sparkSession, found, SPEND_BOARD)
    good = [f for f in found if not isinstance(f[1], str)]
    return (
        board.orderBy(F.col("Test_MSE").asc_nulls_last(), "Model"),
        {f[0][0]: f[1] for f in good},
        {f[0][0]: f[2] for f in good},
    )


# fixed values: the searched settings of each model
GRIDS = {
    "logistic_c": (0.4, 0.6, 0.8),
    "logistic_c_user": (0.2, 0.3, 0.4),
    "logistic_c_balanced": (0.5, 0.7, 0.9),
    "neighbours": (2, 3, 4),
    "forest_trees": (5, 10, 15, 20, 25, 30),
    "tree_features": ("auto", "log2", "sqrt", "all"),
    "ridge_alpha": tuple(0.5 + 0.5 * i for i in range(19)),
    "lasso_alpha": tuple(0.5 + 0.3 * i for i in range(15)),
    "boost_depth": (2, 5, 8, 11, 14),
    "boost_rounds": tuple(range(10, 70, 5)),
}


# bytes of vectors that a task passes over in one step of a model
PART_BYTES = 128 << 20


def in_few_parts(vectors: DataFrame, size: int = PART_BYTES) -> DataFrame:
    """``vectors`` in parts of about ``size`` bytes, dense, or as they are if these are larger.

    A model's step is one pass over all parts and a tree of sums over them, so small parts cost more than they save.
    """
    first = vectors.select("features").first()
    if first is None:
        return vectors
    return vectors.coalesce(max(1, -(-vectors.count() * 8 * len(first["features"]) // size)))


def grid_search(
    estimator,
    grid: dict[str, Sequence],
    train: DataFrame,
    keys: Sequence[str],
    folds: int = 4,
    parallelism: int = 8,
    scoring: str = "areaUnderROC",
) -> DataFrame:
    """Mean score per setting over hash folds, best first; nothing is refitted for use."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    if scoring == "areaUnderROC":
        judge = BinaryClassificationEvaluator(labelCol="target", metricName=scoring)
    else:
        judge = RegressionEvaluator(labelCol="target", metricName=scoring)
    folded = in_few_parts(cut(with_fold(train, keys, folds)))
    for f in range(folds):
        for kind, part in (("training", folded.where(F.col("fold") != f)), ("validation", folded.where(F.col("fold") == f))):
            if part.isEmpty():
                raise ValueError(f"The {kind} data at fold {f} is empty.")

    def run(entry):
        fold, setting = entry
        model = estimator.fit(folded.where(F.col("fold") != fold), setting)
        return judge.evaluate(model.transform(folded.where(F.col("fold") == fold), setting))

    # the folds' models share the cluster too: a step of one is a short job that leaves most of it idle
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        every = [(f, m) for f in range(folds) for m in maps]
        scores = np.reshape(list(pool.map(inheritable_thread_target(train.sparkSession)(run), every)), (folds, len(maps)))
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in m.items()), float(avg), float(std))
        for m, avg, std in zip(maps, scores.mean(axis=0), scores.std(axis=0))
    ]
    order = F.col("score").desc() if judge.isLargerBetter() else F.col("score")
    return train.sparkSession.createDataFrame(
        rows, "setting string, score double, deviation double"
    ).orderBy(order, "setting")


def search_settings(
    named: Sequence[tuple[str, object]], train: DataFrame, keys: Sequence[str], folds: int = 4
) -> DataFrame:
    """The same search for models that are not ``pyspark.ml`` estimators, by AUC."""
    rows = []
    for name, model in named:
        score = cross_validate(model, train, keys, folds)
        rows.append((name, score["rank_auc_mean"], score["rank_auc_std"]))
    return train.sparkSession.createDataFrame(
        rows, "setting string, score double, deviation double"
    ).orderBy(F.col("score").desc(), "setting")


def class_output(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and Yes / No."""
    return scored.select(*keys, yes_no(F.col("prediction")).alias("target"))


def amount_output(scored: DataFrame, key: str = "user_id") -> DataFrame:
    """Key and amount, rounded half-even to two places."""
    return scored.select(key, half_even(F.col("prediction")).alias("label"))


def pair_output(scored: DataFrame) -> DataFrame:
    """True and predicted amount, rounded half-even to two places."""
    return scored.select(
        half_even(F.col("target").cast("double")).alias("target"),
        half_even(F.col("prediction")).alias("label"),
    )
