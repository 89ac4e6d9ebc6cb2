"""Positions from signal reports: offsets per main station, and lending of rows.

A station's model is fitted on sums over its rows, so lending rows of other stations
means adding their sums: a pool's sums are computed once and added to each borrower.
No row is copied per borrower, so the cost stays one pass over the rows, however many
stations borrow.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from cartwave.functions.columns import drop_containing, feature_columns
from cartwave.functions.geo import Grid
from cartwave.learners import celltrees as ct
from cartwave.learners import multiclass as mc
from cartwave.learners.forest import fit_grouped_forest
from cartwave.learners.models import Neighbours
from cartwave.operators.joins import spread_join
from cartwave.operators.metrics import (
    first_of_group,
    top_cell_scores,
    with_distance,
)
from cartwave.operators.ranking import sorted_curve, take_smallest, upper_median
from cartwave.operators.sampling import repeated_splits, with_split
from cartwave.operators.stations import MAIN, distinct_stations, with_absolute, with_offsets
from cartwave.session import cut

OFFSETS = ("relative_latitude", "relative_longitude")
# fixed values: parts of the names of columns that are no features
NOT_FEATURES = ("AsuLevel", "SignalLevel", "RNCID", "CellID", "IMSI", "MRTime")
TRUTH = ("row_id", "Latitude_m", "Longitude_m", "Target", *OFFSETS, "split", "is_test")
# degrees to micro-degrees, so that sums of squares are not tiny
MICRO = 1e6


# -- statistics and lending ------------------------------------------------


def station_sums(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count and offset sums per main station (and split)."""
    return train.groupBy(*by, *MAIN).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(o).alias(f"sum_{o}") for o in OFFSETS]
    )


def pool_sums(sums: DataFrame, donors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums of all donor stations per pool; ``donors`` has the station key and ``pool``."""
    return sums.join(donors, list(MAIN)).groupBy(*by, "pool").agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"sum_{o}" for o in OFFSETS])]
    )


def lent_sums(
    sums: DataFrame, donors: DataFrame, borrowers: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """What each borrower receives: the sums of its pools."""
    return borrowers.join(pool_sums(sums, donors, by), "pool").groupBy(*by, *MAIN).agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"sum_{o}" for o in OFFSETS])]
    )


def with_lending(
    sums: DataFrame, donors: DataFrame, borrowers: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Own sums plus lent sums: the same as fitting on own rows and donor rows."""
    both = sums.unionByName(
        lent_sums(sums, donors, borrowers, by).join(
            sums.select(*by, *MAIN), [*by, *MAIN], "left_semi"
        )
    )
    return both.groupBy(*by, *MAIN).agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"sum_{o}" for o in OFFSETS])]
    )


def mean_offsets(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sums.select(
        *by, *MAIN, *[(F.col(f"sum_{o}") / F.col("n")).alias(f"pred_{o}") for o in OFFSETS]
    )


def fallback_offsets(train: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean offset over all stations, for stations without training rows."""
    return train.groupBy(*by).agg(*[F.avg(o).alias(f"all_{o}") for o in OFFSETS])


def score_offsets(
    test: DataFrame, models: DataFrame, fallback: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Predicted position and distance error of each test record."""
    scored = spread_join(test, models, [*by, *MAIN], ["row_id"])
    return finish(scored, fallback, by)


def finish(scored: DataFrame, fallback: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Fill unknown predictions, add the station position and the error."""
    if by:
        # one row per split
        scored = scored.join(F.broadcast(fallback), list(by), "left")
    else:
        one = fallback.select(F.struct(*fallback.columns).alias("f")).scalar()
        scored = scored.withColumn("_f", one).select("*", "_f.*").drop("_f")
    full = scored.withColumns(
        {f"pred_{o}": F.coalesce(F.col(f"pred_{o}"), F.col(f"all_{o}")) for o in OFFSETS}
    ).drop(*[f"all_{o}" for o in OFFSETS])
    placed = with_absolute(full, f"pred_{OFFSETS[0]}", f"pred_{OFFSETS[1]}")
    return with_distance(placed)


def split_rows(table: DataFrame, splits: int) -> DataFrame:
    """Offsets and splits of a training table."""
    return repeated_splits(with_offsets(table), ["row_id"], range(splits))


def mean_offset_errors(
    rows: DataFrame, lending: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Error of every test record of every split, with the mean-offset model."""
    by = ["split"]
    train, test = rows.where("is_test = 0"), rows.where("is_test = 1")
    sums = station_sums(train, by)
    if lending is not None:
        sums = with_lending(sums, *lending, by)
    return score_offsets(test, mean_offsets(sums, by), fallback_offsets(train, by), by)


def error_table(scored: DataFrame) -> DataFrame:
    """Per record its station and the error averaged over the splits that tested it."""
    return scored.groupBy("row_id", *MAIN).agg(F.avg("dist").alias("dist"))


def station_medians(errors: DataFrame) -> DataFrame:
    return upper_median(errors, MAIN, "dist", "median_error")


# -- choosing donors and borrowers -------------------------------------------


def fifth(medians: DataFrame, share: float = 0.2):
    """ceil(share * stations) as a scalar subquery."""
    return medians.agg(F.ceil(F.count(F.lit(1)) * share).cast("long").alias("k")).scalar()


def best_stations(medians: DataFrame, share: float = 0.2) -> DataFrame:
    return take_smallest(medians, "median_error", MAIN, fifth(medians, share))


def worst_stations(medians: DataFrame, share: float = 0.2) -> DataFrame:
    turned = medians.withColumn("_neg", -F.col("median_error"))
    return take_smallest(turned, "_neg", MAIN, fifth(medians, share)).drop("_neg")


def best_to_worst(medians: DataFrame, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """One pool: the best stations lend to each of the worst.

    Both lists are stored, so that joins on the pool stay joins on a column.
    """
    donors = best_stations(medians, share).select(*MAIN, F.lit(0).alias("pool"))
    borrowers = worst_stations(medians, share).select(*MAIN, F.lit(0).alias("pool"))
    return cut(donors), cut(borrowers)


def similar_to_worst(
    medians: DataFrame, labels: DataFrame, share: float = 0.2, most: int = 2
) -> tuple[DataFrame, DataFrame]:
    """One pool per label: stations of a label lend to the worst stations carrying it.

    ``labels`` has the station key and ``label``; a station's first ``most`` labels
    count.  The station's own rows are part of its pool and so count again.
    """
    donors = labels.select(*MAIN, F.col("label").alias("pool")).dropDuplicates()
    mine = first_of_group(labels, MAIN, "label", most)
    borrowers = worst_stations(medians, share).select(*MAIN).join(mine, list(MAIN))
    return donors, borrowers.withColumnRenamed("label", "pool")


def cluster_stations(
    rows: DataFrame, medians: DataFrame, share: float = 0.2, seed: int = 0
) -> DataFrame:
    """Label stations by k-means on their position, k = ceil(share * stations)."""
    k = medians.agg(F.ceil(F.count(F.lit(1)) * share).cast("int").alias("k")).first()["k"]
    stations = VectorAssembler(
        inputCols=["Latitude_1", "Longitude_1"], outputCol="position"
    ).transform(distinct_stations(rows))
    if k < 2:
        return stations.select(*MAIN, F.lit(0).alias("label"))
    model = KMeans(k=k, seed=seed, featuresCol="position", predictionCol="label").fit(stations)
    return model.transform(stations).select(*MAIN, "label")


# -- forest per station ---------------------------------------------------------


def position_features(table: DataFrame) -> list[str]:
    """Station positions, signal strengths and the number of connected stations."""
    return feature_columns(drop_containing(table, NOT_FEATURES), TRUTH, target="Target")


def forest_errors(
    train: DataFrame,
    test: DataFrame,
    lending: tuple[DataFrame, DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Error of every test record with one forest per main station.

    With lending, a borrower uses the forest of its pool, grown on the rows of the
    pool's donors and borrowers, each row counted once, so no row is copied per
    borrower.  A borrower with two pools averages both forests.
    """
    features = position_features(train)
    micro = [(F.col(o) * MICRO).alias(o) for o in OFFSETS]
    keep = [c for c in train.columns if c not in OFFSETS]
    scaled = train.select(*keep, *micro)
    own = fit_grouped_forest(scaled, MAIN, features, OFFSETS, "row_id", **options)
    scored = own.predict(test)
    names = [f"pred_{o}" for o in OFFSETS]
    if lending is not None:
        donors, borrowers = (cut(d) for d in lending)
        # a pool that nobody borrows from needs no forest
        members = donors.join(borrowers.select("pool").distinct(), "pool", "left_semi").unionByName(borrowers).dropDuplicates()
        pooled = fit_grouped_forest(
            scaled.join(members, list(MAIN)), ["pool"], features, OFFSETS, "row_id", **options
        )
        lent = (
            pooled.predict(test.join(borrowers, list(MAIN)))
            .groupBy("row_id")
            .agg(*[F.avg(n).alias(f"_{n}") for n in names])
        )
        scored = (
            scored.join(lent, "row_id", "left")
            .withColumns({n: F.coalesce(F.col(f"_{n}"), F.col(n)) for n in names})
            .drop(*[f"_{n}" for n in names])
        )
    scored = scored.withColumns({n: F.col(n) / MICRO for n in names})
    return finish(scored, fallback_offsets(train))


# -- grid cells ------------------------------------------------------------------

# fixed values: columns of the board
CELL_BOARD = (
    "Name string, Time double, Recall double, F double, Precision double, "
    "`Overall Precision` double, `Median Error` double, Problem string"
)


def _marked(known: DataFrame, splits: int) -> tuple[DataFrame, list]:
    """The rows and, per split, the column that tells whether it trains on them."""
    for s in range(splits):
        known = with_split(known, ["row_id"], s).withColumn(f"_in{s}", F.col("is_test") == 0).drop("is_test")
    return known, [F.col(f"_in{s}") for s in range(splits)]


@dataclass
class BoostedCells:
    """Boosting over every cell, for all splits in the same jobs: ``stumps`` or ``softmax`` trees."""

    kind: str
    rounds: int

    def predict_splits(self, known: DataFrame, features: Sequence[str], classes: int, splits: int) -> DataFrame:
        marked, trains = _marked(known, splits)
        rows = mc.prepared(marked, features, "target", trains, ["row_id"])
        if self.kind == "stumps":
            deciders = [mc.stump_classes(m, classes) for m in mc.boost_stumps(rows, classes, splits, self.rounds)]
        else:
            deciders = [mc.softmax_classes(m) for m in mc.boost_softmax(rows, classes, splits, self.rounds)]
        return mc.predicted(rows, deciders, "row_id")


@dataclass
class PerSplit:
    """An estimator fitted once per split; the jobs of up to ``parallelism`` splits share the cluster."""

    estimator: object
    parallelism: int = 4

    def predict_splits(self, known: DataFrame, features: Sequence[str], classes: int, splits: int) -> DataFrame:
        def one(split: int) -> DataFrame:
            marked = with_split(known, ["row_id"], split)
            fitted = self.estimator.fit(marked.where("is_test = 0").select("features", "target"))
            scored = fitted.transform(marked.where("is_test = 1").select("row_id", "features"))
            return cut(scored.select(F.lit(split).alias("split"), "row_id", F.col("prediction").cast("int").alias("prediction")))

        with ThreadPoolExecutor(max_workers=self.parallelism) as pool:
            parts = list(pool.map(inheritable_thread_target(known.sparkSession)(one), range(splits)))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


@dataclass
class SplitTrees:
    """Spark's tree or forest; a table of bounded size goes to every task, which grows the trees of a split, a larger one to Spark."""

    estimator: object

    def predict_splits(self, known: DataFrame, features: Sequence[str], classes: int, splits: int) -> DataFrame:
        how = ct.grower_of(self.estimator, len(features))
        if how is None or known.count() * len(features) > ct.WHOLE_VALUES:
            return PerSplit(self.estimator).predict_splits(known, features, classes, splits)
        marked, trains = _marked(known, splits)
        return ct.predicted(marked, features, trains, "row_id", classes, how)


def cell_models(rounds: dict[str, int] = {"ada": 50, "gbt": 10}) -> list[tuple[str, object]]:
    """The seven position classifiers; Spark's trees have a limited depth."""
    label = {"labelCol": "target", "seed": 0}
    return [
        ("GaussianNB", PerSplit(NaiveBayes(modelType="gaussian", labelCol="target"))),
        ("KNeighborsClassifier", PerSplit(Neighbours(3))),
        ("DecisionTreeClassifier", SplitTrees(DecisionTreeClassifier(maxDepth=10, **label))),
        ("AdaBoostClassifier", BoostedCells("stumps", rounds["ada"])),
        ("RandomForestClassifier", SplitTrees(RandomForestClassifier(numTrees=10, maxDepth=8, **label))),
        ("BaggingClassifier", SplitTrees(RandomForestClassifier(numTrees=10, featureSubsetStrategy="all", maxDepth=8, **label))),
        ("GradientBoostingClassifier", BoostedCells("softmax", rounds["gbt"])),
    ]


def numbered_cells(table: DataFrame, cell: str = "Target") -> DataFrame:
    """(cell, target): cells that occur, numbered from 0 by id.  There are at most as many as the grid has."""
    return table.select(F.col(cell).alias("cell")).distinct().withColumn(
        "target", (F.row_number().over(Window.orderBy("cell")) - 1).cast("int")
    )


def rank_cell_models(
    models: Sequence[tuple[str, object]], table: DataFrame, grid: Grid, splits: int = 10
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cell scores and distance errors per model, averaged over the splits; a model that fails is on the board with its problem.

    Returns the leaderboard and each model's test errors (``split``, ``row_id``, ``cell``, ``pred_cell``, ``dist``).
    """
    spark = table.sparkSession
    features = position_features(table)
    cells = cut(numbered_cells(table))
    classes = cells.count()
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(table).withColumnRenamed("Target", "cell")
    known = vectors.select("row_id", "Latitude_m", "Longitude_m", "cell", "features", *features).join(cells, "cell")
    # Spark's trees ask the column how many classes there are
    nominal = {"ml_attr": {"type": "nominal", "num_vals": classes}}
    known = cut(known.withColumn("target", F.col("target").cast("double").alias("target", metadata=nominal)))
    truth = known.select("row_id", "Latitude_m", "Longitude_m", "cell")
    named = cells.select(F.col("target").alias("prediction"), F.col("cell").alias("pred_cell"))
    rows, errors = [], {}
    for name, model in models:
        try:
            start = time.time()
            found = model.predict_splits(known, features, classes, splits).join(named, "prediction").join(truth, "row_id")
            lat, lon = grid.centre_of(F.col("pred_cell"))
            placed = cut(
                with_distance(found.withColumns({"pred_latitude": lat, "pred_longitude": lon}))
                .select("split", "row_id", "cell", "pred_cell", "dist")
            )
            spent = time.time() - start
            score = lambda s, placed=placed: top_cell_scores(placed.where(F.col("split") == s), "cell", "pred_cell").first()
            with ThreadPoolExecutor(max_workers=4) as pool:
                scores = list(pool.map(inheritable_thread_target(spark)(score), range(splits)))
            curve = sorted_curve(placed, ["split"], "dist").groupBy("rank").agg(F.avg("dist").alias("dist"))
            middle = upper_median(curve.withColumn("model", F.lit(name)), ["model"], "dist")
            mean = {c: sum(s[c] for s in scores) / splits for c in scores[0].asDict()}
            rows.append((
                name, spent / splits, mean["recall"], mean["f"], mean["precision"],
                mean["accuracy"], middle.first()["median"], None,
            ))
            errors[name] = placed
        except Exception as problem:  # noqa: BLE001 - stands on the board
            rows.append((name, *[None] * 6, str(problem)[:300]))
    board = spark.createDataFrame(rows, CELL_BOARD)
    return board.orderBy(F.col("Median Error").desc_nulls_last(), "Name"), errors


def first_stumps(table: DataFrame, features: Sequence[str], splits: int = 10) -> DataFrame:
    """(split, feature, bin, left_cell, right_cell, error): the first round of the stumps, before any row has a weight."""
    cells = cut(numbered_cells(table))
    marked, trains = _marked(table.withColumnRenamed("Target", "cell").join(cells, "cell"), splits)
    rows = mc.prepared(marked, features, "target", trains)
    found = mc.stump_round(rows, cells.count(), [[] for _ in range(splits)], range(splits))
    stumps = table.sparkSession.createDataFrame(
        [(s, features[t.feature], t.bin, t.left, t.right, t.error) for s, t in found.items()],
        "split long, feature string, bin long, target int, right int, error double",
    )
    left = stumps.join(cells.withColumnRenamed("cell", "left_cell"), "target").drop("target")
    return left.withColumnRenamed("right", "target").join(cells.withColumnRenamed("cell", "right_cell"), "target").drop("target")


# -- comparison -----------------------------------------------------------------


def compare_methods(medians: dict[str, DataFrame], base: str) -> DataFrame:
    """Station medians of several methods side by side, with the base's worst marked."""
    out = medians[base].withColumnRenamed("median_error", base)
    for name, other in medians.items():
        if name != base:
            out = out.join(other.withColumnRenamed("median_error", name), list(MAIN), "left")
    worst = worst_stations(medians[base]).select(*MAIN, F.lit(1).alias("was_worst"))
    out = out.join(worst, list(MAIN), "left").fillna(0, ["was_worst"])
    return out.withColumns(
        {
            f"{name}_improved": F.coalesce((F.col(name) < F.col(base)).cast("int"), F.lit(0))
            for name in medians
            if name != base
        }
    )
