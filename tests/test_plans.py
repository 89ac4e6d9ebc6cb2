"""Training, tuning, windows and positioning plans."""

import threading

import pytest
from pyspark.ml import Estimator, Transformer
from pyspark.ml.param.shared import HasRegParam
from pyspark.sql import functions as F

from cartwave.learners import models as ml
from cartwave.operators.stations import fill_from_main, station_position
from cartwave.plans import datasets as ds
from cartwave.plans import positioning as pos
from cartwave.plans import training as tr
from cartwave.sources import store
from cartwave.sources.trade import star_trade
from cartwave.sources.windows import DATASETS, SCORE, TRAIN


class Broken:
    def fit(self, df):
        raise RuntimeError("no such model")


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.range(300).selectExpr(
        "id", "cast(pmod(xxhash64(id), 100) as double) as a", "cast(pmod(xxhash64(id, 1), 100) as double) as b"
    ).withColumn("target", (F.col("a") > 60).cast("int"))
    return ml.to_vectors(rows, ["id"]).cache()


def test_leaderboard_names_problems_and_keeps_names(spark, vectors):
    named = [("broken", Broken()), *[m for m in ml.classifiers() if m[0] in ("GaussianNB", "DecisionTreeClassifier")]]
    board, fitted = tr.rank_classifiers(named, vectors, vectors, ["id"], folds=2, parallelism=2)
    rows = board.collect()
    assert [r.Model for r in rows][0] == "DecisionTreeClassifier" and len(rows) == 3
    broken = rows.pop()
    assert broken.Model == "broken" and broken.Problem == "no such model" and broken.Test_auc is None
    assert all(r.Problem is None and 0 <= r.CV_auc <= 1 for r in rows)
    assert set(fitted) == {"GaussianNB", "DecisionTreeClassifier"}
    for r in rows:
        assert 0 <= r.Test_auc <= 1 and r.Correct + r.Error == 300
        assert sum(r.Correct_counts.values()) == r.Correct


def test_folds_fitted_together_are_those_fitted_alone(vectors):
    from cartwave.learners.boosting import BoostedClassifier
    from cartwave.operators.sampling import with_fold

    folded = with_fold(vectors, ["id"], 3)
    together = BoostedClassifier(rounds=4).fit_folds(folded, 3)
    for f, model in enumerate(together):
        alone = BoostedClassifier(rounds=4)._fit(folded, [F.col("fold") != f])[0]
        assert [(s.feature, s.bin, s.left, s.right) for s in model.stumps] == [(s.feature, s.bin, s.left, s.right) for s in alone.stumps]
    scores = tr.cross_validate(BoostedClassifier(rounds=4), vectors, ["id"], 3)
    assert scores["accuracy_mean"] > 0.95


def test_grid_search_orders_by_score(vectors):
    got = tr.grid_search(ml.l1_logistic(0.5, 300), {"regParam": [0.001, 100.0]}, vectors, ["id"], folds=2).collect()
    assert len(got) == 2 and got[0].setting == "regParam=0.001" and got[0].score > got[1].score


class Waits(Estimator, HasRegParam):
    """Fits only when ``fits`` fits have begun."""

    def __init__(self, fits):
        super().__init__()
        self.barrier = threading.Barrier(fits)

    def _fit(self, df):
        self.barrier.wait(30)
        return Constant()


class Constant(Transformer):
    def _transform(self, df):
        return df.withColumn("rawPrediction", F.lit(0.5))


def test_grid_search_fits_all_folds_at_once(vectors):
    got = tr.grid_search(Waits(8), {"regParam": [0.1, 0.2]}, vectors, ["id"], folds=4).collect()
    assert [(r.setting, r.score, r.deviation) for r in got] == [("regParam=0.1", 0.5, 0.0), ("regParam=0.2", 0.5, 0.0)]


def test_grid_search_names_an_empty_fold(vectors):
    with pytest.raises(ValueError, match="data at fold 0 is empty"):
        tr.grid_search(ml.l1_logistic(0.5, 1), {"regParam": [0.1]}, vectors.where("id = 1"), ["id"], folds=2)


def test_vectors_are_gathered_in_few_parts(vectors):
    many = vectors.repartition(12)
    few = tr.in_few_parts(many)
    assert few.rdd.getNumPartitions() == 1 and sorted(few.collect()) == sorted(many.collect())
    assert tr.in_few_parts(many, 300 * 16 // 3).rdd.getNumPartitions() == 3
    assert tr.in_few_parts(many, 16).rdd.getNumPartitions() == 12
    assert tr.in_few_parts(many.where("id < 0")).count() == 0


def test_neighbour_settings_are_searched(vectors):
    got = tr.search_settings([(f"k={k}", ml.Neighbours(k)) for k in (1, 3)], vectors, ["id"], folds=2).collect()
    assert {r.setting for r in got} == {"k=1", "k=3"} and all(r.score > 0.7 for r in got)


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)] * 6, "target int")
    got = {r.target: r.weight for r in ml.with_balance(df).collect()}
    assert got == {1: 2.0, 0: pytest.approx(8 / 12)}


def test_two_stage_matches_by_user(spark):
    spend = spark.createDataFrame([(1, 5.0, 10.0), (2, 5.0, 20.0)], "user_id long, target double, prediction double")
    buys = spark.createDataFrame([(2, 0.0), (1, 1.0)], "user_id long, prediction double")
    got = {r.user_id: r.prediction for r in tr.two_stage(spend, buys).collect()}
    assert got == {1: 10.0, 2: 0.0}


def test_outputs(spark):
    df = spark.createDataFrame([(1, 0.125, 1.0), (2, 2.375, 0.0)], "user_id long, target double, prediction double")
    assert [tuple(r) for r in tr.class_output(df, ["user_id"]).collect()] == [(1, "Yes"), (2, "No")]
    assert [r.target for r in tr.pair_output(df).collect()] == [0.12, 2.38]


def test_windows_are_written_and_read(spark, sf_dir, tmp_path):
    trade = star_trade(spark, sf_dir)
    ds.write_all_windows(trade, str(tmp_path), windows=(TRAIN, SCORE), names=("user", "spend"))
    train = ds.read_dataset(spark, str(tmp_path), "user", TRAIN)
    score = ds.read_dataset(spark, str(tmp_path), "user", SCORE)
    assert "target" in train.columns and "target" not in score.columns
    assert train.count() == train.select("user_id").distinct().count() > 0
    assert ds.label_share(train).first().positives > 0
    assert ds.read_dataset(spark, str(tmp_path), "spend", TRAIN).count() == train.count()


def test_all_windows_read_the_log_once(spark, sf_dir, tmp_path):
    """The log is gone after the cube has been written; every later table comes from the cube."""
    import shutil

    star_trade(spark, sf_dir).write.parquet(str(tmp_path / "log"))
    log, write = spark.read.parquet(str(tmp_path / "log")), ds.write_window

    def after_the_cube(*args):
        shutil.rmtree(tmp_path / "log", ignore_errors=True)
        write(*args)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ds, "write_window", after_the_cube)
        ds.write_all_windows(log, str(tmp_path / "out"), windows=(TRAIN, SCORE), names=("user", "spend", "user_brand"))
    assert ds.read_dataset(spark, str(tmp_path / "out"), "user_brand", TRAIN).count() > 0


def test_new_months_alone_are_aggregated(spark, sf_dir, tmp_path):
    """A second run over a log whose month 5 has changed: the result is that of a full run, from that month's rows alone."""
    trade = star_trade(spark, sf_dir).where("month between 2 and 7")
    changed = trade.where("month <> 5 or day % 3 > 0")
    ds.write_all_windows(trade, str(tmp_path / "a"), windows=(TRAIN, SCORE), names=("user",))
    ds.write_all_windows(changed, str(tmp_path / "b"), windows=(TRAIN, SCORE), names=("user",))
    # rows of other months would spoil the cube if they were read
    only = changed.withColumn("amt", F.when(F.col("month") == 5, F.col("amt")).otherwise(F.raise_error(F.lit("read")).cast("decimal(18,2)")))
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        write = ds.write_window
        patch.setattr(ds, "write_window", lambda cube, window, *rest: (seen.append(window.name), write(cube, window, *rest)))
        ds.write_all_windows(only, str(tmp_path / "a"), windows=(TRAIN, SCORE), names=("user",), changed=[5])
    assert seen == [w.name for w in (TRAIN, SCORE) if 5 in ds.months_of(w)] and seen
    for part in ("cube", f"{DATASETS['user']}/window={TRAIN.name}", f"{DATASETS['user']}/window={SCORE.name}"):
        one, two = (spark.read.parquet(str(tmp_path / x / part)) for x in "ab")
        assert one.columns == two.columns and one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    # a month that has lost all its rows
    ds.update_cube(changed.where("month <> 5"), str(tmp_path / "a"), [5])
    assert spark.read.parquet(str(tmp_path / "a" / "cube")).where("month = 5").isEmpty()


def test_read_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.read_or_build(spark, str(tmp_path / "t"), build).count() == 3
    assert len(calls) == 1


def reports(spark):
    """Two stations with own offsets; the third has one record only."""
    rows = []
    for i in range(90):
        cell = 1 + i % 2 if i else 3
        rows.append((i, 5, cell, 31.0 + cell / 100, 121.0, 31.0 + cell / 100 + cell * 1e-4, 121.0 + 2e-4))
    return spark.createDataFrame(
        rows, "row_id long, RNCID_1 long, CellID_1 long, Latitude_1 double, Longitude_1 double, "
        "Latitude_m double, Longitude_m double")


def test_mean_offset_and_fallback(spark):
    rows = pos.split_rows(reports(spark), 2).withColumn("is_test", (F.col("row_id") < 20).cast("int"))
    got = pos.mean_offset_errors(rows).collect()
    assert len(got) == 40
    for r in got:
        # station 3 has no training row, so it gets the mean offset of all stations
        assert (r.dist > 5) == (r.CellID_1 == 3)


def test_lending_pools_add_up(spark):
    rows = pos.split_rows(reports(spark), 1).withColumn("is_test", F.lit(0))
    sums = pos.station_sums(rows)
    pool = sums.select(*pos.MAIN, F.col("RNCID_1").alias("pool"))
    got = {r.CellID_1: r.n for r in pos.with_lending(sums, pool, pool.where("CellID_1 = 3")).collect()}
    own = {r.CellID_1: r.n for r in sums.collect()}
    assert got == {1: own[1], 2: own[2], 3: 1 + 90}


def test_best_and_worst_fifth(spark):
    for n, k in ((6, 2), (5, 1)):
        med = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "RNCID_1 long, CellID_1 long, median_error double")
        assert [r.CellID_1 for r in pos.best_stations(med).collect()] == list(range(k))
        assert sorted(r.CellID_1 for r in pos.worst_stations(med).collect()) == list(range(n - k, n))


def test_fill_uses_the_main_longitude(spark):
    cols = {"row_id": F.lit(1)}
    for i in range(1, 8):
        for name in ("Latitude", "Longitude", "RNCID", "CellID", "AsuLevel", "SignalLevel", "RSSI"):
            value = F.lit(float(i * 10 + len(name)))
            cols[f"{name}_{i}"] = F.lit(None).cast("double") if i == 4 and name == "Longitude" else value
    row = fill_from_main(spark.range(1).select(*[v.alias(k) for k, v in cols.items()])).first()
    assert row.Longitude_4 == row.Longitude_1 != row.Latitude_1 and row.RSSI_4 == row.RSSI_1
    assert row.Longitude_5 != row.Longitude_1


def test_station_position_needs_both_keys(spark):
    df = spark.createDataFrame([(1, 7, 1.0, 2.0), (2, 7, 3.0, 4.0)], "RNCID_1 long, CellID_1 long, Latitude_1 double, Longitude_1 double")
    assert [tuple(r) for r in station_position(df, 2, 7).collect()] == [(3.0, 4.0)]


def test_clusters_cover_all_stations(spark):
    rows = reports(spark)
    med = spark.createDataFrame([(5, c, float(c)) for c in (1, 2, 3)], "RNCID_1 long, CellID_1 long, median_error double")
    labels = pos.cluster_stations(rows, med, share=0.6)
    assert labels.count() == 3 and labels.select("label").distinct().count() == 2
    donors, borrowers = pos.similar_to_worst(med, labels)
    assert borrowers.count() == 1 and donors.join(borrowers.select("pool"), "pool").count() >= 1
