"""Cases that once gave wrong answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwave.learners import models as ml
from cartwave.learners.forest import fit_grouped_forest
from cartwave.operators import metrics, sampling
from cartwave.session import _delete, cut, fresh_path
from cartwave.sources.trade import canonical


def test_large_ids_stay_whole(spark):
    rows = [("9007199254740993", "1234567890123456789", "12.0", "1e30", "2018-02-03", "1.50"), ("x", "7", None, "3", "bad", "y")]
    raw = spark.createDataFrame(rows, "vipno string, pluno string, bndno string, dptno string, sldat string, amt string")
    got = [(r.user_id, r.item_id, r.brand_id, r.cat_id) for r in canonical(raw).collect()]
    assert got == [(9007199254740993, 1234567890123456789, 12, None), (None, 7, -1, 3)]


def test_repeated_test_rows_get_the_same_neighbours(spark):
    train = ml.to_vectors(spark.createDataFrame([(i, float(i), int(i < 3)) for i in range(9)], "id long, a double, target int"), ["id"])
    test = ml.to_vectors(spark.createDataFrame([(1, 1.0, 1), (1, 1.0, 1), (2, 7.0, 0)], "id long, a double, target int"), ["id"])
    got = ml.Neighbours(3).fit(train).transform(test).select("id", "prediction", "score").collect()
    assert sorted(map(tuple, got)) == [(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 0.0, 0.0)]


def line(spark, n=1000):
    x = np.random.default_rng(0).normal(size=n)
    rows = [(i, float(v), 3.0 * float(v)) for i, v in enumerate(x)]
    return x, ml.to_vectors(spark.createDataFrame(rows, "id long, a double, target double"), ["id"])


def test_ridge_is_the_closed_form(spark):
    x, train = line(spark)
    for alpha in (0.5, 200.0):
        slope = ml.linear("ridge", alpha, len(x), float(3 * x.std())).fit(train).coefficients[0]
        c = x - x.mean()
        assert slope == pytest.approx((c @ (3 * c)) / (c @ c + alpha), rel=1e-4)


def test_lasso_is_soft_thresholding(spark):
    x, train = line(spark)
    c = x - x.mean()
    slope = ml.linear("lasso", 0.5, len(x)).fit(train).coefficients[0]
    assert slope == pytest.approx((c @ (3 * c) / len(x) - 0.5) / (c @ c / len(x)), rel=1e-3)


def test_l1_does_not_scale_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    rows = [(i, float(v), int(v + rng.normal() > 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, target int")
    weights = []
    for scale in (1.0, 100.0):
        train = ml.to_vectors(df.withColumn("a", F.col("a") / scale), ["id"])
        weights.append(ml.l1_logistic(0.05, 400).fit(train).coefficients[0])
    assert weights[0] > 0.3 and weights[1] == pytest.approx(0, abs=1e-6)


def test_rank_auc_counts_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), int(y), float(s)) for g, y, s in zip(rng.integers(0, 3, 300), rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 7)]
    df = spark.createDataFrame(rows, "fold int, target int, s double")
    for r in metrics.rank_auc(df, ["fold"], "s").collect():
        a = np.array([s for g, y, s in rows if g == r.fold and y == 1])
        b = np.array([s for g, y, s in rows if g == r.fold and y == 0])
        want = ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))
        assert r.rank_auc == pytest.approx(want)


def test_forest_refuses_bins_that_its_codes_cannot_hold(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 2.0)], "g int, id long, a double, y double")
    with pytest.raises(ValueError, match="64"):
        fit_grouped_forest(df, ["g"], ["a"], ["y"], "id", bins=65)


def test_few_rows_repeated_often_are_spread(spark):
    n = 400_000
    rows = spark.range(n + 2).selectExpr("id", "cast(id < 2 as int) as target")
    got = sampling.balanced_up(rows, ["id"])
    ones = cut(got.where("target = 1"))
    assert ones.groupBy("id").count().orderBy("id").collect() == [(0, n // 2), (1, n // 2)]
    per_task = [len(p) for p in got.where("target = 1").select("id").rdd.glom().collect()]
    assert sum(per_task) == n and max(per_task) < n / 3


def test_stored_tables_can_be_deleted(spark, tmp_path):
    path = fresh_path(spark, "x")
    assert spark.sparkContext.applicationId in path
    spark.range(3).write.parquet(str(tmp_path / "t"))
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
