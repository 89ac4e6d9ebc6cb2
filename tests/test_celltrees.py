"""Trees over many classes against Spark's, which grow the same ones where nothing is drawn."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cartwave.learners import celltrees as ct
from cartwave.learners import multiclass as mc
from cartwave.plans import positioning as pos

FEATURES, CLASSES, N = ["a", "b", "c", "d"], 40, 900


@pytest.fixture(scope="module")
def known(spark):
    rng = np.random.default_rng(2)
    x = np.c_[rng.normal(size=(N, 2)), rng.integers(0, 4, N), np.full(N, 3.0)]
    y = (x[:, 0] > 0.3) * 20 + (x[:, 1] > -0.2) * 10 + x[:, 2].astype(int)
    y = np.where(rng.random(N) < 0.2, rng.integers(0, CLASSES, N), y)
    rows = [(i, *map(float, r), float(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, target double").repartition(3)
    meta = {"ml_attr": {"type": "nominal", "num_vals": CLASSES}}
    df = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    return df.withColumn("target", F.col("target").alias("target", metadata=meta)).cache()


def _found(model, known):
    return {(r["split"], r["row_id"]): r["prediction"] for r in model.predict_splits(known, FEATURES, CLASSES, 3).collect()}


def test_a_tree_is_sparks(known, monkeypatch):
    tree = DecisionTreeClassifier(maxDepth=6, labelCol="target", seed=0)
    expected = _found(pos.PerSplit(tree), known)
    monkeypatch.setattr(pos, "PerSplit", lambda *_: pytest.fail("a pass over the rows for every few nodes"))
    monkeypatch.setattr(ct, "SUMS", 256)
    found = _found(pos.SplitTrees(tree), known)
    assert found.keys() == expected.keys()
    assert np.mean([found[k] == expected[k] for k in found]) > 0.99


def test_forests_vote_and_repeat_themselves(known):
    truth = {r["row_id"]: r["target"] for r in known.select("row_id", "target").collect()}
    for kind in ("auto", "all"):
        model = pos.SplitTrees(RandomForestClassifier(numTrees=10, maxDepth=8, featureSubsetStrategy=kind, labelCol="target", seed=0))
        found = _found(model, known)
        assert np.mean([truth[r] == p for (_, r), p in found.items()]) > 0.6
        assert _found(model, known.repartition(5)) == found


def test_a_larger_table_or_another_setting_goes_to_spark(known, monkeypatch):
    assert ct.grower_of(DecisionTreeClassifier(minInstancesPerNode=3), 4) is None
    tree = DecisionTreeClassifier(maxDepth=2, labelCol="target", seed=0)
    expected = _found(pos.PerSplit(tree), known)
    monkeypatch.setattr(ct, "WHOLE_VALUES", 10)
    monkeypatch.setattr(ct, "predicted", lambda *_: pytest.fail("a table beyond the bound"))
    assert _found(pos.SplitTrees(tree), known) == expected


def test_a_task_of_a_stump_round_hands_on_one_row_per_split_and_feature(spark, monkeypatch):
    """Every batch of rows handed on a row per split, feature, bin and class."""
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame(
        [(int(c), list(map(int, b)), [bool(t), True]) for c, b, t in zip(rng.integers(0, 30, 500), rng.integers(0, 32, (500, 3)), rng.random(500) < 0.7)],
        "class int, bins array<int>, trains array<boolean>").repartition(40).cache()
    assert mc.few_parts(rows).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    expected = mc.stump_round(rows, 30, [[], []], [0, 1])
    monkeypatch.setattr(mc, "HELD", 1)  # a pass per split
    assert mc.stump_round(rows, 30, [[], []], [0, 1]) == expected
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        handed = mc.few_parts(rows)
        seen = []
        monkeypatch.setattr(type(rows), "mapInArrow", lambda df, f, schema, _m=type(rows).mapInArrow: seen.append(_m(df, f, schema)) or seen[-1])
        assert mc.stump_round(rows, 30, [[], []], [0, 1]) == expected
        assert sum(t.count() for t in seen) <= 2 * 3 * handed.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_probabilities_are_worked_out_once_per_path():
    rng = np.random.default_rng(4)
    trees = [mc.VectorTree(2, rng.integers(0, 3, 4), rng.integers(8, 24, 4), rng.normal(size=(4, 9))) for _ in range(3)]
    model, bins = mc.SoftmaxModel(rng.normal(size=9), 0.3, trees), rng.integers(0, 32, (2000, 3)).astype(np.uint8)
    expected = model.scores(bins).argmax(1)
    first, path = model.paths(bins)
    assert len(first) <= 4**3 and (model.scores(bins[first])[path] == model.scores(bins)).all()
    assert (mc.softmax_classes(model)(bins) == expected).all()
