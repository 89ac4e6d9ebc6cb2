"""Ranking, sampling, joins, metrics, geo and learners against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwave.functions.geo import grid_spec, haversine
from cartwave.learners import neighbours as nn
from cartwave.learners.boosting import BoostedClassifier, BoostedRegressor
from cartwave.learners.forest import fit_grouped_forest
from cartwave.learners.models import important_features, to_vectors
from cartwave.operators import joins, metrics, ranking, sampling
from cartwave.session import shared_dir


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows in one group, many equal values."""
    rnd = random.Random(1)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else f"g{rnd.randrange(40)}"
        v = rnd.choice([0.0, 5.25, rnd.random() * 30, rnd.random() * 3000])
        rows.append((i, g, v))
    return rows, spark.createDataFrame(rows, "id long, g string, v double").repartition(8)


def by_group(rows):
    out = {}
    for _, g, v in rows:
        out.setdefault(g, []).append(v)
    return {g: sorted(vs) for g, vs in out.items()}


@pytest.fixture(params=[(65_536, 1024), (40, 8)])
def bound(request, monkeypatch):
    """Windows of the size in use, and windows so small that every group is split, some buckets again and again."""
    monkeypatch.setattr(ranking, "BOUND", request.param[0])
    monkeypatch.setattr(ranking, "PARTS", request.param[1])
    return request.param[0]


def test_medians(hot, bound):
    rows, df = hot
    want = by_group(rows)
    got = {r.g: r["median"] for r in ranking.upper_median(df, ["g"], "v").collect()}
    assert got == {g: vs[len(vs) // 2] for g, vs in want.items()}
    mid = {r.g: r["median"] for r in ranking.middle_median(df, ["g"], "v").collect()}
    assert mid == pytest.approx({g: float(np.median(vs)) for g, vs in want.items()})


@pytest.mark.parametrize("values, want", [([1, 2, 3, 4], 3), ([5], 5), ([1, 2, 3], 2)])
def test_upper_median_golden(spark, values, want):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("g", F.lit(1))
    assert ranking.upper_median(df, ["g"], "v").first()["median"] == want


def test_sorted_curve(hot, bound):
    rows, df = hot
    got = {}
    for r in ranking.sorted_curve(df, ["g"], "v", chunk=7).collect():
        got.setdefault(r.g, {})[r["rank"]] = r.v
    want = {g: dict(enumerate(vs)) for g, vs in by_group(rows).items()}
    assert got == want


@pytest.mark.parametrize("k", [0, 1, 700, 2999, 3000, 5000])
def test_take_smallest(hot, bound, k):
    rows, df = hot
    got = sorted(r.id for r in ranking.take_smallest(df, "v", ["id"], k).collect())
    want = sorted(i for i, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))[:k])
    assert got == want
    flagged = ranking.take_smallest(df, "v", ["id"], k, flag="f").collect()
    assert len(flagged) == len(rows) and sorted(r.id for r in flagged if r.f) == want


def test_no_window_over_many_values_however_close(spark, monkeypatch):
    """A third of the values are equal, all others lie within 1/64, most of them within a millionth of that."""
    monkeypatch.setattr(ranking, "BOUND", 50)
    monkeypatch.setattr(ranking, "PARTS", 16)
    rnd = np.random.default_rng(4)
    values = [7.0] * 1000 + (7 + rnd.random(1500) / 64e6).tolist() + (7 + rnd.random(500) / 64).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(6)
    runs = ranking._runs(df, [], "v")
    placed = ranking._refined(runs, [], "v")
    sizes = [r["count"] for r in placed.groupBy("_path").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == len(set(values))
    assert len({r["_path"].rpartition(".")[0] for r in placed.collect()}) > 1  # buckets of several levels
    one = ranking._refined(runs, [], "v", F.lit(1700).cast("long"))
    assert one.count() <= 50
    want = sorted(values)
    got = {}
    for r in ranking.sorted_runs(df, [], "v").collect():
        got.update({r["rank_from"] + i: r["v"] for i in range(r["n"])})
    assert [got[i] for i in range(len(values))] == want
    # ties of a third of the rows are settled by the key, found by refinement too
    for k in (1, 500, 1000, 1003):
        chosen = {r.id for r in ranking.take_smallest(df, "v", ["id"], k).collect()}
        assert chosen == {i for _, i in sorted((v, i) for i, v in enumerate(values))[:k]}


def test_spread_join_equals_plain(spark, hot):
    _, df = hot
    right = df.select("g").distinct().where("g <> 'g3'").withColumn("w", F.length("g"))
    withnull = df.unionByName(spark.createDataFrame([(9999, None, 1.0)], df.schema))
    plain = sorted(map(str, withnull.join(right, ["g"], "left").collect()))
    salted = joins.spread_join(withnull, right, ["g"], ["id"], small_rows=0)
    assert sorted(map(str, salted.select("g", "id", "v", "w").collect())) == plain
    hot_list = joins.hot_keys(joins.row_weights(df, ["g"]), ["g"]).collect()
    assert {r.g: r._salts for r in hot_list}["hot"] > 100 and len(hot_list) < joins.HOT_SHARE
    spread = joins.spread_join(withnull, right, ["g"], ["id"], small_rows=0)
    assert "_salt" in spread._jdf.queryExecution().executedPlan().toString()


def labelled(spark, ones, zeros):
    rows = [(i, 1) for i in range(ones)] + [(1000 + i, 0) for i in range(zeros)]
    return spark.createDataFrame(rows, "id long, target int")


def test_balancing(spark):
    df = labelled(spark, 2, 7)
    down = sampling.balanced_down(df, ["id"]).collect()
    assert len(down) == 4 and sorted(r.id for r in down if r.target) == [0, 1]
    up = sampling.balanced_up(df, ["id"]).collect()
    assert sum(r.target for r in up) == 7 and len(up) == 14
    counts = {i: sum(r.id == i for r in up) for i in (0, 1)}
    assert sorted(counts.values()) == [3, 4]
    other = sampling.balanced_up(labelled(spark, 9, 4), ["id"]).collect()
    assert len(other) == 18


def test_splits_and_folds(spark):
    df = spark.range(5000)
    parts = sampling.repeated_splits(df, ["id"], range(3)).collect()
    for s in range(3):
        rows = [r for r in parts if r.split == s]
        assert len(rows) == 5000 and 0.17 < sum(r.is_test for r in rows) / 5000 < 0.23
    again = sampling.repeated_splits(df.repartition(5), ["id"], range(3)).collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, again))
    folds = [r.fold for r in sampling.with_fold(df, ["id"], 4).collect()]
    assert sorted(set(folds)) == [0, 1, 2, 3] and max(folds.count(f) for f in range(4)) < 1400


def test_exact_folds_share_each_class_evenly(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BOUND", 40)
    rows = [(i, i % 7, 1 if i % 10 == 0 else 0 if i % 11 else None) for i in range(1000)] + [(3, 3, 0)] * 5
    df = spark.createDataFrame(rows, "a long, b int, target int").repartition(5)
    got = sampling.with_exact_fold(df, ["a", "b"], 3)
    assert got.columns == [*df.columns, "fold"] and got.count() == len(rows)
    for target, sizes in ((t, [got.where((F.col("target") == t) & (F.col("fold") == f)).count() for f in range(3)]) for t in (0, 1)):
        assert sum(sizes) == sum(r[2] == target for r in rows) and max(sizes) - min(sizes) <= 1
    assert got.where("target is null and fold is not null").isEmpty()


def test_metric_goldens(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2
    df = spark.createDataFrame(pairs, "target int, prediction int")
    row = metrics.class_scores(df).first()
    assert row.auc == pytest.approx(0.708333, abs=1e-6) and row.accuracy == 0.7 and row.recall == 0.75
    maps = metrics.distribution_maps(metrics.prediction_distribution(df)).first()
    assert (maps.correct, maps.error) == (7, 3)
    assert maps.correct_counts == {0: 4, 1: 3} and maps.error_counts == {0: 1, 1: 2}
    truth = metrics.distribution_maps(metrics.prediction_distribution(df, wrong_by_truth=True)).first()
    assert truth.error_counts == {0: 2, 1: 1}
    reg = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "target double, prediction double")
    assert tuple(metrics.regression_scores(reg).first()) == (1.0, 1.0, 1.0)
    cells = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 2)], "target int, prediction int")
    got = metrics.top_cell_scores(cells).first()
    assert (got.recall, got.precision, got.accuracy) == pytest.approx((2 / 3, 0.5, 0.5))
    assert got.f == pytest.approx(0.571429, abs=1e-6)
    none = spark.createDataFrame([(1, 2), (2, 1)], "target int, prediction int")
    assert metrics.top_cell_scores(none).first().f == 0


def test_geo_goldens(spark):
    # fixed values: corners of the measured area
    box = spark.createDataFrame(
        [(31.28175691, 121.2012049), (31.29339344, 121.2183295)], "lat double, lon double")
    lo = F.lit(121.2012049)
    north = box.select(haversine(F.lit(31.28175691), lo, F.lit(31.29339344), lo)).first()[0]
    east = box.select(haversine(F.lit(31.28175691), lo, F.lit(31.28175691), F.lit(121.2183295))).first()[0]
    assert north == pytest.approx(1293.9231, abs=1e-4) and east == pytest.approx(1627.348605, abs=1e-4)
    spec = grid_spec(box, "lat", "lon").first()
    assert (spec.grid_rows, spec.grid_cols) == (65, 82)


def test_far_edge_is_in_the_last_cell(spark):
    from cartwave.operators.stations import with_cells

    box = spark.createDataFrame([(31.28, 121.20), (31.29, 121.21)], "Latitude double, Longitude double")
    spec = grid_spec(box, "Latitude", "Longitude").first()
    top = with_cells(box).agg(F.max("Target")).first()[0]
    assert top == spec.grid_rows * spec.grid_cols - 1


@pytest.mark.parametrize("block, leaf", [(4096, 2048), (60, 10), (7, 3)])
def test_nearest_equals_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(nn, "BLOCK", block)
    monkeypatch.setattr(nn, "LEAF", leaf)
    rnd = np.random.default_rng(3)
    train = rnd.integers(0, 6, (300, 3)).astype(float)
    train[:100] = train[0]  # a third of the rows are copies
    test = rnd.integers(0, 6, (80, 3)).astype(float)
    label = rnd.integers(0, 2, 300)
    cols = "id long, a double, b double, c double, target double"
    tr = spark.createDataFrame([(i, *map(float, x), float(y)) for i, (x, y) in enumerate(zip(train, label))], cols)
    te = spark.createDataFrame([(i, *map(float, x), 0.0) for i, x in enumerate(test)], cols)
    found = nn.nearest(tr, te, ["a", "b", "c"], 3, "id", "id").collect()
    got = {}
    for r in found:
        got.setdefault(r.test_id, []).append((r.d, r.key))
    for i, x in enumerate(test):
        d = ((train - x) ** 2).sum(axis=1)
        assert sorted(got[i]) == sorted((d[j], j) for j in range(300))[:3]
    votes = {r.id: r.prediction for r in nn.vote(nn.nearest(tr, te, ["a", "b", "c"], 3, "id", "id"), "id").collect()}
    for i, near in got.items():
        assert votes[i] == float(sum(label[j] for _, j in near) >= 2)


def test_search_of_clustered_rows_meets_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(nn, "LEAF", 50)
    rnd = np.random.default_rng(9)
    centres = rnd.uniform(0, 1000, (40, 6))
    train = centres[rnd.integers(0, 40, 4000)] + rnd.normal(size=(4000, 6))
    test = np.r_[centres[rnd.integers(0, 40, 300)] + rnd.normal(size=(300, 6)), rnd.uniform(0, 1000, (20, 6))]
    known = spark.createDataFrame([(i, float(i % 3), list(map(float, x))) for i, x in enumerate(train)], "key long, label double, x array<double>")
    asked = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(test)], "test_id long, x array<double>")
    got = {}
    for r in nn.nearest_vectors(known, asked, 5).collect():
        got.setdefault(r.test_id, []).append((r.d, r.key))
    for i, x in enumerate(test):
        d = ((train - x) ** 2).sum(axis=1)
        assert {j for _, j in got[i]} == set(np.argsort(d, kind="stable")[:5].tolist())
    placed, tree = nn.grown(known)
    waiting = nn._placed(asked, tree)
    own = nn._pick(nn._met(waiting.select("test_id", "x", "leaf"), placed, tree, 5), ["test_id"], ["d", "key"], 5)
    met = nn.further_leaves(waiting, own, tree, 5).groupBy("leaf").count().collect()
    leaves, pairs = int((tree.counts > 0).sum()), len(test) + sum(r["count"] for r in met)
    rows = len(test) / len(tree.counts) * len(train) + sum(r["count"] * tree.counts[r["leaf"]] for r in met)
    assert leaves > 40 and pairs < 0.1 * leaves * len(test) and rows < 0.1 * len(train) * len(test)


def test_forest_finds_planted_steps(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        g = 0 if i % 3 else 1 + i % 7  # one group holds two thirds
        a, b = rnd.random(2)
        y = (10.0 if a > 0.5 else 0.0) + g
        rows.append((i, g, float(a), float(b), 7.0, y, -y))
    df = spark.createDataFrame(rows, "id long, g int, a double, b double, c double, y double, z double")
    model = fit_grouped_forest(df, ["g"], ["a", "b", "c"], ["y", "z"], "id", trees=5, depth=3, feature_share=1.0)
    got = model.predict(df).collect()
    assert len(got) == 1500
    wrong = [abs(r.pred_y - r.y) for r in got]
    assert np.mean(wrong) < 1.0 and np.mean([abs(r.pred_z - r.z) for r in got]) < 1.0
    again = fit_grouped_forest(
        df.repartition(3), ["g"], ["a", "b", "c"], ["y", "z"], "id", trees=5, depth=3, feature_share=1.0)
    other = {r.id: r.pred_y for r in again.predict(df).collect()}
    assert all(other[r.id] == pytest.approx(r.pred_y) for r in got)
    unknown = df.limit(1).withColumn("g", F.lit(99))
    assert model.predict(unknown).first().pred_y is None


def test_forest_stump_equals_brute_force(spark):
    """One level, all features: the split and both means, on the bootstrap weights."""
    from cartwave.learners.forest import POISSON

    rnd = np.random.default_rng(8)
    x, y = rnd.random((200, 2)), rnd.random(200)
    df = spark.createDataFrame([(i, 0, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))],
                               "id long, g int, a double, b double, y double")
    model = fit_grouped_forest(df, ["g"], ["a", "b"], ["y"], "id", trees=1, depth=1, bins=8, feature_share=1.0)
    got = {r.id: r.pred_y for r in model.predict(df).collect()}
    u = {r.id: r.u for r in df.withColumn("tree", F.lit(0)).select(
        "id", (F.pmod(F.xxhash64(F.lit(0), "tree", "id"), F.lit(1 << 20)) / float(1 << 20)).alias("u")).collect()}
    w = np.array([sum(u[i] >= p for p in POISSON) for i in range(200)], dtype=float)
    lo, hi = x.min(axis=0), x.max(axis=0)
    bins = np.minimum(7, np.floor((x - lo) / (hi - lo) * 8)).astype(int)
    best = None
    for f in range(2):
        for s in range(7):
            left = bins[:, f] <= s
            a, b = w[left].sum(), w[~left].sum()
            if a and b:
                sa, sb = (w * y)[left].sum(), (w * y)[~left].sum()
                gain = sa * sa / a + sb * sb / b
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, s, sa / a, sb / b)
    _, f, s, ml, mr = best
    for i in range(200):
        assert got[i] == pytest.approx(ml if bins[i, f] <= s else mr)


def planted(spark, n=400):
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(n):
        a, b, c = rnd.random(3)
        rows.append((i, float(a), float(b), float(c), float(a + 0.3 * b > 0.7), float(5 * a + b)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, target double, amount double")


def test_boosting_beats_one_stump(spark):
    v = to_vectors(planted(spark).drop("amount"), ["id"])
    scores = []
    for rounds in (1, 8):
        done = BoostedClassifier(rounds=rounds).fit(v)
        scores.append(metrics.class_scores(done.transform(v)).first().accuracy)
    assert scores[1] > scores[0] and scores[1] > 0.9


def test_boosted_regression_and_importance(spark):
    df = planted(spark)
    v = to_vectors(df.drop("target").withColumnRenamed("amount", "target"), ["id"])
    done = BoostedRegressor(rounds=6, depth=3).fit(v)
    assert metrics.regression_scores(done.transform(v)).first().evs > 0.8
    assert important_features(df, ["a", "b", "c"]) == ["a"]


class FakeSession:
    """Only what ``shared_dir`` asks of a session."""

    def __init__(self, named, master="local[2]"):
        self.conf = {"spark.checkpoint.dir": named} if named else {}
        self.sparkContext = type("C", (), {"master": master, "applicationId": f"app-{master}"})()


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(FakeSession("hdfs://shared/ckpt/", "yarn")) == "hdfs://shared/ckpt"
    own = shared_dir(FakeSession(None))
    assert own and own == shared_dir(FakeSession(None))
    with pytest.raises(ValueError):
        shared_dir(FakeSession(None, "yarn"))


def test_read_reports_csv(spark, tmp_path):
    from cartwave.sources.reports import read_reports_csv, read_stations_csv, report_header

    header = report_header()
    values = ["460", "2018", "121.2", "31.2", "1"] + ["15", "7", "1.5", "2", "-60"] + [""] * 30
    (tmp_path / "mr.csv").write_text(",".join(header) + "\n" + ",".join(values) + "\n")
    row = read_reports_csv(spark, str(tmp_path / "mr.csv")).first()
    assert row.CellID_1 == 7 and row.RSSI_1 == -60.0 and row.CellID_2 is None and row.Longitude == 121.2
    (tmp_path / "st.csv").write_text("RNCID,CellID,Longitude,Latitude\n15,7,121.1,31.1\n")
    assert tuple(read_stations_csv(spark, str(tmp_path / "st.csv")).first()) == (15, 7, 121.1, 31.1)
    assert math.isclose(row.Latitude, 31.2)


def test_near_rows_are_chosen_before_they_are_sorted(monkeypatch):
    """A block's exact distances are those of feature-wise sums, for the few rows that a matrix product leaves."""
    rng, measured = np.random.default_rng(4), []
    plain = nn._squares
    monkeypatch.setattr(nn, "_squares", lambda a, b: measured.append(max(len(a), len(b))) or plain(a, b))
    for scale, shift in ((1.0, 0.0), (1e-6, 3e4), (1e180, 0.0)):
        known = np.vstack([rng.integers(0, 3, (200, 4)), rng.normal(size=(200, 4))]) * scale + shift
        asked = np.vstack([rng.integers(0, 3, (60, 4)), rng.normal(size=(60, 4))]) * scale + shift
        with np.errstate(over="ignore"):
            d = plain(asked[:, None], known[None])
            got = nn._least(asked, known, 5)
        order = np.argsort(d, axis=1, kind="stable")[:, :5]
        assert (got[1] == order).all() and (got[0] == np.take_along_axis(d, order, 1)).all()
    assert measured[0] < 120 * 400 / 4
