"""Boosting over many classes against plain numpy, for several splits at once."""

from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwave.learners import multiclass as mc

N, CLASSES, SPLITS = 400, 23, 3


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(N, 2)), rng.integers(0, 5, N), np.full(N, 7.0)]
    y = ((x[:, 0] > 0) * 2 + (x[:, 1] > 0.5)) * 5 + x[:, 2].astype(int)
    y = np.where(rng.random(N) < 0.1, rng.integers(0, CLASSES, N), y)
    trains = rng.random((N, SPLITS)) < 0.8
    rows = [(i, *map(float, x[i]), int(y[i]), *map(bool, trains[i])) for i in range(N)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, target int, t0 boolean, t1 boolean, t2 boolean")
    stored = mc.prepared(df.repartition(5), ["a", "b", "c", "d"], "target", [F.col(f"t{s}") for s in range(SPLITS)], ["id"])
    back = sorted(stored.collect(), key=lambda r: r["id"])
    bins = np.array([r["bins"] for r in back])
    low, high = x.min(0), x.max(0)
    want = np.where(high > low, np.clip(np.floor((x - low) / np.where(high > low, high - low, 1) * mc.BINS), 0, mc.BINS - 1), 0)
    assert (bins == want).all()
    return stored, bins, y, trains


def plain_stump(bins, y, w):
    """(feature, bin, left, right, error) by trying every cut."""
    best = None
    for f in range(bins.shape[1]):
        for b in range(mc.BINS):
            left = bins[:, f] <= b
            if not left.any() or left.all():
                continue
            sums = [np.bincount(y[side], w[side], CLASSES) for side in (left, ~left)]
            gain = sum((s**2).sum() / s.sum() for s in sums)
            if best is None or gain > best[0] + 1e-9:
                best = gain, f, b, sums[0].argmax(), sums[1].argmax()
    _, f, b, l, r = best
    miss = np.where(bins[:, f] <= b, l, r) != y
    return f, b, int(l), int(r), float(w[miss].sum() / w.sum())


def test_stumps_equal_plain_boosting(data):
    rows, bins, y, trains = data
    got = mc.boost_stumps(rows, CLASSES, SPLITS, rounds=6)
    for s in range(SPLITS):
        b, c = bins[trains[:, s]], y[trains[:, s]]
        w = np.ones(len(c))
        for stump in got[s]:
            f, cut, l, r, error = plain_stump(b, c, w)
            assert (stump.feature, stump.bin, stump.left, stump.right) == (f, cut, l, r)
            assert stump.error == pytest.approx(error)
            alpha = log((1 - error) / error) + log(CLASSES - 1)
            assert stump.alpha == pytest.approx(alpha)
            w = w * np.exp(alpha * (np.where(b[:, f] <= cut, l, r) != c))
        assert len(got[s]) == 6
    votes = mc.predicted(rows, [mc.stump_classes(m, CLASSES) for m in got], "id").collect()
    assert {(r["split"], r["id"]) for r in votes} == {(s, i) for s in range(SPLITS) for i in np.flatnonzero(~trains[:, s])}
    for r in votes:
        tally = np.zeros(CLASSES)
        for st in got[r["split"]]:
            tally[st.left if bins[r["id"], st.feature] <= st.bin else st.right] += st.alpha
        assert r["prediction"] == tally.argmax()


def plain_softmax(bins, y, rounds, depth, rate):
    """Scores of the training rows by dense softmax boosting with one tree of vector leaves per round."""
    scores = np.log(np.maximum(np.bincount(y, minlength=CLASSES) / len(y), 1e-12))[None].repeat(len(y), 0)
    for _ in range(rounds):
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.eye(CLASSES)[y] - p
        node = np.ones(len(y), int)
        for _ in range(depth):
            new = node * 2
            for n in np.unique(node):
                at, best = node == n, None
                for f in range(bins.shape[1]):
                    for b in range(mc.BINS):
                        left = at & (bins[:, f] <= b)
                        if not left.any() or left.sum() == at.sum():
                            continue
                        gain = sum((g[m].sum(0) ** 2).sum() / m.sum() for m in (left, at & ~left))
                        if best is None or gain > best[0] + 1e-9:
                            best = gain, f, b
                if best:
                    new[at] += bins[at, best[1]] > best[2]
            node = new
        for n in np.unique(node):
            at = node == n
            scores[at] += rate * (CLASSES - 1) / CLASSES * g[at].sum(0) / np.maximum((p[at] * (1 - p[at])).sum(0), 1e-150)
    return scores


def test_softmax_equals_dense_boosting(data):
    rows, bins, y, trains = data
    got = mc.boost_softmax(rows, CLASSES, SPLITS, rounds=3, depth=2, rate=0.3, sketch=CLASSES)
    for s in range(SPLITS):
        b, c = bins[trains[:, s]], y[trains[:, s]]
        assert got[s].scores(b) == pytest.approx(plain_softmax(b, c, 3, 2, 0.3), abs=1e-6)


def test_sketched_splits_find_the_classes(data):
    rows, bins, y, trains = data
    for m, t in zip(mc.boost_softmax(rows, CLASSES, SPLITS, rounds=8, rate=0.5), trains.T, strict=True):
        right = mc.softmax_classes(m)(bins[~t]) == y[~t]
        assert right.mean() > 3 * np.bincount(y).max() / N


def test_one_class_and_no_rows(spark, data):
    rows = data[0]
    same = rows.withColumn("class", F.lit(0))
    assert [len(m) for m in mc.boost_stumps(same, 1, SPLITS, 5)] == [1] * SPLITS
    empty = mc.boost_stumps(rows.limit(0), CLASSES, SPLITS, 5)
    assert empty == [[]] * SPLITS
    assert mc.predicted(rows.limit(0), [mc.stump_classes(m, CLASSES) for m in empty], "id").count() == 0


def test_cells_of_few_classes_are_summed_without_sorting(monkeypatch):
    """Every round sorted all bins of all rows."""
    rng = np.random.default_rng(3)
    bins, own, w = rng.integers(0, mc.BINS, (500, 7)), rng.integers(0, 2, 500), rng.random(500)
    bins[:, 3] = 4
    place = (np.arange(7) * mc.BINS + bins) * 2 + own[:, None]
    expected, back = np.unique(place, return_inverse=True)
    sums = np.bincount(back.ravel(), np.repeat(w, 7))
    monkeypatch.setattr(mc.np, "unique", lambda *a, **k: pytest.fail("sorted"))
    keys, held = mc.cell_sums(bins, own, w, 2)
    assert (keys == expected).all() and (held == sums).all()
