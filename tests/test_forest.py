import random

import pytest

from cartwave.learners import forest
from cartwave.learners.forest import fit_grouped_forest


def _rows(spark, most=60):
    """Groups of 1 to ``most`` rows with whole targets, so that sums do not depend on their order."""
    rng = random.Random(5)
    rows = []
    for g in range(12):
        for _ in range(1 + g * most // 12):
            a, b = rng.randrange(9), rng.random()
            y = None if g == 7 and a == 3 else float(10 * (a > 3) + 4 * (b > 0.5) + rng.randrange(3))
            rows.append((f"s{g}", g % 2, len(rows), float(a), b, None if g == 5 and a > 6 else -float(a), 3.0, y, float(a - g)))
    rows += [(None, 1, len(rows) + i, 1.0, 1.0, 1.0, 3.0, 2.0, 2.0) for i in range(5)]
    return spark.createDataFrame(rows, "g string, h int, id long, a double, b double, c double, d double, y double, z double").repartition(4)


def _model(df, **options):
    model = fit_grouped_forest(df, ["g", "h"], ["d", "a", "b", "c"], ["y", "z"], "id", trees=4, depth=3, bins=8, feature_share=0.6, **options)
    return model, {(r["g"], r["h"]): (r["codes"], r["mean0"], r["mean1"], r["lo"], r["hi"]) for r in model.model.collect()}


def _close(a, b):
    """Equal but for the last bits; nulls meet nulls."""
    assert [x is None for x in a] == [x is None for x in b]
    assert [x for x in a if x is not None] == pytest.approx([x for x in b if x is not None], rel=1e-12)


def test_small_groups_grow_the_same_trees_as_large_ones(spark, monkeypatch):
    df = _rows(spark).cache()
    monkeypatch.setattr(forest, "WHOLE_ROWS", 0)
    by_level, expected = _model(df)
    monkeypatch.setattr(forest, "WHOLE_ROWS", 4 * 40)
    mixed, found = _model(df)
    assert found.keys() == expected.keys()
    assert len(expected) >= 11
    for key, (codes, *rest) in expected.items():
        assert found[key][0] == codes, key
        for a, b in zip(found[key][1:], rest):
            _close(a, b)
    scored = {r["id"]: (r["pred_y"], r["pred_z"]) for r in mixed.predict(df).collect()}
    for r in by_level.predict(df).collect():
        _close(scored[r["id"]], (r["pred_y"], r["pred_z"]))


def test_small_groups_are_grown_without_a_pass_per_level(spark, monkeypatch):
    """Histograms of every level were shuffled for all groups, however small."""
    df = _rows(spark).where("g <> 's7'")

    def passes(*args):
        raise AssertionError("a pass over the rows per level")

    monkeypatch.setattr(forest, "_best_splits", passes)
    assert len(_model(df)[1]) == 11
