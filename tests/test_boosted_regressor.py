"""What boosting of amounts leaves in the shared folder."""

import os

from pyspark.ml.linalg import Vectors

from cartwave import session
from cartwave.learners import boosting


def test_rows_of_earlier_rounds_are_deleted(spark, monkeypatch):
    """Every few rounds left another copy of all vectors."""
    rows = spark.createDataFrame([(Vectors.dense([float(i % 17), float(i % 5)]), float(i % 17 * (i % 3))) for i in range(300)], ["features", "target"])
    paths, most = [], []
    made = session.fresh_path

    def fresh(*args):
        paths.append(made(*args))
        most.append(sum(os.path.exists(p) for p in paths))
        return paths[-1]

    monkeypatch.setattr(session, "fresh_path", fresh)
    model = boosting.BoostedRegressor(rounds=11).fit(rows)
    assert len(model.rounds) == 11 and len(paths) == 3
    assert max(most) <= 1  # beside the one that is about to be written
    assert not any(map(os.path.exists, paths))
    assert model.transform(rows).where("prediction is null").count() == 0
