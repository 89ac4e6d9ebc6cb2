"""Nearest neighbours: recall and scores against brute force, the pigeonhole guarantee, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwave.llm import neighbours as n
from cartwave.llm.common import table
from cartwave.llm.queries import op9_nearest_neighbours


def brute(ids, v, query, k=20):
    score = v @ v[ids == query][0]
    score[ids == query] = -np.inf
    order = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
    return ids[order].tolist(), score[order]


def recall(got, ids, v):
    hits = total = 0
    for query, rows in got.groupby("query_id"):
        rows = rows.sort_values("rank")
        want, score = brute(ids, v, query)
        hits += len(set(want) & set(rows["vec_id"]))
        total += len(want)
        assert rows["rank"].tolist() == list(range(1, len(rows) + 1)) and query not in set(rows["vec_id"])
        own = np.array([v[ids == i][0] @ v[ids == query][0] for i in rows["vec_id"]])
        assert np.allclose(rows["score"], own, atol=1e-12) and (np.diff(rows["score"]) <= 0).all()
    return hits / total


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = table(spark, sf, "embeddings").toPandas()
    got = op9_nearest_neighbours(spark, sf).toPandas()
    assert got["query_id"].nunique() == (rows["vec_id"] % 20 == 0).sum() and (got.groupby("query_id").size() == 20).all()
    assert recall(got, rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(float)) >= 0.9


def test_vectors_of_different_lengths(spark, monkeypatch):
    monkeypatch.setattr(n, "ROWS", 300)
    monkeypatch.setattr(n, "QUERIES", 20)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2000, 24)) * rng.uniform(0.5, 2, (2000, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = n.search(df, F.col("id") % 20 == 0).toPandas()
    assert recall(got, np.arange(2000), v) >= 0.9


@pytest.mark.parametrize("radius", [0, 3, 7, 8, 20, 47, 64])
def test_every_code_within_the_radius_is_found(radius):
    rng = np.random.default_rng(radius)
    index = rng.integers(0, 1 << 16, (400, n.SUBSTRINGS), dtype=np.uint16)
    flips = rng.integers(0, 70, 60)
    asked = np.unpackbits(index[:60].view(np.uint8), axis=1)
    for row, f in zip(asked, flips, strict=True):
        row[rng.permutation(n.BITS)[:f]] ^= 1
    asked = np.packbits(asked, axis=1).view(np.uint16)
    far = np.bitwise_count(asked[:, None] ^ index).sum(2)
    assert [x.tolist() for x in n.within(asked, index, radius)] == [np.nonzero(r <= radius)[0].tolist() for r in far]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]),
        (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (40, [1.0, 2.0, 3.0]), (60, None), (2**60, [-1.0, 0.0]), (9, []),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "code", "query", "b")})
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in n.search(df, F.col("id") % 20 == 0).collect()}
    assert got == {
        (0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (20, 0.0), (0, 4): (2**60, -1.0),
        (20, 1): (1, 2.0), (20, 2): (2, 2.0), (20, 3): (0, 0.0), (20, 4): (2**60, 0.0),
        **({(2**60, 1): (20, 0.0), (2**60, 2): (0, -1.0), (2**60, 3): (1, -1.0), (2**60, 4): (2, -1.0)} if 2**60 % 20 == 0 else {}),
    }
    for none in (df.limit(0), df.where("vec_id = 3"), df.where("vec_id in (1, 2)")):
        assert n.search(none, F.col("id") % 20 == 0).count() == 0


def test_outliers_of_dense_groups_have_all_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(n, "ROWS", 700)
    monkeypatch.setattr(n, "QUERIES", 30)
    rng = np.random.default_rng(4)
    centre = np.repeat(rng.normal(size=(20, 32)), 98, axis=0)
    v = np.vstack([centre + 0.01 * rng.normal(size=centre.shape), rng.normal(size=(40, 32))])
    # a quarter of the outliers are queries, and there is one query that all else is opposite to
    v[-1] = -10 * centre.mean(0)
    ids = np.arange(len(v))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = (F.col("id") % 20 == 0) | ((F.col("id") >= 1960) & (F.col("id") % 4 == 3))
    got = n.search(df, asked).toPandas()
    sizes = got.groupby("query_id").size()
    assert set(sizes.index) == {i for i in range(2000) if i % 20 == 0 or i >= 1960 and i % 4 == 3} and (sizes == 20).all()
    assert recall(got, ids, v) >= 0.8
