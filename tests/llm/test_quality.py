"""Quality classifier: held-out accuracy, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from cartwave.llm import quality
from cartwave.llm.common import held_out, table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.train(docs, labels)
    got = (
        docs.join(labels, "doc_id").where(held_out())
        .select("quality", (quality.score(docs, model) >= quality.THRESHOLD).cast("int").alias("predicted")).toPandas()
    )
    assert len(got) > 500
    assert (got["quality"] == got["predicted"]).mean() > 0.99


def test_features_are_a_sparse_vector_of_the_whole_text():
    words = quality._Words()
    ids, x = quality.features("A b  a b c9 " * 5000 + "tail", words)
    more, _ = quality.features("A b  a b c9 " * 5000 + "other", words)
    assert not np.array_equal(ids, more)
    assert quality.features("", words)[0].tolist() == [0]
    assert quality.features("one", words)[1].tolist()[0] == 1.0


def test_ftrl_learns_a_separable_set():
    words = quality._Words()
    texts = [f"good word{i} line" for i in range(60)] + [f"bad$$ bad$$ word{i}" for i in range(60)]
    rows = [quality.features(t, words) for t in texts]
    w = quality.ftrl(rows, [1] * 60 + [0] * 60, 3, 0)
    score = np.array([w[i] @ x for i, x in rows])
    assert score[:60].min() > score[60:].max()


def test_odd_rows(spark):
    rows = [(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "x " * 300_000, 3.0), (3, "a | b | c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = docs.withColumn("p", quality.score(docs, model)).collect()
    assert len(got) == 5 and all(0 <= r["p"] <= 1 for r in got)
    assert len({r["p"] for r in got if not r["text"]}) == 1
    assert quality.accepted(docs, labels).columns == docs.columns
    nothing = quality.train(docs, labels.limit(0))
    assert {r[0] for r in docs.select(quality.score(docs, nothing)).collect()} == {0.5}
    assert docs.limit(0).select(quality.score(docs, model)).count() == 0


def test_held_out_rows_are_not_learnt(spark):
    out = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame([(i, f"w{i} " * 20) for i in out], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in out], "doc_id long, quality int")
    assert not quality.train(docs, labels).any()
