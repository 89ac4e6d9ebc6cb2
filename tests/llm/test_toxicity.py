"""Toxicity: kernel against its definition, held-out accuracy, gapped insults, odd rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from cartwave.llm import toxicity as t
from cartwave.llm.common import held_out, table


def by_definition(a: str, b: str) -> float:
    """Kernel of two words, by counting common subsequences."""

    def counts(w):
        codes = [62, *[int(t._LETTER[ord(c)]) for c in w], 63]
        out = {}
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if k - i < t.SPAN:
                key = codes[i], codes[j], codes[k]
                out[key] = out.get(key, 0) + t.DECAY ** (k - i - 2)
        size = sum(t.DECAY ** (2 * (k - i - 2)) for i, _, k in itertools.combinations(range(len(codes)), 3) if k - i < t.SPAN)
        return out, np.sqrt(size)

    (x, n), (y, m) = counts(a), counts(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (n * m)


def test_kernel_is_its_definition():
    words = ["stupid", "stxupid", "banana", "a", "ab", "zebra", "ananas", "sttuuppiidd"]
    rows, of = t.letters(words)
    assert of.tolist() == list(range(len(words)))
    got = t.kernel(rows, rows)
    want = np.array([[by_definition(a, b) for b in words] for a in words])
    assert np.allclose(got, want, atol=1e-5)
    assert got[0, 1] > 3 * got[0, 2]


def test_folded_table_scores_as_the_landmarks_do():
    rng = np.random.default_rng(1)
    marks, words = ["idiot", "clown", "tree"], ["idioot", "clowns", "treetop", "other"]
    beta = rng.normal(size=3)
    model = t.Model(t._table(t.letters(marks)[0], beta), 0.25, 1.0, 0.0)
    want = t.kernel(t.letters(words)[0], t.letters(marks)[0]) @ beta + 0.25
    assert np.allclose(model.decide(words), want, atol=1e-5)


def test_held_out_accuracy_and_gaps(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = t.train(docs, labels)
    got = (
        docs.join(labels, "doc_id").where(held_out())
        .select("toxic", (t.score(docs, model) >= t.THRESHOLD).cast("int").alias("predicted")).toPandas()
    )
    assert (got["toxic"] == got["predicted"]).mean() > 0.97
    assert got["predicted"][got["toxic"] == 1].mean() > 0.9
    clean = "The that of and this was with heer, tionan."
    odd = ["stxupid", "s t u p i d", "i.d.i.o.t", "mo-ron", "wor7hless", "cl0wn"]
    rows = spark.createDataFrame([(i, f"{clean} {w} {clean} {w} and {v}") for i, (w, v) in enumerate(zip(["", *odd], ["", *odd[1:], odd[0]], strict=True))], "doc_id long, text string")
    p = [r[0] for r in rows.orderBy("doc_id").select(t.score(rows, model)).collect()]
    assert p[0] < t.THRESHOLD
    assert sum(v >= t.THRESHOLD for v in p[1:]) >= 5


def test_plain_words():
    assert [t.plain(w) for w in ("St.upid!", "cl0wn", "5aaa9", "$$$", "É", "l-o-s-e-r,")] == ["stupid", "clown", "aaa", "", "é", "loser"]
    assert "stupid" in t.tokens("you s t u p i d one")


def test_odd_rows(spark):
    rows = [(None, None, 1.0), (1, "", 2.0), (4, "bad " * 200_000, 3.0), (3, "w" * 100_000, None), (3, "w" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("label", F.lit("clash"))
    labels = spark.createDataFrame([(1, 0), (4, 1), (3, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = t.train(docs, some)
        got = docs.withColumn("p", t.score(docs, model)).collect()
        assert len(got) == 5 and all(0 <= r["p"] <= 1 for r in got)
        assert len({r["p"] for r in got if r["doc_id"] == 3}) == 1
    assert docs.limit(0).select(t.score(docs, model)).count() == 0
