"""Near-dedup: alignment against the full table, links against brute force, hot buckets, odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwave.llm import neardup as n
from cartwave.llm.graph import components


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edited(rng, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.4:
            out.insert(at, rng.choice(vocabulary))
        elif kind < 0.7 and len(out) > 1:
            out.pop(min(at, len(out) - 1))
        else:
            out[min(at, len(out) - 1)] = rng.choice(vocabulary)
    return out


def test_alignment_is_exact_within_its_band():
    rng = random.Random(1)
    for _ in range(400):
        vocabulary = range(rng.choice([2, 5, 50, 1000]))
        a = [rng.choice(vocabulary) for _ in range(rng.randint(1, 80))]
        b = edited(rng, a, rng.randint(0, 9), vocabulary)
        whole = lcs(a, b)
        assert n.aligned(a, b, len(a) + len(b)) == whole
        assert n.aligned(a, b, len(a) + len(b) - 2 * whole) == whole
        assert n.aligned(a, b, 1) <= whole


def test_sketch_keeps_text_order_and_counts_occurrences():
    x = n._mix(np.arange(50, dtype=np.uint64))
    assert (n.sketch(x) != n.sketch(x[::-1])).mean() > 0.9
    agree = [(n.sketch(n._mix(np.arange(i, i + 500, dtype=np.uint64))) == n.sketch(n._mix(np.arange(i + 25, i + 525, dtype=np.uint64)))).mean() for i in range(0, 20_000, 1000)]
    both = 475 / 525
    assert abs(np.mean(agree) - both**2) < 0.04
    assert (n.sketch(np.repeat(x[:1], 3)) != n.sketch(np.repeat(x[:1], 9))).any() or len(set(n.sketch(np.repeat(x[:1], 3)))) == 1


def kept(a, b):
    x, y = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or [tuple(w)] for w in (a.lower().split(), b.lower().split()))

    def share(p, q):
        if len(set(p) & set(q)) < 0.4 * max(len(set(p)), len(set(q))):
            return 0.0
        got = lcs(p, q)
        return got / (len(p) + len(q) - got)

    return max(share(x, y), share(list(dict.fromkeys(x)), list(dict.fromkeys(y))))


def corpus():
    """Distinct texts, copies, near copies of several distances, and a passage that many texts share."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    texts = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 80))] + passage
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 4, 8, 16):
            texts.append(" ".join(edited(rng, base, edits, vocabulary)).upper())
    texts += ["a b c", "a b c", "a b d", "", "line one two three four " * 30, "line one two three four " * 40]
    return texts


def test_classes_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in n.near_copies(df).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = len(texts[i].split()), len(texts[j].split())
        if (texts[i].lower().split() == texts[j].lower().split()) or min(a, b) >= 0.5 * max(a, b, 1) and min(a, b) >= 5 and kept(texts[i], texts[j]) >= 0.8:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    assert got == {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("chunk", [7, 256])
def test_hot_bucket_without_a_centre(spark, monkeypatch, chunk):
    """Hundreds of texts around a base that is not there: pairs lie on both sides of the bound, the class is one."""
    monkeypatch.setattr(n, "CHUNK", chunk)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(edited(rng, base, 2, vocabulary)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert n.near_copies(df).select("class_id").distinct().count() == 1


def test_one_of_each_class_stays(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    near = long.replace("x77 ", "y ", 1)
    rows = [(5, long), (3, near), (3, near), (None, long), (None, "alone in the world it stands"), (7, None), (8, ""), (9, "p q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("uid", "high", "low", "words", "key")})
    got = n.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] and r["text"][:5]) for r in got.collect()), key=repr) == [(3, "x0 x1"), (7, None), (9, "p q"), (None, "alone")]
    assert n.deduplicated(docs.limit(0)).count() == 0 and n.near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)] + [(200, i) for i in range(201, 260)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100}
    assert {got[i] for i in range(200, 260)} == {200}


def test_passages_repeated_more_or_less_often(spark):
    """Pages of nearly the same shingles whose passages are repeated 1, 2, 3 and 8 times, against brute force without regard to length."""
    rng = random.Random(12)
    vocabulary = [f"u{i}" for i in range(3000)]
    texts = []
    for _ in range(8):
        passage = [rng.choice(vocabulary) for _ in range(100)]
        texts += [" ".join(passage * times) for times in (1, 3, 2, 8)]
        texts.append(" ".join(edited(rng, passage, 2, vocabulary) * 4))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in n.near_copies(df).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if find(i) != find(j) and len(set(texts[i].split()) & set(texts[j].split())) > 50 and kept(texts[i], texts[j]) >= 0.8:
            low, high = sorted((find(i), find(j)))
            root[high] = low
    assert got == {i: find(i) for i in range(len(texts))}
    assert len(set(got.values())) < len(texts) / 3
