"""The Jaccard join against brute force, its bounds, and odd rows."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwave.llm import gramjoin as g

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """(doc_id, n, component) of (doc_id, text) rows with distinct ids."""
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return {(i, len(sets[i]), find(i)) for i in sets}


def run(spark, rows, parts=4):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    out = g.join(df).collect()
    assert len(out) == len(rows)
    return {tuple(r) for r in out}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.4:
            words[at] = f"new{rng.randrange(10**6)}"
        elif kind < 0.7:
            del words[at]
        else:
            words.insert(at, f"put{rng.randrange(10**6)}")
    return words


def corpus(families=12):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for f in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 150))] + passage * (f % 3)
        texts += [" ".join(edited(rng, base, e)) for e in (0, 0, 1, 1, 2, 3, 5, 8, 13)]
    texts += ["One Two", "one two", "one two three", "ÄB c", "äb c", "", " \t\n", "x" * 50, "a b c d e", "A B C D E F", "a\x0bb c\x1cd e f"]
    return list(enumerate(texts))


@pytest.mark.parametrize("hot,often,chunk,few", [(512, 3, 256, 10**6), (3, 10**6, 4, 10**6), (3, 1, 8, 0)])
def test_against_brute_force(spark, monkeypatch, hot, often, chunk, few):
    for name, value in (("HOT", hot), ("OFTEN", often), ("CHUNK", chunk), ("BROADCAST", few)):
        monkeypatch.setattr(g, name, value)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_chain_that_no_hub_reaches(spark, monkeypatch):
    """Windows over one long text: each is linked with the next ones only, and all begin with hot shingles."""
    monkeypatch.setattr(g, "HOT", 5)
    monkeypatch.setattr(g, "CHUNK", 8)
    words = [f"c{i}" for i in range(420)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120])) for i in range(100)]
    got = run(spark, rows)
    assert got == brute(rows) and {c for _, _, c in got} == {0}


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        base = rng.choice(1 << 40, rng.integers(5, 900), replace=False)
        k = max(1, int(len(base) * rng.uniform(0, 0.15)))
        a, b = np.sort(base), np.unique(np.concatenate([base[k:], rng.choice(1 << 40, rng.integers(1, k + 1))]))
        others = [b] + [rng.choice(1 << 40, rng.integers(5, 900), replace=False) for _ in range(40)]
        groups = min(len(g.point(x)) for x in (a, *others))
        points, sizes = np.stack([g.folded(g.point(x), groups) for x in others]), np.array([len(x) for x in others])
        ask, found = g.CountTree(points, sizes).search(g.folded(g.point(a), groups)[None], np.array([len(a)]))
        assert not g.linked(a, b) or 0 in found.tolist()
        exact = {j for j in range(len(points)) if np.minimum(points[j], g.folded(g.point(a), groups)).sum() >= g.least_shared(len(a), sizes[j])}
        assert set(found.tolist()) <= exact


def test_groups_are_components_of_pairs():
    uid = np.array([9, 4, 7, 9, 5, 2, 8, 1])
    got = g._groups(uid, np.array([0, 3, 5, 6]), np.array([1, 2, 4, 7]))
    assert got.tolist() == [4, 4, 4, 4, 2, 2, 1, 1]
    chain = np.arange(100)
    assert set(g._groups(chain, chain[:-1], chain[1:])) == {0}


def test_points_fold_to_points_of_fewer_groups():
    shingles = np.random.default_rng(3).choice(1 << 40, 5000, replace=False)
    assert len(g.point(shingles)) == g.groups_of(5000) == 2048
    p = g.point(shingles)
    assert (g.unpacked(g.packed(p), 5000) == p).all() and (g.unpacked(g.packed(g.folded(p, 64)), 5000) == g.folded(p, 64)).all()
    assert (g.unpacked(g.packed(p * 99_999), 5000) == p * 99_999).all()
    assert (g.folded(g.point(shingles), 128) == np.bincount(shingles % 128, minlength=128)).all()


def test_stored_shingles_keep_order_and_values():
    hashes = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 500, dtype=np.uint64))
    assert (g.loaded(g.stored(hashes)) == np.unique(hashes >> np.uint64(24)).astype(np.int64)).all()
    assert len(g.loaded(g.stored(hashes[:0]))) == 0 and g.beginning(500) == 101


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(120_000))
    rows = [(5, long), (3, long + " end"), (3, long), (None, long), (None, "alone it stands"), (None, None), (7, None), (8, ""), (9, "p q"), (4, "P q"), (6, "r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("uid", "high", "low", "n", "key", "label")})
    got = sorted((tuple(r) for r in g.join(docs).collect()), key=repr)
    many = len(grams(long))
    assert got == sorted([
        (5, many, 3), (3, many + 1, 3), (3, many, 3), (None, many, 3), (None, 1, None), (None, 0, None), (7, 0, 7), (8, 0, 8),
        (9, 1, 4), (4, 1, 4), (6, 1, 6),
    ], key=repr)
    assert g.join(docs.limit(0)).count() == 0
