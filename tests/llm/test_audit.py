"""The filter audit against plain Python, its tries, adaptive keys, and odd rows."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cartwave.llm import audit as a


def failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        ("A" if len(words) < 200 else "") + ("B" if 100 * len(set(words)) < 50 * len(words) else "")
        + ("C" if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else "") + ("D" if re.search("[#$%&*|]", text) else "")
    )


def brute(docs, labels):
    """Rows of the audit from (doc_id, text, source) and (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    rows = []
    for i, t, s in docs:
        copy = i is not None and i > first[t or ""]
        rows.append((s or "", failed(t or "") + ("E" if copy else ""), i in good, i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        found, share = [], Counter()
        for order in permutations("ABCDE"):
            for step, k in enumerate(order, 1):
                here = [r for r in mine if not set(r[1]) & set(order[: step - 1])]
                gone = [r for r in here if k in r[1]]
                share[k] += len(gone)
                found.append((k, (
                    part, "".join(order), step, len(here) - len(gone), len(gone), sum(k in r[1] for r in mine) - len(gone),
                    sum(r[1] == k for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                )))
        out |= {(*r, share[k]) for k, r in found}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(spark, docs, labels, parts=5):
    left = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(parts)
    left = left.withColumns({c: F.lit("clash") for c in ("part", "mask", "key", "good", "toxic", "n", "least")})
    right = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    rows = [tuple(r) for r in a.audit(left, right).select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus():
    rng = random.Random(8)
    few = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        words = [rng.choice(few) for _ in range(rng.choice([5, 150, 250]))] if i % 3 else [f"u{rng.random()}" for _ in range(220)]
        texts.append(" ".join(words) + rng.choice(["", " #", " ABCDEFGHIJK" * 5]))
    docs = [(i, rng.choice(texts), f"s{rng.randrange(3)}") for i in range(200)]
    # texts that share a long beginning, one the beginning of the other
    docs += [(1000 + i, "same start " * 40 + "x" * (i % 30), "s0") for i in range(90)]
    labels = [(rng.randrange(200), rng.randrange(2), rng.randrange(2)) for _ in range(150)]
    return docs, labels


@pytest.mark.parametrize("bucket,trie", [(64 << 20, 64 << 20), (500, 300)])
def test_against_brute_force(spark, monkeypatch, bucket, trie):
    monkeypatch.setattr(a, "BUCKET", bucket)
    monkeypatch.setattr(a, "TRIE", trie)
    docs, labels = corpus()
    assert run(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    long = "long " * 300_000
    docs = [
        (4, None, None), (5, "", "s"), (5, "", "s"), (4, "", ""), (None, "", "s"), (None, "x", None), (1, "x", "s"), (0, "x", "s"), (0, "x", "t"),
        (9, long, "s"), (8, long, "s"), (7, long + "x", "t"),
    ]
    labels = [(9, 1, None), (9, 1, 0), (9, 0, 1), (None, 1, 1), (4, None, None), (77, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)
    assert run(spark, [], labels) == set() and len(run(spark, docs, [])) == 3 * 600


def test_trie_holds_the_smallest_id():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(500)]
    trie, want = a.TextTrie(), {}
    for i, t in enumerate(rng.sample(texts, len(texts))):
        trie.put(t, 1000 - i, ("p",))
        want[t] = 1000 - i
    assert {t: e.least for t, e in trie.walk()} == want
    assert trie.bytes == sum(map(len, want))


def test_keys_grow_where_texts_are_dense(spark):
    rows = [(i, "common head of many texts " + f"{i:04d}" * 30) for i in range(400)] + [(1000 + i, "hot " * 100) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = a.keyed(df, 8).collect()
    sizes = Counter()
    for r in got:
        assert r["text"].startswith(r["key"])
        sizes[r["key"]] += len(r["text"])
    total = sum(len(t) for _, t in rows)
    assert sorted(sizes)[-1] == "hot hot hot hot " and all(n <= total / 32 for k, n in sizes.items() if not k.startswith("hot"))


def test_deep_keys_join_no_rows(spark, capsys):
    head = "a head that very many texts share, " * 8  # four rounds of longer prefixes
    df = spark.createDataFrame([(i, head + f"{i:04d}" * 300) for i in range(200)] + [(900, "short"), (901, None)], "doc_id long, text string")
    got = a.keyed(df.fillna("", ["text"]), 8)
    assert {r["doc_id"]: len(r["key"]) for r in got.collect()} == {**dict.fromkeys(range(200), 1024), 900: 5, 901: 0}
    got.explain()
    assert "Join" not in capsys.readouterr().out
