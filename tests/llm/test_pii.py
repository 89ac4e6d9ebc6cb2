"""Personal data: base kinds against plain patterns, checksums, scores, odd rows."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from cartwave.llm import pii
from cartwave.llm.common import table
from cartwave.llm.queries import op7_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["spans"] for r in pii.found(rows).collect()}
    return [[(x["kind"], x["start"], x["end"], round(x["score"], 2)) for x in got[i]] for i in range(len(texts))]


def test_random_texts_against_brute_force(spark):
    rng = random.Random(4)
    parts = [*"0123456789", *"+-. ()@%_\n", "a", "é", "4111 1111 1111 1111", "10.0.0.1", "999.1.1.1", "x@y.z", "+1 (555) 010-9999", "00", ".5"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    for text, got in zip(texts, spans(spark, texts), strict=True):
        assert [g[:3] for g in got if g[0] in pii.KINDS] == brute(text), text


def test_added_kinds_and_scores(spark):
    texts = [
        "pay to iban DE89 3704 0044 0532 0130 00 now", "DE88 3704 0044 0532 0130 00", "GB82WEST12345698765432",
        "call (555) 123-4567 today", "row (555) 123-4567 end", "server 10.1.2.3", "version 10.1.2.3", "plain 10.1.2.3",
    ]
    got = spans(spark, texts)
    assert got[0][-1][:3] == ("iban", 12, 39) and got[2] == [("iban", 0, 22, 0.9)]
    assert not [g for g in got[1] if g[0] == "iban"]
    assert [g[0] for g in got[3]] == ["local"] and got[4] == []
    assert [g[0][3] for g in got[5:]] == [0.8, 0.3, 0.6]


def test_very_long_runs(spark):
    texts = ["a" * 300_000, "1 " * 150_000, "a@" + "b." * 100_000, "+1" + "()" * 100_000, "9" * 200_000, "1." * 100_000, "a@b.c " * 20_000]
    got = spans(spark, texts)
    for text, found in zip(texts[:1] + texts[-1:], got[:1] + got[-1:], strict=True):
        assert [g[:3] for g in found if g[0] in pii.KINDS] == brute(text)


def test_query_against_brute_force(spark, sf_dir):
    texts = {r[0]: r[1] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    for r in op7_pii(spark, sf_dir).collect():
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op7_pii(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, "x@y.z"), (1, "x@y.z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("kind", "start", "value")})
    got = pii.found(docs).collect()
    assert sorted(len(r["spans"]) for r in got) == [0, 0, 1, 1] and {r["kind"] for r in got} == {"clash"}
    assert pii.found(docs.limit(0)).count() == 0
