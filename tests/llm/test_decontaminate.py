"""Decontamination: copies, re-parameterised questions, slot consistency, both join paths, odd rows."""

import pytest
from pyspark.sql import functions as F

from cartwave.llm import decontaminate as d

ITEM = "A train with Tom aboard leaves Paris at 9 and covers 120 km before Tom gets off near the old mill by the river."
OTHER = "A train with Ann aboard leaves Rome at 7 and covers 450 km before Ann gets off near the old mill by the river."
MIXED = "A train with Ann aboard leaves Rome at 7 and covers 450 km before Bob gets off near the old mill by the river."
CLEAN = "Words about something else that share nothing with any question, apart from this: the old mill stands."


def found(spark, docs, items, **options):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r["doc_id"], r["item_id"], r["kind"], r["hits"], r["windows"]) for r in d.leaks(a, b, **options).collect()), key=repr)


@pytest.mark.parametrize("limit", [d.BROADCAST, 0])
def test_kinds(spark, monkeypatch, limit):
    monkeypatch.setattr(d, "BROADCAST", limit)
    docs = [(1, f"{CLEAN} {ITEM} {CLEAN}"), (2, f"{CLEAN} {OTHER}"), (3, CLEAN), (4, f"{ITEM} {ITEM}"), (5, ITEM[:30])]
    got = found(spark, docs, [(10, ITEM), (11, "Entirely different words about a lake and its boats in summer.")])
    assert [g[:3] for g in got] == [(1, 10, "copy"), (2, 10, "template"), (4, 10, "copy")]
    assert all(g[3] <= g[4] for g in got)


def test_slots_must_be_consistent(spark):
    repeated = "Tom meets Tom and then sees Tom while he waits for Tom beside some green door."
    fits = repeated.replace("Tom", "Ann")
    breaks = "Ann meets Bob and then sees Eva while he waits for Max beside some green door."
    text = "Today {} It ends.".format
    got = found(spark, [(1, text("when " + fits)), (2, text("when " + breaks))], [(1, "when " + repeated)])
    assert [g[:3] for g in got] == [(1, 1, "template")]


def test_marks(spark):
    row = spark.createDataFrame([("See Bob at 3.5 km, and 20 percent of Rome in 1,000 days.",)], "text string")
    words = row.select(d.template_words(d.marked(F.col("text"))).alias("t"), d.slot_words(d.marked(F.col("text"))).alias("s")).first()
    n, m, u = "\x01", "\x02", "\x03"
    assert words["t"] == ["see", m, "at", n, u, "and", n, u, "of", m, "in", n, u]
    assert words["s"] == ["see", m + "bob", "at", n + "3.5", u + "km", "and", n + "20", u + "percent", "of", m + "rome", "in", n + "1,000", u + "days"]


def test_odd_rows(spark):
    docs = [(None, ITEM), (1, None), (2, ""), (3, ITEM), (3, ITEM), (3, CLEAN), (4, "Short one"), (5, "x " * 200_000 + ITEM), (6, "\x01\x02 9 9 9 9 9 9")]
    items = [(10, ITEM), (10, ITEM), (None, ITEM), (11, None), (12, ""), (13, "short one"), (14, "1 2 3 4 5 6")]
    got = found(spark, docs, items)
    assert [(g[0], g[1]) for g in got] == sorted(
        [(3, 10), (3, None), (4, 13), (5, 10), (5, None), (None, 10), (None, None)], key=repr)
    a = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("at", "hash", "item_id", "text_hash")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    kept = d.without_leaks(a, b)
    assert kept.columns == a.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()) == [(1, ""), (2, ""), (3, "Words"), (6, "\x01\x02 9 ")]
    assert d.leaks(a.limit(0), b).count() == 0 and d.leaks(a, b.limit(0)).count() == 0
    assert d.without_leaks(a, b.limit(0)).count() == len(docs)


def test_no_python_in_the_plan(spark, sf_dir):
    from cartwave.llm.queries import op3_benchmark_decontamination

    plan = op3_benchmark_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
