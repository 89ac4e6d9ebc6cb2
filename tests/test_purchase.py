"""Hand-computed purchase features, readers and invariants."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartwave.functions import series
from cartwave.operators import labels
from cartwave.operators.cube import base_cube, monthly_facts
from cartwave.operators.joins import attach_label
from cartwave.plans import datasets as ds
from cartwave.plans.profiles import Profiles
from cartwave.sources.trade import canonical, in_months, read_trade_csv, star_trade, with_date_parts
from cartwave.sources.windows import TRAIN

M = (2, 3, 4)
ROWS = [
    (1, 1, 1, 1, "2018-02-03", 10), (1, 1, 1, 1, "2018-02-05", 20), (1, 2, 1, 2, "2018-03-03", 5),
    (1, 1, 1, 1, "2018-04-05", 10), (1, 1, 1, 1, "2018-04-07", 10), (1, 3, 2, 2, "2018-04-07", 1),
    (2, 1, 1, 1, "2018-02-03", 7), (2, 2, 1, -1, "2018-03-31", 4), (2, 3, 2, 2, "2018-04-30", 8),
    (2, 3, 2, 2, "2018-04-30", 2), (1, 1, 1, 1, "2018-05-01", 3), (3, 1, 1, 1, "2018-05-02", 9),
]


@pytest.fixture(scope="module")
def trade(spark):
    rows = [(u, i, b, c, dt.datetime.fromisoformat(d), Decimal(a)) for u, i, c, b, d, a in ROWS]
    df = spark.createDataFrame(
        rows, "user_id long, item_id long, brand_id long, cat_id long, sldat timestamp, amt decimal(18,2)"
    )
    return with_date_parts(df)


@pytest.fixture(scope="module", params=["rows", "cube"])
def p(request, trade):
    facts = monthly_facts(trade, M) if request.param == "rows" else base_cube(trade, M)
    return Profiles(facts, M)


def one(df, **key):
    for k, v in key.items():
        df = df.where(F.col(k) == v)
    (row,) = df.collect()
    return {k: float(v) for k, v in row.asDict().items()}


@pytest.mark.parametrize(
    "keys, key, attr, months, trend, dev, stats, clean",
    [
        ("user_id", 1, "frequency", (2, 1, 3), -0.136364, 2, (7.863636, -0.136364, 3, 1.572727), (6, 2)),
        ("user_id", 1, "days", (2, 1, 2), 0, 1, (6, 0, 2, 1.2), (5, 1.666667)),
        ("user_id", 1, "amts", (30, 5, 21), 1.227273, 20, (77.227273, 1.227273, 30, 15.445455), (56, 18.666667)),
        ("user_id", 2, "frequency", (1, 1, 2), -0.136364, 1, (4.863636, -0.136364, 2, 0.972727), (4, 1.333333)),
        ("user_id", 2, "amts", (7, 4, 10), -0.409091, 9, (29.590909, -0.409091, 10, 5.918182), (21, 7)),
        ("item_id", 1, "frequency", (3, 0, 2), 0.136364, 1, (6.136364, 0, 3, 1.227273), (5, 1.666667)),
        ("item_id", 2, "frequency", (0, 2, 0), 0, -1, (1, -1, 2, 0.2), (2, 0.666667)),
        ("item_id", 3, "amts", (0, 0, 11), -1.5, 10, (19.5, -1.5, 11, 3.9), (11, 3.666667)),
        ("brand_id", -1, "frequency", (0, 1, 0), 0, -1, (0, -1, 1, 0), (1, 0.333333)),
        ("brand_id", 2, "amts", (0, 5, 11), -1.5, 10, (24.5, -1.5, 11, 4.9), (16, 5.333333)),
    ],
)
def test_action(p, keys, key, attr, months, trend, dev, stats, clean):
    x = keys[0]
    row = one(p.activity(keys), **{keys: key})
    assert tuple(row[f"{x}_count_{m}_{attr}"] for m in M) == months
    assert row[f"{x}_{attr}_trend"] == pytest.approx(trend, abs=1e-6)
    assert row[f"{x}_{attr}_dev"] == dev
    agg = one(p.activity_stats(keys), **{keys: key})
    got = [agg[f"{x}_monthly_count_{attr}_{s}"] for s in series.STATS]
    assert got == pytest.approx(stats, abs=1e-6)
    only = one(p.activity_stats(keys, months_only=True), **{keys: key})
    assert [only[f"{x}_monthly_count_{attr}_{s}"] for s in ("sum", "mean")] == pytest.approx(clean, abs=1e-6)


def test_trend_zero_is_positive(p):
    row = one(p.activity("user_id"), user_id=1)
    assert str(row["u_days_trend"]) == "0.0"


def test_diversity(p):
    a, b = (one(p.diversity("user_id"), user_id=u) for u in (1, 2))
    assert [a[f"u_pd_{m}_item"] for m in M] == [1, 1, 2]
    assert a["u_item_trend"] == pytest.approx(-0.136364, abs=1e-6) and a["u_item_dev"] == 1
    assert [b[f"u_pd_{m}_item"] for m in M] == [1, 1, 1] and b["u_item_trend"] == 0
    sa, sb = (one(p.diversity_stats("user_id"), user_id=u) for u in (1, 2))
    names = [f"u_monthly_pd_item_{s}" for s in series.STATS]
    assert [sa[n] for n in names] == pytest.approx([4.863636, -0.136364, 2, 0.972727], abs=1e-6)
    assert [sb[n] for n in names] == pytest.approx([3, 0, 1, 0.6], abs=1e-6)


def test_category_diversity_has_brand_and_item(p):
    cols = p.diversity("cat_id").columns
    assert "c_brand_trend" in cols and "c_item_dev" in cols and "c_cat_trend" not in cols


@pytest.mark.parametrize(
    "item, users, dev, stats",
    [(1, (2, 0, 1), 0, (3, 0, 2, 1)), (2, (0, 2, 0), 0, (2, 0, 2, 0.666667)), (3, (0, 0, 2), 1, (2, 0, 2, 0.666667))],
)
def test_penetration(p, item, users, dev, stats):
    row = one(p.penetration("item_id"), item_id=item)
    assert tuple(row[f"i_pen_{m}_users"] for m in M) == users
    assert row["i_pen_4_user_trend"] == 0 and row["i_pen_4_user_dev"] == dev
    agg = one(p.penetration_stats("item_id"), item_id=item)
    assert [agg[f"i_monthly_pen_users_{s}"] for s in series.STATS] == pytest.approx(stats, abs=1e-6)


@pytest.mark.parametrize(
    "item, day, rows, amt",
    [(1, (4, 1, 3, 2), (5, 1, 4, 2.5), (57, 7, 50, 28.5)), (2, (2, 1, 1, 1), (2, 1, 1, 1), (9, 4, 5, 4.5)),
     (3, (2, 1, 1, 1), (3, 1, 2, 1.5), (11, 1, 10, 5.5))],
)
def test_over_users(p, item, day, rows, amt):
    row = one(p.over_users("item_id"), item_id=item)
    for name, want in (("day", day), ("sldat", rows), ("amt", amt)):
        assert [row[f"{name}_{s}"] for s in series.STATS] == pytest.approx(want)


def test_user_over_items(p):
    a, b = (one(p.user_over("item"), user_id=u) for u in (1, 2))
    assert [a[f"i_day_{s}"] for s in series.STATS] == pytest.approx([5, 1, 3, 5 / 3])
    assert [a[f"i_amt_{s}"] for s in series.STATS] == pytest.approx([56, 1, 50, 56 / 3])
    assert [b[f"i_sldat_{s}"] for s in series.STATS] == pytest.approx([4, 1, 2, 4 / 3])


def test_repeat(p):
    item = one(p.repeat_entity("item_id"), item_id=1)
    assert [item[f"i_repeat_{x}"] for x in ("buyer", "day", "buyer_ratio", "day_ratio")] == [1, 3, 0.5, 0.25]
    none = one(p.repeat_entity("item_id"), item_id=2)
    assert [none[f"i_repeat_{x}"] for x in ("buyer", "day", "buyer_ratio", "day_ratio")] == [0, 0, 0, 0]
    user = one(p.repeat_user(("item",)), user_id=1)
    assert [user[f"ui_repeat_{x}"] for x in ("day", "count", "count_ratio", "day_ratio")] == [3, 1, 1.0, 0.375]


def test_labels(trade):
    users = Profiles(monthly_facts(trade, M), M).rolled("user_id").select("user_id")
    got = attach_label(users, labels.bought(trade, 5, ["user_id"]), ["user_id"])
    assert {r.user_id: r.target for r in got.collect()} == {1: 1, 2: 0}
    spend = attach_label(users, labels.spent(trade, 5), ["user_id"])
    assert {r.user_id: r.target for r in spend.collect()} == {1: 3.0, 2: 0.0}


def test_day_31_counts_once(spark):
    rows = [(1, 1, 1, 1, dt.datetime(2018, 3, 31), Decimal(1)), (1, 1, 1, 1, dt.datetime(2019, 3, 31), Decimal(1))]
    df = with_date_parts(spark.createDataFrame(
        rows, "user_id long, item_id long, brand_id long, cat_id long, sldat timestamp, amt decimal(18,2)"))
    row = one(Profiles(monthly_facts(df, (3,)), (3,)).activity("user_id"), user_id=1)
    assert row["u_count_3_days"] == 1 and row["u_count_3_frequency"] == 2 and row["u_days_trend"] == 0


def test_null_user_counts_for_the_item_only(spark):
    rows = [(None, 1, 1, 1, dt.datetime(2018, 2, 1), Decimal(5)), (7, 1, 1, 1, dt.datetime(2018, 2, 2), Decimal(1))]
    df = with_date_parts(spark.createDataFrame(
        rows, "user_id long, item_id long, brand_id long, cat_id long, sldat timestamp, amt decimal(18,2)"))
    p = Profiles(monthly_facts(df, M), M)
    row = one(p.activity("item_id"), item_id=1)
    assert row["i_count_2_frequency"] == 2 and row["i_count_2_amts"] == 6
    assert one(p.penetration("item_id"), item_id=1)["i_pen_2_users"] == 1
    assert p.activity("user_id").count() == 1


def test_read_trade_csv(spark, tmp_path):
    header = ["", "sldatime", "vipno", "pluno", "dptno", "bndno", "amt"]
    lines = [
        ",".join(header),
        "0,2018-02-03 10:00:00,1,11,5,12.0,3.50",
        "1,not a date,2,12,5,,4",
        "2,2018-03-01,3,13,6,14,x",
    ]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    rows = sorted(read_trade_csv(spark, str(tmp_path / "log.csv"), header).collect(), key=lambda r: r.user_id)
    assert [r.brand_id for r in rows] == [12, -1, 14]
    assert [r.month for r in rows] == [2, None, 3]
    assert rows[0].amt == Decimal("3.50") and rows[2].amt is None
    assert rows[0].day == 3


def test_frequency_adds_up(spark, sf_dir):
    t = star_trade(spark, sf_dir)
    p = Profiles(monthly_facts(t, M), M)
    total = p.activity("user_id").selectExpr(
        "sum(u_count_2_frequency + u_count_3_frequency + u_count_4_frequency) as n").first()["n"]
    assert total == in_months(t, list(M)).where("user_id is not null").count()


def test_salted_profile_join_equals_plain(spark, sf_dir, monkeypatch):
    from cartwave.operators import joins

    t = star_trade(spark, sf_dir)
    plain = ds.user_pair_dataset(t, TRAIN, "cat").collect()
    monkeypatch.setattr(joins, "WIDE_ROWS", 0)
    salted = ds.user_pair_dataset(t, TRAIN, "cat").collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, salted))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_expand_cross_join_or_python(spark, sf_dir):
    t = star_trade(spark, sf_dir)
    p = Profiles(monthly_facts(t, M), M)
    for df in (p.activity("user_id"), p.diversity("brand_id"), p.over_users("cat_id"), p.repeat_user()):
        plan = plan_of(df)
        for bad in ("Expand", "CartesianProduct", "NestedLoop", "Python"):
            assert bad not in plan
    scan = plan_of(p.activity("user_id"))
    assert "l_tax" not in scan and "o_totalprice" not in scan
