"""Registered purchase queries: sources, families, profiles and datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cartwave.functions import columns as col
from cartwave.operators import labels
from cartwave.operators.cube import monthly_facts
from cartwave.operators.joins import spread_join
from cartwave.plans import datasets as ds
from cartwave.plans.profiles import Profiles
from cartwave.registry import trade_sql as q
from cartwave.registry.base import Registry, rounded, sql_double, sql_whole
from cartwave.sources.trade import in_months, star_trade
from cartwave.sources.windows import SCORE, TEST_MONTH_5, TRAIN

M = TRAIN.feature_months
L = TRAIN.label_month


def light(trade: DataFrame, months=M) -> Profiles:
    """Single families need one grouping, so they read the rows directly."""
    return Profiles(monthly_facts(trade, months), months)


def register(r: Registry) -> None:
    def trade_query(build, **options):
        def run(spark, sf_dir):
            return rounded(build(star_trade(spark, sf_dir), **options))

        return run

    def fam(name, build, rel):
        r.add(name, trade_query(build), rel.final(q.TRADE))

    # sources and projections
    ALL = ("user_id", "item_id", "brand_id", "cat_id")
    month_rows = (
        f"WITH {q.TRADE} SELECT user_id, item_id, brand_id, cat_id, "
        f"strftime(sldat, '%Y-%m-%d') AS sldat, {sql_whole('month', 'month')}, "
        f"{sql_whole('day', 'day')}, {sql_double('amt', 'amt')} FROM trade"
    )

    def rows(t, months=None):
        t = t if months is None else in_months(t, months)
        return t.select(*ALL, F.date_format("sldat", "yyyy-MM-dd").alias("sldat"),
                        "month", "day", "amt")

    r.add("src1_trade_log", trade_query(rows), month_rows)
    r.add("prj1_month_filter", trade_query(rows, months=[2, 3, 4]),
          month_rows + " WHERE month IN (2, 3, 4)")
    r.add("prj1_single_month", trade_query(rows, months=5), month_rows + " WHERE month = 5")
    for key in ("item_id", "user_id"):
        r.add(f"prj8_distinct_{key[:-3]}s",
              trade_query(lambda t, key=key: labels.distinct_entities(t, M, key)),
              f"WITH {q.TRADE} SELECT DISTINCT {key} FROM trade WHERE month IN (2, 3, 4)")
    r.add(
        "prj10_repeat_pairs",
        trade_query(lambda t: light(t).pairs("user_id", "item_id")
                    .where("user_id is not null and item_id is not null")
                    .selectExpr("user_id", "item_id",
                                "cast(bit_count(d_2 | d_3 | d_4) as bigint) as repeat_day")
                    .where("repeat_day > 1")),
        f"WITH {q.TRADE} SELECT user_id, item_id, {sql_whole('day', 'repeat_day')} "
        f"FROM ({q.partner_rows('user_id', 'item_id', M)}) p WHERE day > 1",
    )
    r.add(
        "fn1_date_parts",
        trade_query(lambda t: t.groupBy("month", "day").agg(F.count("*").alias("n"))),
        f"WITH {q.TRADE} SELECT {sql_whole('month', 'month')}, {sql_whole('day', 'day')}, "
        "count(*) AS n FROM trade GROUP BY month, day",
    )

    # monthly families
    for keys in q.PREFIX:
        name = "_".join(k[:-3] for k in keys)
        fam(f"agg1_{name}_monthly_action",
            lambda t, keys=keys: light(t).activity(*keys), q.activity(keys, M))
        fam(f"agg5_{name}_action_stats",
            lambda t, keys=keys: light(t).activity_stats(*keys), q.activity_stats(keys, M))
    fam("agg2_user_trend_ols", lambda t: light(t).activity("user_id", ols=True),
        q.activity(("user_id",), M, True))
    fam("agg2_user_single_month", lambda t: light(t, (5,)).activity("user_id"),
        q.activity(("user_id",), (5,)))
    fam("agg5_user_months_only", lambda t: light(t).activity_stats("user_id", months_only=True),
        q.activity_stats(("user_id",), M, True))
    fam("agg5_user_chosen_stats",
        lambda t: light(t).activity_stats("user_id", stats=("sum", "mean")),
        q.activity_stats(("user_id",), M, False, ("sum", "mean")))
    for key in ("user_id", "brand_id", "cat_id"):
        name = key[:-3]
        fam(f"agg3_{name}_diversity", lambda t, key=key: light(t).diversity(key), q.diversity(key, M))
        fam(f"agg6_{name}_diversity_stats", lambda t, key=key: light(t).diversity_stats(key),
            q.diversity_stats(key, M))
    for key in ("brand_id", "cat_id", "item_id"):
        name = key[:-3]
        fam(f"agg4_{name}_penetration", lambda t, key=key: light(t).penetration(key),
            q.penetration(key, M))
        fam(f"agg7_{name}_penetration_stats", lambda t, key=key: light(t).penetration_stats(key),
            q.penetration_stats(key, M))
        fam(f"agg8_{name}_over_users", lambda t, key=key: light(t).over_users(key),
            q.partner_stats(key, "user_id", M))
        fam(f"agg9_user_over_{name}s", lambda t, name=name: light(t).user_over(name),
            q.partner_stats("user_id", key, M, f"{name[0]}_"))
        fam(f"agg10_{name}_repeat", lambda t, key=key: light(t).repeat_entity(key),
            q.repeat_entity(key, M))
        fam(f"agg11_user_{name}_repeat", lambda t, name=name: light(t).repeat_user((name,)),
            q.repeat_user((name,), M))

    # labels
    for keys in (("user_id",), ("user_id", "item_id"), ("user_id", "brand_id"), ("user_id", "cat_id")):
        name = "_".join(k[:-3] for k in keys)
        fam(f"agg12_{name}_label", lambda t, keys=keys: labels.bought(t, L, keys), q.label(keys, L))
    fam("agg13_user_spend", lambda t: labels.spent(t, L), q.spend_label(L))
    pair = q.activity_stats(("user_id", "brand_id"), M).joined(q.label(("user_id", "brand_id"), L))
    r.add(
        "agg14_label_counts",
        trade_query(lambda t: labels.target_counts(
            light(t).rolled("user_id", "brand_id").select("user_id", "brand_id")
            .join(labels.bought(t, L, ["user_id", "brand_id"]), ["user_id", "brand_id"], "left")
            .fillna(0, ["target"]))),
        f"WITH {q.TRADE} SELECT {sql_whole('target', 'target')}, count(*) AS n "
        f"FROM ({pair.body}) p GROUP BY target",
    )

    # joins of families
    fam("jn1_user_months_outer", lambda t: light(t).rolled("user_id").selectExpr(
        "user_id", *[f"n_{m} as rows_{m}" for m in M]),
        q.rel(q.monthly(("user_id",), M), ("user_id",),
              [(f"rows_{m}", f"frequency_{m}", "i") for m in M]))
    fam("jn2_item_families", lambda t: light(t).penetration("item_id").join(
        light(t).repeat_entity("item_id"), "item_id", "full_outer"),
        q.penetration("item_id", M).joined(q.repeat_entity("item_id", M)))
    def enriched(t):
        p = light(t)
        pairs = p.activity_stats("user_id", "item_id", months_only=True)
        out = spread_join(pairs, p.activity("user_id"), ["user_id"], ["item_id"], small_rows=0)
        return spread_join(out, p.penetration("item_id"), ["item_id"], ["user_id"], small_rows=0)

    fam("jn3_pair_enrichment", enriched,
        q.activity_stats(("user_id", "item_id"), M, True).joined(q.activity(("user_id",), M))
        .joined(q.penetration("item_id", M)))
    fam("jn4_user_label", lambda t: ds.attach_label(
        light(t).rolled("user_id").selectExpr("user_id", "n_4 as last_rows"),
        labels.bought(t, L, ["user_id"]), ["user_id"]),
        q.rel(q.monthly(("user_id",), M), ("user_id",), [("last_rows", "frequency_4", "i")])
        .joined(q.label(("user_id",), L)))
    fam("jn5_brand_user_stats", lambda t: light(t).penetration("brand_id").join(
        light(t).over_users("brand_id"), "brand_id", "left"),
        q.penetration("brand_id", M).joined(q.partner_stats("brand_id", "user_id", M)))

    # unpivot: one row per key and monthly column, then statistics per key
    def unpivot_stats(t):
        wide = light(t).activity("user_id")
        cols = [c for c in col.containing(wide, "frequency")]
        long = wide.select("user_id", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
            ["user_id"], cols, "name", "value")
        return long.groupBy("user_id").agg(F.min("value").alias("lowest"),
                                           F.max("value").alias("highest"),
                                           F.count("value").alias("n"))

    r.add("prj12_unpivot_months", trade_query(unpivot_stats),
          f"WITH {q.TRADE} SELECT user_id, {sql_double('u_monthly_count_frequency_min', 'lowest')}, "
          f"{sql_double('u_monthly_count_frequency_max', 'highest')}, 5::BIGINT AS n "
          f"FROM ({q.activity_stats(('user_id',), M).body}) s")
    fam("prj4_select_by_fragment",
        lambda t: (lambda w: w.select("user_id", *col.containing(w, "trend")))(
            light(t).activity("user_id")),
        q.Rel(f"SELECT user_id, u_frequency_trend, u_days_trend, u_amts_trend FROM "
              f"({q.activity(('user_id',), M).body}) s", ("user_id",),
              {f"u_{a}_trend": "d" for a in ("frequency", "days", "amts")}))

    # profiles
    def built(t, window=TRAIN):
        return ds.profiles(t, window)

    fam("pro1_item_profile", lambda t: built(t).items(), q.items(M))
    fam("pro2_user_profile", lambda t: built(t).users(), q.users(M))
    fam("pro3_brand_profile", lambda t: built(t).brands(), q.group_profile("brand_id", M))
    fam("pro4_cat_profile", lambda t: built(t).cats(), q.group_profile("cat_id", M))
    for n, a in ((5, "item"), (6, "brand"), (7, "cat")):
        fam(f"pro{n}_user_{a}_features", lambda t, a=a: built(t).user_pairs(a),
            q.user_pairs(a, M))
    for n, a in ((8, "item"), (11, "brand"), (12, "cat")):
        fam(f"pro{n}_user_{a}_dataset", lambda t, a=a: ds.user_pair_dataset(t, TRAIN, a),
            q.user_pairs(a, M, L))
    fam("pro9_buy_dataset", lambda t: ds.buy_dataset(t, TRAIN), q.buy(M, L))
    fam("pro10_spend_dataset", lambda t: ds.spend_dataset(t, TRAIN), q.spend(M, L))
    fam("pro13_score_window", lambda t: ds.buy_dataset(t, SCORE),
        q.users(SCORE.feature_months, ("item",), ("brand", "item", "cat")))
    fam("pro13_single_month_window", lambda t: ds.buy_dataset(t, TEST_MONTH_5), q.buy((5,), 6))
