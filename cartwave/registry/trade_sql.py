"""Check SQL for the purchase features, written from the definitions.

It counts with ``count(DISTINCT ...)`` on the joined rows and knows nothing of the
cube or the pair tables.
"""

from __future__ import annotations

from cartwave.registry.base import Rel

TRADE = """trade AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, p_brand AS brand_id, p_type AS cat_id,
         o_orderdate AS sldat, month(o_orderdate) AS month, day(o_orderdate) AS day,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

PREFIX = {
    ("user_id",): "u_", ("brand_id",): "b_", ("cat_id",): "c_", ("item_id",): "i_",
    ("user_id", "brand_id"): "ub_", ("user_id", "cat_id"): "uc_", ("user_id", "item_id"): "ui_",
}
STATS = ("sum", "min", "max", "mean")


def month_list(months) -> str:
    return ", ".join(str(m) for m in months)


def slope(xs) -> str:
    n = len(xs)
    if n == 1:
        return "0.0::DOUBLE"
    s1 = n * (n + 1) // 2
    s2 = sum(i * i for i in range(1, n + 1))
    weighted = " + ".join(f"{i} * {x}" for i, x in enumerate(xs, 1))
    plain = " + ".join(xs)
    return f"(CAST({n} * ({weighted}) - {s1} * ({plain}) AS DOUBLE) / ({s2} - {s1 * s1}) + 0.0::DOUBLE)"


def ols(xs) -> str:
    n = len(xs)
    s1 = n * (n + 1) // 2
    s2 = sum(i * i for i in range(1, n + 1))
    weighted = " + ".join(f"{i} * {x}" for i, x in enumerate(xs, 1))
    plain = " + ".join(xs)
    return f"(CAST({n} * ({weighted}) - {s1} * ({plain}) AS DOUBLE) / ({n * s2} - {s1 * s1}) + 0.0::DOUBLE)"


def last_minus_one(xs) -> str:
    return f"(CASE WHEN {' + '.join(xs)} <> 0 THEN CAST({xs[-1]} AS DOUBLE) - 1 ELSE 0.0::DOUBLE END)"


def stats(xs, prefix, wanted=STATS) -> list[tuple[str, str]]:
    ds = [f"CAST({x} AS DOUBLE)" for x in xs]
    total = "(" + " + ".join(ds) + ")"
    exprs = {
        "sum": total,
        "min": f"least({', '.join(ds)})" if len(ds) > 1 else ds[0],
        "max": f"greatest({', '.join(ds)})" if len(ds) > 1 else ds[0],
        "mean": f"{total} / {len(ds)}",
    }
    return [(f"{prefix}_{s}", exprs[s]) for s in wanted]


def rel(source: str, keys, cols) -> Rel:
    """``cols`` are (name, expression, kind)."""
    listed = ", ".join([*keys, *[f"{e} AS {n}" for n, e, _ in cols]])
    return Rel(f"SELECT {listed} FROM ({source}) s", tuple(keys), {n: k for n, _, k in cols})


def monthly(keys, months) -> str:
    aggs = []
    for m in months:
        f = f"FILTER (WHERE month = {m})"
        aggs += [
            f"count(sldat) {f} AS frequency_{m}",
            f"count(DISTINCT day) {f} AS days_{m}",
            f"coalesce(sum(amt) {f}, 0) AS amts_{m}",
        ]
    return (
        f"SELECT {', '.join(keys)}, {', '.join(aggs)} FROM trade "
        f"WHERE month IN ({month_list(months)}) AND "
        f"{' AND '.join(f'{k} IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)}"
    )


def activity(keys, months, with_ols=False) -> Rel:
    p = PREFIX[tuple(keys)]
    cols = []
    for a in ("frequency", "days", "amts"):
        xs = [f"{a}_{m}" for m in months]
        cols += [(f"{p}count_{m}_{a}", x, "d" if a == "amts" else "i") for m, x in zip(months, xs)]
        cols += [(f"{p}{a}_trend", slope(xs), "d"), (f"{p}{a}_dev", last_minus_one(xs), "d")]
        if with_ols:
            cols.append((f"{p}{a}_trend_ols", ols(xs), "d"))
    return rel(monthly(keys, months), keys, cols)


def activity_stats(keys, months, months_only=False, wanted=STATS) -> Rel:
    p = PREFIX[tuple(keys)]
    cols = []
    for a in ("frequency", "days", "amts"):
        xs = [f"{a}_{m}" for m in months]
        full = xs if months_only else xs + [slope(xs), last_minus_one(xs)]
        cols += [(n, e, "d") for n, e in stats(full, f"{p}monthly_count_{a}", wanted)]
    return rel(monthly(keys, months), keys, cols)


def distinct_monthly(key, other, months) -> str:
    aggs = ", ".join(
        f"count(DISTINCT {other}) FILTER (WHERE month = {m}) AS n_{m}" for m in months
    )
    return (
        f"SELECT {key}, {aggs} FROM trade WHERE month IN ({month_list(months)}) "
        f"AND {key} IS NOT NULL GROUP BY {key}"
    )


ATTRS = {"user_id": ("cat", "brand", "item"), "brand_id": ("cat", "item"), "cat_id": ("brand", "item")}
STAT_ATTRS = {"user_id": ("item",), "brand_id": ("cat", "item"), "cat_id": ("brand", "item")}


def diversity(key, months) -> Rel:
    out, letter = None, key[0]
    for a in ATTRS[key]:
        xs = [f"n_{m}" for m in months]
        cols = [(f"{letter}_pd_{m}_{a}", x, "i") for m, x in zip(months, xs)]
        cols += [
            (f"{letter}_{a}_trend", slope(xs), "d"),
            (f"{letter}_{a}_dev", last_minus_one(xs), "d"),
        ]
        r = rel(distinct_monthly(key, f"{a}_id", months), [key], cols)
        out = r if out is None else out.joined(r)
    return out


def diversity_stats(key, months, months_only=False, wanted=STATS) -> Rel:
    out, letter = None, key[0]
    for a in STAT_ATTRS[key]:
        xs = [f"n_{m}" for m in months]
        full = xs if months_only else xs + [slope(xs), last_minus_one(xs)]
        cols = [(n, e, "d") for n, e in stats(full, f"{letter}_monthly_pd_{a}", wanted)]
        r = rel(distinct_monthly(key, f"{a}_id", months), [key], cols)
        out = r if out is None else out.joined(r)
    return out


def penetration(key, months) -> Rel:
    letter, last = key[0], months[-1]
    # a month without users is a gap: null in the slope, which then becomes 0
    gaps = [f"nullif(n_{m}, 0)" for m in months]
    cols = [(f"{letter}_pen_{m}_users", f"n_{m}", "i") for m in months]
    cols += [
        (f"{letter}_pen_{last}_user_trend", f"coalesce({slope(gaps)}, 0)", "d"),
        (f"{letter}_pen_{last}_user_dev", f"coalesce(CAST({gaps[-1]} AS DOUBLE) - 1, 0)", "d"),
    ]
    return rel(distinct_monthly(key, "user_id", months), [key], cols)


def penetration_stats(key, months, wanted=STATS) -> Rel:
    xs = [f"n_{m}" for m in months]
    cols = [(n, e, "d") for n, e in stats(xs, f"{key[0]}_monthly_pen_users", wanted)]
    return rel(distinct_monthly(key, "user_id", months), [key], cols)


def partner_rows(key, other, months) -> str:
    return (
        f"SELECT {key}, {other}, count(DISTINCT day) AS day, count(sldat) AS sldat, "
        f"coalesce(sum(amt), 0) AS amt FROM trade WHERE month IN ({month_list(months)}) "
        f"AND {key} IS NOT NULL AND {other} IS NOT NULL GROUP BY {key}, {other}"
    )


def partner_stats(key, other, months, prefix="") -> Rel:
    aggs, cols = [], []
    for v in ("day", "sldat", "amt"):
        for s in STATS:
            e = f"sum({v})::DOUBLE / count(*)" if s == "mean" else f"{s}({v})"
            aggs.append(f"{e} AS {prefix}{v}_{s}")
            cols.append(
                (f"{prefix}{v}_{s}", f"{prefix}{v}_{s}", "d" if s == "mean" or v == "amt" else "i")
            )
    source = f"SELECT {key}, {', '.join(aggs)} FROM ({partner_rows(key, other, months)}) p GROUP BY {key}"
    return rel(source, [key], cols)


def repeat_entity(key, months) -> Rel:
    letter = key[0]
    source = (
        f"SELECT {key}, count(*) FILTER (WHERE day > 1) AS buyers, "
        f"coalesce(sum(day) FILTER (WHERE day > 1), 0) AS days, count(*) AS all_buyers, "
        f"sum(day) AS all_days FROM ({partner_rows(key, 'user_id', months)}) p GROUP BY {key}"
    )
    return rel(source, [key], [
        (f"{letter}_repeat_buyer", "buyers", "i"),
        (f"{letter}_repeat_day", "days", "i"),
        (f"{letter}_repeat_buyer_ratio", "buyers::DOUBLE / all_buyers::DOUBLE", "d"),
        (f"{letter}_repeat_day_ratio", "buyers::DOUBLE / all_days::DOUBLE", "d"),
    ])


def repeat_user(attributes, months) -> Rel:
    out = None
    for a in attributes:
        head = f"u{a[0]}_repeat"
        rows = partner_rows("user_id", f"{a}_id", months)
        source = (
            f"SELECT user_id, coalesce(sum(day) FILTER (WHERE day > 1), 0) AS days, "
            f"count(*) FILTER (WHERE day > 1) AS things, count(*) AS all_things, "
            f"(SELECT sum(day) FROM ({rows}) t) AS all_days "
            f"FROM ({rows}) p GROUP BY user_id"
        )
        r = rel(source, ["user_id"], [
            (f"{head}_day", "days", "i"),
            (f"{head}_count", "things", "i"),
            (f"{head}_count_ratio", "days::DOUBLE / all_things::DOUBLE", "d"),
            (f"{head}_day_ratio", "days::DOUBLE / all_days::DOUBLE", "d"),
        ])
        out = r if out is None else out.joined(r)
    return out


def chain(*rels: Rel) -> Rel:
    out = rels[0]
    for r in rels[1:]:
        out = out.joined(r)
    return out


def items(months) -> Rel:
    k = ("item_id",)
    return chain(activity_stats(k, months), activity(k, months), penetration_stats(k[0], months),
                 penetration(k[0], months), repeat_entity(k[0], months))


def group_profile(key, months) -> Rel:
    k = (key,)
    return chain(activity_stats(k, months), activity(k, months), penetration_stats(key, months),
                 penetration(key, months), diversity_stats(key, months), diversity(key, months),
                 repeat_entity(key, months))


def users(months, over=(), repeat=()) -> Rel:
    k = ("user_id",)
    parts = [activity_stats(k, months), activity(k, months), diversity("user_id", months),
             diversity_stats("user_id", months)]
    parts += [partner_stats("user_id", f"{a}_id", months, f"{a[0]}_") for a in over]
    if repeat:
        parts.append(repeat_user(repeat, months))
    return chain(*parts)


def label(keys, month) -> Rel:
    listed = ", ".join(keys)
    known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return Rel(f"SELECT DISTINCT {listed}, 1 AS target FROM trade WHERE month = {month} AND {known}",
               tuple(keys), {"target": "i"})


def spend_label(month) -> Rel:
    return Rel(f"SELECT user_id, sum(amt) AS target FROM trade WHERE month = {month} "
               "AND user_id IS NOT NULL GROUP BY user_id", ("user_id",), {"target": "d"})


def user_pairs(attribute, months, label_month=None) -> Rel:
    key = f"{attribute}_id"
    things = items(months) if attribute == "item" else group_profile(key, months)
    things = things.joined(partner_stats(key, "user_id", months))
    out = activity_stats(("user_id", key), months)
    if label_month is not None:
        out = out.joined(label(("user_id", key), label_month))
    return out.joined(users(months, (attribute,), (attribute,))).joined(things)


def buy(months, label_month) -> Rel:
    return users(months, ("item",), ("brand", "item", "cat")).joined(label(("user_id",), label_month))


def spend(months, label_month) -> Rel:
    return users(months, ("item",), ("brand", "item", "cat")).joined(spend_label(label_month))
