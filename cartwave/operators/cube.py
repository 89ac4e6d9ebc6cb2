"""The additive base of every purchase feature.

``monthly_facts`` turns each log row into per-month columns that add up: a row
count, a day-of-month bit mask and an amount in minor units.  ``roll`` groups them
by any keys and returns the same columns, so a roll-up of a roll-up is again valid
and every step is an ordinary partial aggregate.  No ``count(distinct)`` is used:
distinct days come from OR-ed masks, distinct partners from one row per pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cartwave.sources.trade import KEYS, in_months

MINOR_UNITS = 100.0


def measures(months: Sequence[int]) -> list[str]:
    return [f"{kind}_{m}" for m in months for kind in ("n", "d", "a")]


def monthly_facts(trade: DataFrame, months: Sequence[int]) -> DataFrame:
    """Per row: the four keys and additive columns ``n_m, d_m, a_m`` per month."""
    cols = []
    for m in months:
        # the mask is 64 bits wide: bit 31 of a 32-bit mask would be the sign bit
        cols += [
            f"case when month = {m} then 1L else 0L end as n_{m}",
            f"case when month = {m} then shiftleft(1L, day) else 0L end as d_{m}",
            f"case when month = {m} then coalesce(cast(amt * 100 as bigint), 0L) "
            f"else 0L end as a_{m}",
        ]
    return in_months(trade, months).selectExpr(*KEYS, *cols)


def month_cube(trade: DataFrame) -> DataFrame:
    """One row per (month, user, item, brand, category) with ``n, d, a``: every window and label can be read from it."""
    return trade.groupBy("month", *KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.expr("bit_or(shiftleft(1L, day)) as d"),
        F.expr("sum(coalesce(cast(amt * 100 as bigint), 0L)) as a"),
    )


def is_month_cube(rows: DataFrame) -> bool:
    return {"n", "d", "a"} <= set(rows.columns)


def window_facts(cube: DataFrame, months: Sequence[int]) -> DataFrame:
    """The additive columns per month of a window; only its months of the cube are read."""
    cols = [f"case when month = {m} then {c} else 0L end as {c}_{m}" for m in months for c in ("n", "d", "a")]
    return in_months(cube, months).selectExpr(*KEYS, *cols)


def rolled_measures(months: Sequence[int]) -> list[Column]:
    return [
        F.expr(f"{'bit_or' if c.startswith('d_') else 'sum'}({c}) as {c}")
        for c in measures(months)
    ]


def roll(facts: DataFrame, keys: Sequence[str], months: Sequence[int]) -> DataFrame:
    """Facts grouped by ``keys``; null keys stay as groups of their own."""
    return facts.groupBy(*keys).agg(*rolled_measures(months))


def base_cube(trade: DataFrame, months: Sequence[int]) -> DataFrame:
    """One row per (user, item, brand, category): the input of a whole profile."""
    return roll(monthly_facts(trade, months), KEYS, months)


def period(months: Sequence[int]) -> dict[str, str]:
    """Distinct days of month, rows and minor units over the whole period."""
    return {
        "day": "cast(bit_count(" + " | ".join(f"d_{m}" for m in months) + ") as bigint)",
        "sldat": "(" + " + ".join(f"n_{m}" for m in months) + ")",
        "amt": "(" + " + ".join(f"a_{m}" for m in months) + ")",
    }


def summary(
    pairs: DataFrame, entity: str, other: str, months: Sequence[int]
) -> DataFrame:
    """One row per entity from its (entity, other) pair table.

    Besides the rolled measures it carries ``others_m`` (distinct partners per
    month), the period statistics over partners, and the repeat counts, all in one
    grouping.  A null partner counts for the measures, not for the partner columns.
    """
    known = f"{other} is not null"
    aggs = rolled_measures(months)
    for m in months:
        aggs.append(
            F.expr(f"sum(case when {known} and n_{m} > 0 then 1L else 0L end) as others_{m}")
        )
    values = period(months)
    for name, value in values.items():
        for stat in ("sum", "min", "max"):
            aggs.append(F.expr(f"{stat}(case when {known} then {value} end) as {name}_{stat}"))
    day = values["day"]
    again = f"{known} and {day} > 1"
    aggs += [
        F.expr(f"sum(case when {known} then 1L else 0L end) as partners"),
        F.expr(f"sum(case when {again} then 1L else 0L end) as repeat_partners"),
        F.expr(f"sum(case when {again} then {day} else 0L end) as repeat_days"),
    ]
    return pairs.where(f"{entity} is not null").groupBy(entity).agg(*aggs)
