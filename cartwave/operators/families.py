"""Feature families as aliased SQL expressions over rolled facts or entity summaries."""

from __future__ import annotations

from collections.abc import Sequence

from cartwave.functions.series import (
    STATS,
    deviation,
    gapped_deviation,
    gapped_trend,
    row_stats,
    trend,
    trend_ols,
)
from cartwave.operators.cube import MINOR_UNITS

# fixed values: name prefix of each entity or pair in feature names
PREFIX = {
    ("user_id",): "u_",
    ("brand_id",): "b_",
    ("cat_id",): "c_",
    ("item_id",): "i_",
    ("user_id", "brand_id"): "ub_",
    ("user_id", "cat_id"): "uc_",
    ("user_id", "item_id"): "ui_",
}
ATTRIBUTES = ("frequency", "days", "amts")

# which partner attributes are counted per entity, and which of those get
# period statistics
DIVERSITY = {
    "user_id": ("cat", "brand", "item"),
    "brand_id": ("cat", "item"),
    "cat_id": ("brand", "item"),
}
DIVERSITY_STATS = {
    "user_id": ("item",),
    "brand_id": ("cat", "item"),
    "cat_id": ("brand", "item"),
}


def _series(attribute: str, months: Sequence[int]) -> tuple[list[str], float]:
    """Monthly columns of one attribute and the unit they are counted in."""
    if attribute == "frequency":
        return [f"n_{m}" for m in months], 1.0
    if attribute == "days":
        return [f"cast(bit_count(d_{m}) as bigint)" for m in months], 1.0
    return [f"a_{m}" for m in months], MINOR_UNITS


def _scaled(values: Sequence[str], unit: float) -> list[str]:
    return list(values) if unit == 1.0 else [f"{v} / {unit!r}D" for v in values]


def activity(prefix: str, months: Sequence[int], ols: bool = False) -> list[str]:
    """Rows, distinct days and amount per month, each with trend and deviation."""
    monthly: list[str] = []
    shape: list[str] = []
    for attribute in ATTRIBUTES:
        values, unit = _series(attribute, months)
        monthly += [
            f"{v} as {prefix}count_{m}_{attribute}"
            for m, v in zip(months, _scaled(values, unit))
        ]
        shape += [
            f"{trend(values, unit)} as {prefix}{attribute}_trend",
            f"{deviation(values, unit)} as {prefix}{attribute}_dev",
        ]
        if ols:
            shape.append(f"{trend_ols(values, unit)} as {prefix}{attribute}_trend_ols")
    return monthly + shape


def activity_stats(
    prefix: str,
    months: Sequence[int],
    months_only: bool = False,
    stats: Sequence[str] = STATS,
) -> list[str]:
    """Statistics over the monthly columns, by default with trend and deviation."""
    out: list[str] = []
    for attribute in ATTRIBUTES:
        values, unit = _series(attribute, months)
        xs = _scaled(values, unit)
        if not months_only:
            xs = xs + [trend(values, unit), deviation(values, unit)]
        out += row_stats(xs, f"{prefix}monthly_count_{attribute}", stats)
    return out


def diversity(letter: str, attribute: str, months: Sequence[int]) -> list[str]:
    """Distinct partners per month with trend and deviation."""
    values = [f"others_{m}" for m in months]
    return [f"{v} as {letter}_pd_{m}_{attribute}" for m, v in zip(months, values)] + [
        f"{trend(values)} as {letter}_{attribute}_trend",
        f"{deviation(values)} as {letter}_{attribute}_dev",
    ]


def diversity_stats(
    letter: str,
    attribute: str,
    months: Sequence[int],
    months_only: bool = False,
    stats: Sequence[str] = STATS,
) -> list[str]:
    values = [f"others_{m}" for m in months]
    xs = list(values) if months_only else values + [trend(values), deviation(values)]
    return row_stats(xs, f"{letter}_monthly_pd_{attribute}", stats)


def penetration(letter: str, months: Sequence[int]) -> list[str]:
    """Distinct users per month; a month without users is a gap, not a zero."""
    values = [f"others_{m}" for m in months]
    last = months[-1]
    return [f"{v} as {letter}_pen_{m}_users" for m, v in zip(months, values)] + [
        f"{gapped_trend(values)} as {letter}_pen_{last}_user_trend",
        f"{gapped_deviation(values)} as {letter}_pen_{last}_user_dev",
    ]


def penetration_stats(
    letter: str, months: Sequence[int], stats: Sequence[str] = STATS
) -> list[str]:
    return row_stats([f"others_{m}" for m in months], f"{letter}_monthly_pen_users", stats)


def partner_stats(prefix: str = "") -> list[str]:
    """Sum, min, max and mean of days, rows and amount over an entity's partners."""
    out: list[str] = []
    for name in ("day", "sldat", "amt"):
        scale = f" / {MINOR_UNITS!r}D" if name == "amt" else ""
        for stat in ("sum", "min", "max"):
            out.append(f"coalesce({name}_{stat}{scale}, 0) as {prefix}{name}_{stat}")
        out.append(
            f"coalesce(try_divide({name}_sum{scale}, cast(partners as double)), 0D) "
            f"as {prefix}{name}_mean"
        )
    return out


def _share(part: str, whole: str) -> str:
    return f"coalesce(try_divide(cast({part} as double), cast({whole} as double)), 0D)"


def repeat_of_entity(letter: str) -> list[str]:
    """Users that came back on another day, and their days.

    The day ratio divides repeat *buyers* by all buyer-days.
    """
    return [
        f"repeat_partners as {letter}_repeat_buyer",
        f"repeat_days as {letter}_repeat_day",
        f"{_share('repeat_partners', 'partners')} as {letter}_repeat_buyer_ratio",
        f"{_share('repeat_partners', 'day_sum')} as {letter}_repeat_day_ratio",
    ]


def repeat_of_user(attribute: str) -> list[str]:
    """Things a user bought on more than one day.

    The count ratio divides repeat *days* by the user's distinct things; the day
    ratio divides them by ``all_user_days``, the days of all users.
    """
    head = f"u{attribute[0]}_repeat"
    return [
        f"repeat_days as {head}_day",
        f"repeat_partners as {head}_count",
        f"{_share('repeat_days', 'partners')} as {head}_count_ratio",
        f"{_share('repeat_days', 'all_user_days')} as {head}_day_ratio",
    ]
