"""SQL expressions over a short monthly series.

A series is a list of SQL expressions, one per month, oldest first.  Everything
here is plain arithmetic on columns of one row, so it stays inside generated code
and needs no shuffle.  Expressions are text: a profile has over a hundred of them,
and one ``selectExpr`` is far cheaper to build than as many ``Column`` trees.
"""

from __future__ import annotations

from collections.abc import Sequence

STATS = ("sum", "min", "max", "mean")


def total(values: Sequence[str]) -> str:
    return "(" + " + ".join(values) + ")"


def _slope(values: Sequence[str], divisor: int, unit: float) -> str:
    n = len(values)
    steps = sum(range(1, n + 1))
    if divisor == 0:
        return "0D"
    weights = [n * i - steps for i in range(1, n + 1)]
    numerator = " + ".join(f"({w}) * {v}" for w, v in zip(weights, values) if w)
    scale = "" if unit == 1.0 else f" / {float(unit)!r}D"
    # adding 0 turns a negative zero into zero
    return f"(cast({numerator} as double){scale} / {float(divisor)!r}D + 0D)"


def trend(values: Sequence[str], unit: float = 1.0) -> str:
    """Slope of the series with the non-standard divisor sum(i^2) - sum(i)^2.

    ``unit`` rescales integer minor units, so the numerator stays exact.
    A one-month series has no slope and gives 0.
    """
    n = len(values)
    steps = sum(range(1, n + 1))
    return _slope(values, sum(i * i for i in range(1, n + 1)) - steps * steps, unit)


def trend_ols(values: Sequence[str], unit: float = 1.0) -> str:
    """Ordinary least-squares slope over months 1..n."""
    n = len(values)
    steps = sum(range(1, n + 1))
    return _slope(values, n * sum(i * i for i in range(1, n + 1)) - steps * steps, unit)


def deviation(values: Sequence[str], unit: float = 1.0) -> str:
    """Last month minus one, or 0 for a series that sums to zero."""
    scale = "" if unit == 1.0 else f" / {float(unit)!r}D"
    last = f"cast({values[-1]} as double){scale}"
    return f"(case when {total(values)} <> 0 then {last} - 1D else 0D end)"


def gapped_trend(values: Sequence[str]) -> str:
    """Trend of a series whose zeros mean "missing": any gap gives 0."""
    whole = " and ".join(f"{v} <> 0" for v in values)
    return f"(case when {whole} then {trend(values)} else 0D end)"


def gapped_deviation(values: Sequence[str]) -> str:
    """Deviation of a series whose zeros mean "missing"."""
    last = values[-1]
    return f"(case when {last} <> 0 then cast({last} as double) - 1D else 0D end)"


def row_stats(values: Sequence[str], prefix: str, stats: Sequence[str] = STATS) -> list[str]:
    """Sum, min, max and mean across columns of one row, as aliased expressions."""
    xs = [f"cast({v} as double)" for v in values]
    listed = ", ".join(xs)
    one = len(xs) == 1
    exprs = {
        "sum": total(xs),
        "min": xs[0] if one else f"least({listed})",
        "max": xs[0] if one else f"greatest({listed})",
        "mean": f"{total(xs)} / {float(len(xs))!r}D",
    }
    return [f"{exprs[s]} as {prefix}_{s}" for s in stats]
