"""Labelled training tables per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cartwave.functions.columns import zero_nulls
from cartwave.operators.cube import is_month_cube, month_cube, window_facts
from cartwave.operators.joins import attach_label
from cartwave.operators.labels import bought, spent
from cartwave.plans.profiles import ENTITY, Profiles
from cartwave.session import cut, delete
from cartwave.sources.trade import in_months
from cartwave.sources.windows import DATASETS, TEST_WINDOWS, WINDOWS, Window

ALL_ATTRIBUTES = ("brand", "item", "cat")


def monthly(trade: DataFrame, window: Window) -> DataFrame:
    """The month cube of a window's months and its label month, stored; a cube is taken as it is.

    The log is read once for features and label, and nothing else is written before the result.
    """
    if is_month_cube(trade):
        return trade
    return cut(month_cube(in_months(trade, months_of(window))))


def months_of(window: Window) -> list[int]:
    return [*window.feature_months, *([window.label_month] if window.label_month is not None else [])]


def profiles(trade: DataFrame, window: Window) -> Profiles:
    """Profile builders over the window's months of the cube."""
    return Profiles(window_facts(monthly(trade, window), window.feature_months), window.feature_months)


def user_pair_dataset(
    trade: DataFrame, window: Window, attribute: str, built: Profiles | None = None
) -> DataFrame:
    """User x item / brand / category features; target 1 if bought in the label month."""
    keys = ["user_id", ENTITY[attribute]]
    trade = monthly(trade, window)
    label = None
    if window.label_month is not None:
        label = bought(trade, window.label_month, keys)
    return (built or profiles(trade, window)).user_pairs(attribute, label)


def _user_features(trade: DataFrame, window: Window, built: Profiles | None) -> DataFrame:
    return (built or profiles(trade, window)).users(over=("item",), repeat=ALL_ATTRIBUTES)


def buy_dataset(trade: DataFrame, window: Window, built: Profiles | None = None) -> DataFrame:
    """User features; target 1 if the user bought anything in the label month."""
    trade = monthly(trade, window)
    users = _user_features(trade, window, built)
    if window.label_month is not None:
        users = attach_label(users, bought(trade, window.label_month, ["user_id"]), ["user_id"])
    return zero_nulls(users, keep=("user_id",))


def spend_dataset(trade: DataFrame, window: Window, built: Profiles | None = None) -> DataFrame:
    """User features; target is the amount spent in the label month."""
    trade = monthly(trade, window)
    users = _user_features(trade, window, built)
    if window.label_month is not None:
        users = attach_label(users, spent(trade, window.label_month), ["user_id"])
    return zero_nulls(users, keep=("user_id",))


def dataset(
    trade: DataFrame, window: Window, name: str, built: Profiles | None = None
) -> DataFrame:
    """One of the datasets named in ``DATASETS``."""
    if name == "user":
        return buy_dataset(trade, window, built)
    if name == "spend":
        return spend_dataset(trade, window, built)
    return user_pair_dataset(trade, window, name.removeprefix("user_"), built)


def write_window(
    trade: DataFrame, window: Window, path: str, names: tuple[str, ...] = tuple(DATASETS)
) -> None:
    """Write every dataset of one window from one month cube."""
    cube = monthly(trade, window)
    built = profiles(cube, window)
    for name in names:
        table = dataset(cube, window, name, built)
        table.write.mode("overwrite").parquet(f"{path}/{DATASETS[name]}/window={window.name}")


def update_cube(trade: DataFrame, path: str, months: Sequence[int]) -> DataFrame:
    """The cube stored by month under ``path``, its ``months`` made anew from the log and all others left as they are.

    Only these months' rows of the log are read.  A month without rows leaves no folder behind, an old one included.
    """
    spark = trade.sparkSession
    fresh = cut(month_cube(in_months(trade, months)))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/cube")
    held = {r["month"] for r in fresh.select("month").distinct().collect()}
    for month in set(months) - held:
        delete(spark, f"{path}/cube/month={month}")
    return spark.read.schema(fresh.schema).parquet(f"{path}/cube")


def write_all_windows(
    trade: DataFrame,
    path: str,
    windows: tuple[Window, ...] = WINDOWS + TEST_WINDOWS,
    names: tuple[str, ...] = tuple(DATASETS),
    changed: Sequence[int] | None = None,
) -> None:
    """The window driver: the log is read once into a cube stored by month, every dataset of every window from the cube.

    With ``changed``, the months whose log rows are new, only these are aggregated and only windows that hold one are written again; the
    others' tables of an earlier run stay.
    """
    months = sorted({m for w in windows for m in months_of(w)})
    cube = update_cube(trade, path, months if changed is None else sorted(set(months) & set(changed)))
    for window in windows:
        if changed is None or set(months_of(window)) & set(changed):
            write_window(cube, window, path, names)


def read_dataset(spark, path: str, name: str, window: Window) -> DataFrame:
    """One labelled table of one window; only that window's folder is listed."""
    return spark.read.parquet(f"{path}/{DATASETS[name]}/window={window.name}")


def label_share(df: DataFrame) -> DataFrame:
    """Class balance of a labelled table."""
    return df.agg(
        F.sum(F.col("target")).alias("positives"),
        F.count(F.lit(1)).alias("n"),
    )
