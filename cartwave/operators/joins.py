"""Joins that keep their shape when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from cartwave.session import cut

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than
# HOT_SHARE keys can be hot and the list of them is always small.
HOT_SHARE = 256
# A side is broadcast only after a count showed it has at most this many rows:
# narrow lookup tables, and wide profile tables.
NARROW_ROWS = 200_000
WIDE_ROWS = 20_000


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def hot_keys(weights: DataFrame, keys: Sequence[str], weight: str = "_rows") -> DataFrame:
    """Keys with more than 1/HOT_SHARE of the total weight, and their salt counts.

    ``weights`` has one row per key.  The salt counts add up to less than
    2 * HOT_SHARE, so the right side of a salted join grows by no more than that.
    """
    total = weights.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).scalar()
    share = F.col(weight) * HOT_SHARE / total
    return weights.where(F.col(weight) * HOT_SHARE > total).select(
        *keys, F.ceil(share).cast("int").alias("_salts")
    )


def row_weights(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = df.select(*keys).dropna()
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    salt_by: Sequence[str],
    how: str = "left",
    weights: DataFrame | None = None,
    small_rows: int | None = None,
) -> DataFrame:
    """Equi-join of a large left side with a right side that is unique per key.

    A right side counted as small is broadcast.  Otherwise both sides are shuffled,
    and keys that hold a large share of the left rows are split: their left rows get
    a salt from a hash of ``salt_by`` and their one right row is repeated per salt.
    Cold keys keep salt 0, so the result equals the plain join.  ``weights`` gives
    the left row count (``_rows``) per key where it is cheaper than counting here.
    """
    if weights is None:
        weights = row_weights(left, keys)
    limit = WIDE_ROWS if small_rows is None else small_rows
    if fits_broadcast(right.select(*keys), limit):
        return left.join(F.broadcast(right), list(keys), how)
    # fewer than HOT_SHARE rows, whatever the data
    hot = cut(hot_keys(weights, keys))
    unknown = reduce(or_, [F.col(k).isNull() for k in keys])
    if hot.isEmpty() and (how == "inner" or left.where(unknown).isEmpty()):
        return left.join(right, list(keys), how)
    hot = F.broadcast(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    # rows of a null key meet nothing and are spread, as they may be many
    spread = F.when(unknown, F.lit(HOT_SHARE)).otherwise(salts)
    salted_left = (
        left.join(hot, list(keys), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), spread).cast("int"))
        .drop("_salts")
    )
    salted_right = (
        right.join(hot, list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def attach_label(df: DataFrame, label: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a label that is unique per key; no match means 0."""
    return df.join(label, list(keys), "left").fillna(0, subset=["target"])
