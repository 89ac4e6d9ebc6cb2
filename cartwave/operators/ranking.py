"""Exact order statistics without sorting a whole group in one task.

Values are counted first: one stored run per distinct value of a group.  A group of more than ``BOUND`` distinct values is
split into ``PARTS`` buckets between its least and its largest value, a bucket that still has too many into as many again, and so on
until none has: however close values lie, least and largest of a bucket always part.  Rows before a bucket are prefix sums
on two levels, those before its parent plus those of its earlier siblings.  So no window holds more than ``BOUND`` values or
``PARTS`` buckets, and a group with most of the rows costs no more than any other.  One position is found the same way, going on with
only the bucket that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from cartwave.operators.joins import spread_join
from cartwave.session import cut

# most distinct values, and most sibling buckets, that a window holds
BOUND = 65_536
PARTS = 1024


def _runs(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct values of each group with their counts ``n``, stored; nulls have no rank."""
    return cut(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")))


def _before(rows: DataFrame, groups: Sequence[str], by: str) -> Column:
    """Sum of ``n`` over earlier rows of the group."""
    over = Window.partitionBy(*groups).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(over), F.lit(0).cast("long"))


def _summed(rows: DataFrame, keys: Sequence[str], value: str, *more: Column) -> DataFrame:
    number = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(
        F.min(number).alias("_low"), F.max(number).alias("_high"), F.count(F.lit(1)).alias("_values"), F.sum("n").alias("n"), *more
    )


def _refined(runs: DataFrame, groups: list[str], value: str, position: Column | None = None) -> DataFrame:
    """Runs with their bucket (``_path``) and the number of rows before it (``_start``), buckets of at most ``BOUND`` values.

    With ``position``, which may use ``_total``, only the runs of the bucket that holds it, and ``_wanted``, its place in the group.
    Values that are one double (or not finite) are not parted.
    """
    first = _summed(runs, groups, value)
    too_many = (F.col("_values") > BOUND) & (F.col("_low") < F.col("_high")) & (F.col("_high") - F.col("_low") < float("inf"))
    root = {"_path": F.lit(""), "_start": F.lit(0).cast("long")}
    if first.where(too_many).isEmpty():
        rows = runs.withColumns(root)
        if position is None:
            return rows
        return rows.withColumn("_total", F.sum("n").over(Window.partitionBy(*groups, "_path"))).withColumn("_wanted", position)
    first = first.withColumns({**root, "_total": F.col("n")})
    if position is not None:
        first = first.withColumn("_wanted", position)
        first = first.where((F.col("_wanted") >= 0) & (F.col("_wanted") < F.col("_total")))
    carried = ["_start"] if position is None else ["_start", "_wanted"]
    keys = [*groups, "_path"]
    buckets, rows, done = cut(first), runs.withColumn("_path", F.lit("")), None
    while True:
        open_ = buckets.where(too_many)
        more = not open_.isEmpty()
        # the rows of buckets that are small enough have their place
        ready = buckets.where(~too_many) if more else buckets
        placed = spread_join(rows, ready.select(*keys, *carried), keys, [value], how="inner")
        done = placed if done is None else done.unionByName(placed)
        if not more:
            return done
        share = (F.col(value).cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))
        part = F.greatest(F.lit(0), F.least(F.lit(PARTS - 1), F.floor(share * PARTS)))
        parents = open_.select(*keys, "_low", "_high", *carried)
        path = F.format_string("%s.%04d", F.col("_path"), part.cast("int"))
        inside = spread_join(rows, parents, keys, [value], how="inner").withColumns({"_parent": F.col("_path"), "_path": path})
        rows = cut(inside.drop("_low", "_high"))
        kids = _summed(rows, [*groups, "_parent", "_path", *carried], value)
        kids = kids.withColumn("_start", F.col("_start") + _before(kids, [*groups, "_parent"], "_path"))
        if position is not None:
            kids = kids.where((F.col("_start") <= F.col("_wanted")) & (F.col("_wanted") < F.col("_start") + F.col("n")))
        buckets, rows = cut(kids.drop("_parent")), rows.drop("_parent", *carried)


def value_at(df: DataFrame, groups: Sequence[str], value: str, position: Column, name: str) -> DataFrame:
    """Per group the value at one position (from 0) of the sorted values.

    ``position`` may use ``_total``, the number of values in the group.  A position outside gives no row.
    """
    return _at(df, list(groups), value, position).select(*groups, F.col(value).alias(name))


def _at(df: DataFrame, groups: list[str], value: str, position: Column) -> DataFrame:
    """The run at a position, with ``n`` and ``_before``, the rows of smaller values."""
    rows = _refined(_runs(df, groups, value), groups, value, position)
    ranked = rows.withColumn("_before", F.col("_start") + _before(rows, [*groups, "_path"], value))
    return ranked.where((F.col("_before") <= F.col("_wanted")) & (F.col("_wanted") < F.col("_before") + F.col("n")))


def upper_median(
    df: DataFrame, groups: Sequence[str], value: str, name: str = "median"
) -> DataFrame:
    """Per group the value at position floor(n/2) of the sorted values."""
    return value_at(df, groups, value, F.floor(F.col("_total") / 2), name)


def middle_median(
    df: DataFrame, groups: Sequence[str], value: str, name: str = "median"
) -> DataFrame:
    """Per group the usual median: the mean of the two middle values."""
    low = value_at(df, groups, value, F.floor((F.col("_total") - 1) / 2), "_low")
    high = upper_median(df, groups, value, "_high")
    both = low.join(high, list(groups))
    return both.select(*groups, ((F.col("_low") + F.col("_high")) / 2).alias(name))


def sorted_runs(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The sorted curve of a group as runs of equal values.

    One row per distinct value: ``value``, ``rank_from`` (starting at 0), ``n``.
    """
    groups = list(groups)
    rows = _refined(_runs(df, groups, value), groups, value)
    rank = F.col("_start") + _before(rows, [*groups, "_path"], value)
    return rows.select(*groups, value, rank.alias("rank_from"), "n")


def sorted_curve(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    chunk: int = 65_536,
) -> DataFrame:
    """One row per rank.  Long runs are cut into chunks and spread before expanding."""
    runs = sorted_runs(df, groups, value)
    pieces = runs.withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))
    ).repartition(*groups, "rank_from", "_from")
    last = F.least(F.col("_from") + chunk, F.col("n")) - 1
    return pieces.withColumn(
        "rank", F.explode(F.sequence(F.col("rank_from") + F.col("_from"), F.col("rank_from") + last))
    ).select(*groups, "rank", value)


def take_smallest(
    df: DataFrame, value: str, ties: Sequence[str], k: int | Column, flag: str | None = None
) -> DataFrame:
    """The ``k`` rows with the smallest value, ties broken by key.

    The value at position k is found first; rows below it pass without being ranked or moved.  If more than ``BOUND`` rows share
    it, the first key's value at the boundary among them is found the same way, and so on; at most ``BOUND`` rows are sorted (more only
    if that many agree in the value and in all numeric keys).  With ``flag`` all rows are returned, marked 1 or 0.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if any(isinstance(kinds[c], (DoubleType, FloatType)) for c in (value, *ties)):
        df = cut(df)  # a sum that is made anew may differ in its last bits from the boundary
    need = k if isinstance(k, int) else df.sparkSession.range(1).select(k.alias("k")).first()["k"] or 0
    known = F.col(value).isNotNull()
    taken, edge = F.lit(False), known if need > 0 else F.lit(False)
    order = [value, *ties]
    for i, c in enumerate(order):
        if need <= 0 or not isinstance(kinds[c], NumericType):
            break
        at = _at(df.where(edge), [], c, F.lit(need - 1).cast("long")).first()
        if at is None:
            taken, edge, need = taken | edge, F.lit(False), 0
            break
        here = F.lit(at[c]).cast(kinds[c])
        taken, edge, need = taken | (edge & (F.col(c) < here)), edge & (F.col(c) == here), need - at["_before"]
        order = [*ties[i:]]
        if at["n"] <= BOUND:
            break
    taken, edge = F.coalesce(taken, F.lit(False)), F.coalesce(edge, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*(order or [value])))
    tight = df.where(edge).withColumn("_r", rank)
    chosen = F.col("_r") <= F.lit(need)
    if flag is None:
        return df.where(taken).unionByName(tight.where(chosen).drop("_r"))
    sure = df.where(~edge & known).withColumn(flag, taken.cast("int"))
    return sure.unionByName(tight.withColumn(flag, chosen.cast("int")).drop("_r"))
