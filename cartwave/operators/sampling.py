"""Repeatable sampling and splitting by a hash of the key.

Every choice depends only on the row's key and a seed, never on row order or
partitioning, so a lost executor recomputes exactly the same sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwave.operators.ranking import sorted_runs, take_smallest

# the first 8 hex digits of an md5 as a number
HASH_RANGE = 1 << 32
# copies of a row that are made in one place
COPIES = 4096


def key_hash(keys: Sequence[str], seed: int | Column) -> Column:
    """First 8 hex digits of md5 over seed and key, in [0, 2^32)."""
    start = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    text = F.concat_ws("|", start, *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def balanced_down(
    df: DataFrame, keys: Sequence[str], keep: int = 1, seed: int = 0, target: str = "target"
) -> DataFrame:
    """All rows of class ``keep`` and as many rows of the other class."""
    kept = df.where(F.col(target) == keep)
    wanted = kept.agg(F.count(F.lit(1)).alias("n")).scalar()
    other = df.where(F.col(target) == 1 - keep).withColumn("_h", key_hash(keys, seed))
    taken = take_smallest(other, "_h", keys, wanted)
    return kept.unionByName(taken.drop("_h"))


def balanced_up(
    df: DataFrame, keys: Sequence[str], seed: int = 0, target: str = "target"
) -> DataFrame:
    """Repeat rows of the smaller class until both classes have the same size.

    Each minority row is repeated floor(major / minor) times; the rest goes to the
    rows with the smallest hash, one more each.
    """
    sizes = df.agg(
        F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("ones"),
        F.sum(F.when(F.col(target) == 0, 1).otherwise(0)).alias("zeros"),
    )
    size = sizes.select(
        F.struct(
            F.when(F.col("ones") <= F.col("zeros"), 1).otherwise(0).alias("minor"),
            F.greatest("ones", "zeros").alias("big"),
            F.least("ones", "zeros").alias("small"),
        ).alias("s")
    ).scalar()
    rows = df.withColumn("_s", size)
    major = rows.where(F.col(target) != F.col("_s.minor"))
    minor = rows.where(F.col(target) == F.col("_s.minor")).withColumn("_h", key_hash(keys, seed))
    rest = sizes.select(
        (F.greatest("ones", "zeros") % F.nullif(F.least("ones", "zeros"), F.lit(0))).alias("r")
    ).scalar()
    marked = take_smallest(minor, "_h", keys, rest, flag="_extra")
    copies = F.floor(F.col("_s.big") / F.col("_s.small")) + F.col("_extra")
    # chunks of copies are spread before they are expanded: few rows may stand for very many.  The number of parts is
    # stated, as it would else follow from the few bytes before
    step = F.lit(COPIES).cast("long")
    chunks = marked.withColumn("_copies", copies).withColumn(
        "_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, step)))
    repeated = (
        chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_from")
        .withColumn("_copy", F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + step, "_copies"))))
        .drop("_copy", "_copies", "_from", "_extra", "_h")
    )
    return major.unionByName(repeated).drop("_s")


def with_split(
    df: DataFrame, keys: Sequence[str], seed: int | Column, test_share: float = 0.2
) -> DataFrame:
    """Add ``is_test`` (0/1): a fixed share of the rows, chosen by hash."""
    edge = int(HASH_RANGE * (1 - test_share))
    return df.withColumn("is_test", (key_hash(keys, seed) >= edge).cast("int"))


def repeated_splits(
    df: DataFrame, keys: Sequence[str], seeds: Sequence[int], test_share: float = 0.2
) -> DataFrame:
    """One copy of the rows per seed, with columns ``split`` and ``is_test``."""
    ids = F.explode(F.array(*[F.lit(s) for s in seeds]))
    return with_split(df.withColumn("split", ids), keys, F.col("split"), test_share)


def with_fold(df: DataFrame, keys: Sequence[str], folds: int, seed: int = 78) -> DataFrame:
    """Add ``fold`` in 0..folds-1.

    The hash ignores the class, so each class is spread evenly over the folds: the
    folds are stratified in expectation, without counting anything.
    """
    fold = F.floor(key_hash(keys, seed) * folds / F.lit(HASH_RANGE)).cast("int")
    return df.withColumn("fold", fold)


def with_exact_fold(
    df: DataFrame, keys: Sequence[str], folds: int, seed: int = 78, target: str = "target"
) -> DataFrame:
    """Add ``fold`` in 0..folds-1 so that each class's fold sizes differ by at most one.

    A row's rank by hash within its class, modulo the folds.  Ranks of hashes come from refined buckets; only rows that share class and
    hash are ordered by key, so no class meets in a window.  Rows of a null class have a null fold.
    """
    hashed = df.withColumn("_h", key_hash(keys, seed))
    ranks = sorted_runs(hashed.where(F.col(target).isNotNull()), [target], "_h").select(target, "_h", "rank_from")
    same = F.row_number().over(Window.partitionBy(target, "_h").orderBy(*keys)) - 1
    placed = hashed.withColumn("_same", same).join(ranks, [target, "_h"], "left")
    fold = F.pmod(F.col("rank_from") + F.col("_same"), F.lit(folds)).cast("int")
    return placed.withColumn("fold", fold).select(*df.columns, "fold")
