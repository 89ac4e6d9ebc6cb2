"""Writing results and reading them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; if there is none it is built, written and read."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def write_families(families: dict[tuple[str, ...], DataFrame], path: str) -> None:
    """One table per feature family, named by its keys."""
    for keys, df in families.items():
        df.write.mode("overwrite").parquet(f"{path}/{'-'.join(keys)}")


def read_family(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    return spark.read.parquet(f"{path}/{'-'.join(keys)}")


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """A folder of CSV parts, written in parallel."""
    df.write.mode("overwrite").option("header", header).csv(path)


def write_board(board: DataFrame, path: str) -> None:
    """A leaderboard: one row per model, so one sorted part."""
    board.coalesce(1).write.mode("overwrite").parquet(path)


def write_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").parquet(path)
