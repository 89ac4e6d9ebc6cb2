"""Choosing columns by name, filling nulls, and small value formats."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType


def containing(df: DataFrame, fragment: str) -> list[str]:
    return [c for c in df.columns if fragment in c]


def drop_containing(df: DataFrame, fragments: Iterable[str]) -> DataFrame:
    """Drop every column whose name contains one of the fragments."""
    parts = list(fragments)
    return df.drop(*[c for c in df.columns if any(p in c for p in parts)])


def zero_nulls(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Null to 0 in all numeric columns but ``keep``."""
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, NumericType) and f.name not in keep
    ]
    return df.fillna(0, subset=names) if names else df


def feature_columns(df: DataFrame, keys: Sequence[str], target: str = "target") -> list[str]:
    """All columns that are neither a key nor the target."""
    return [c for c in df.columns if c != target and c not in keys]


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").otherwise("No")


def half_even(value: Column, places: int = 2) -> Column:
    return F.bround(value, places)
