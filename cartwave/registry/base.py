"""Helpers shared by the registered queries and their check SQL.

Both sides round doubles to six places with the same arithmetic, so a result is
compared by value and not by how an engine prints it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is registered twice")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles and decimals to ``places`` digits, whole numbers to bigint."""
    unit = f"1e{places}D"
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            cols.append(
                f"cast(floor(cast(`{f.name}` as double) * {unit} + 0.5D) as double) / {unit} "
                f"as `{f.name}`"
            )
        elif isinstance(f.dataType, IntegralType):
            cols.append(f"cast(`{f.name}` as bigint) as `{f.name}`")
        else:
            cols.append(f"`{f.name}`")
    return df.selectExpr(*cols)


def sql_double(expr: str, name: str, places: int = 6) -> str:
    unit = f"1e{places}::DOUBLE"
    return f"floor(CAST({expr} AS DOUBLE) * {unit} + 0.5::DOUBLE) / {unit} AS {name}"


def sql_whole(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


@dataclass
class Rel:
    """A SELECT text with its keys and the kind ("d" or "i") of each other column."""

    body: str
    keys: tuple[str, ...]
    kinds: dict[str, str]

    def joined(self, other: "Rel", how: str = "LEFT") -> "Rel":
        keys = tuple(k for k in other.keys if k in self.keys)
        mine = ", ".join(f"l.{c}" for c in (*self.keys, *self.kinds))
        theirs = ", ".join(
            f"coalesce(r.{c}, 0) AS {c}" for c in other.kinds if c not in self.kinds
        )
        body = (
            f"SELECT {mine}, {theirs} FROM ({self.body}) l {how} JOIN ({other.body}) r "
            f"ON {' AND '.join(f'l.{k} = r.{k}' for k in keys)}"
        )
        return Rel(body, self.keys, {**self.kinds, **other.kinds})

    def final(self, ctes: str) -> str:
        cols = [*self.keys]
        for name, kind in self.kinds.items():
            cols.append(sql_double(name, name) if kind == "d" else sql_whole(name, name))
        return f"WITH {ctes} SELECT {', '.join(cols)} FROM ({self.body}) z"
