"""Joining reports to their stations and filling what is unknown."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from cartwave.functions.columns import zero_nulls
from cartwave.functions.geo import CELL_METRES, grid_of
from cartwave.operators.joins import NARROW_ROWS, fits_broadcast, spread_join
from cartwave.sources.reports import SLOT_COLUMNS, SLOTS

MAIN = ("RNCID_1", "CellID_1")


def slot_lookup(
    reports: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    slots: Iterable[int],
    row_id: str,
    small_rows: int = NARROW_ROWS,
) -> DataFrame:
    """Add ``value_i`` for each slot i by the slot's keys ``key_i``; left join.

    ``table`` is unique per key.  A table counted as small is broadcast once per
    slot, without moving the reports.  A larger one is joined once: the slots become
    rows, meet the table in a single shuffle that splits hot stations, and return as
    columns through one grouping by ``row_id``.
    """
    slots = list(slots)
    if not slots:
        return reports
    table = table.select(*keys, *values)
    if fits_broadcast(table, small_rows):
        out = reports
        for i in slots:
            side = table.select(
                *[F.col(k).alias(f"_k_{k}") for k in keys],
                *[F.col(v).alias(f"{v}_{i}") for v in values],
            )
            match = [F.col(f"{k}_{i}") == F.col(f"_k_{k}") for k in keys]
            out = out.join(F.broadcast(side), match, "left").drop(*[f"_k_{k}" for k in keys])
        return out
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("_slot"), *[F.col(f"{k}_{i}").alias(k) for k in keys])
            for i in slots
        ]
    )
    long = reports.select(row_id, F.explode(entries).alias("_e")).select(row_id, "_e.*")
    long = long.dropna(subset=list(keys))
    found = spread_join(long, table, keys, [row_id], how="inner", small_rows=0)
    wide = found.groupBy(row_id).agg(
        *[
            F.max(F.when(F.col("_slot") == i, F.col(v))).alias(f"{v}_{i}")
            for i in slots
            for v in values
        ]
    )
    return reports.join(wide, row_id, "left")


def with_positions(
    reports: DataFrame,
    stations: DataFrame,
    row_id: str = "row_id",
    small_rows: int = NARROW_ROWS,
    slots: Sequence[int] = range(1, SLOTS + 1),
) -> DataFrame:
    """Add Longitude_i and Latitude_i of the stations of a report."""
    return slot_lookup(
        reports,
        stations.dropDuplicates(["RNCID", "CellID"]),
        ["RNCID", "CellID"],
        ["Longitude", "Latitude"],
        slots,
        row_id,
        small_rows,
    )


def fill_from_main(df: DataFrame) -> DataFrame:
    """Where a station's position is unknown, take all its values from station 1."""
    out = {}
    for i in range(2, SLOTS + 1):
        unknown = F.col(f"Latitude_{i}").isNull() | F.col(f"Longitude_{i}").isNull()
        for name in ("Latitude", "Longitude", *SLOT_COLUMNS):
            out[f"{name}_{i}"] = F.when(unknown, F.col(f"{name}_1")).otherwise(
                F.col(f"{name}_{i}")
            )
    return df.withColumns(out)


def with_cells(
    df: DataFrame,
    lat: str = "Latitude",
    lon: str = "Longitude",
    cell: int = CELL_METRES,
    extent: DataFrame | None = None,
) -> DataFrame:
    """Add ``Target``, the grid cell of the true position.

    ``extent`` holds the same positions where they are cheaper to read than in ``df``.
    """
    grid = grid_of(df if extent is None else extent, lat, lon, cell)
    return df.withColumn("Target", grid.cell_of(F.col(lat), F.col(lon)))


def training_table(
    reports: DataFrame,
    stations: DataFrame,
    fill_with_zero: bool = True,
    row_id: str = "row_id",
    extent: DataFrame | None = None,
) -> DataFrame:
    """Reports with grid cell, renamed truth, station positions and no nulls."""
    labelled = with_cells(reports, extent=extent).withColumnsRenamed(
        {"Longitude": "Longitude_m", "Latitude": "Latitude_m"}
    )
    placed = with_positions(labelled, stations, row_id)
    if fill_with_zero:
        return zero_nulls(placed, keep=(row_id,))
    return fill_from_main(placed)


def distinct_stations(df: DataFrame) -> DataFrame:
    """Main stations with their position."""
    return df.select(*MAIN, "Latitude_1", "Longitude_1").dropDuplicates()


def station_position(df: DataFrame, rncid: int, cellid: int) -> DataFrame:
    """Position of one main station, found by both parts of its key."""
    here = (F.col("RNCID_1") == rncid) & (F.col("CellID_1") == cellid)
    return distinct_stations(df.where(here)).select("Latitude_1", "Longitude_1")


def with_offsets(df: DataFrame) -> DataFrame:
    """Offset of the record from its main station, in degrees.

    Records whose main station has no known position are dropped: an offset from
    nowhere means nothing.
    """
    known = df.where(
        F.col("Latitude_1").isNotNull()
        & F.col("Longitude_1").isNotNull()
        & ~((F.col("Latitude_1") == 0) & (F.col("Longitude_1") == 0))
    )
    return known.withColumns(
        {
            "relative_longitude": F.col("Longitude_m") - F.col("Longitude_1"),
            "relative_latitude": F.col("Latitude_m") - F.col("Latitude_1"),
        }
    )


def with_absolute(df: DataFrame, dlat: str, dlon: str) -> DataFrame:
    """Predicted position from a predicted offset."""
    return df.withColumns(
        {
            "pred_latitude": F.col(dlat) + F.col("Latitude_1"),
            "pred_longitude": F.col(dlon) + F.col("Longitude_1"),
        }
    )
