"""Geo expressions: distances in metres and square grid cells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: earth radius in km, side of a grid cell in metres
EARTH_RADIUS_KM = 6371
CELL_METRES = 20


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    rlat1, rlat2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((rlat2 - rlat1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(rlat1) * F.cos(rlat2) * half_lon * half_lon
    return F.asin(F.sqrt(a)) * 2 * EARTH_RADIUS_KM * 1000


@dataclass(frozen=True)
class Grid:
    """A bounding box cut into square cells, all fields as columns."""

    lat_min: Column
    lat_max: Column
    lon_min: Column
    lon_max: Column
    rows: Column
    cols: Column
    cell: int = CELL_METRES

    def cell_of(self, lat: Column, lon: Column) -> Column:
        """Cell id ``row * cols + col``; the far edges belong to the last cells."""
        row = F.floor(haversine(self.lat_min, self.lon_min, lat, self.lon_min) / self.cell)
        col = F.floor(haversine(self.lat_min, self.lon_min, self.lat_min, lon) / self.cell)
        return (
            F.least(row, self.rows - 1) * self.cols + F.least(col, self.cols - 1)
        ).cast("long")

    def centre_of(self, cell: Column, true_division: bool = False) -> tuple[Column, Column]:
        """Latitude and longitude of a cell's centre.

        ``true_division`` keeps the drifting row index of the original formula.
        """
        row = cell / self.cols
        if not true_division:
            row = F.floor(row)
        col = F.pmod(cell, self.cols)
        lat = (row + 0.5) / self.rows * (self.lat_max - self.lat_min) + self.lat_min
        lon = (col + 0.5) / self.cols * (self.lon_max - self.lon_min) + self.lon_min
        return lat, lon


def bounding_box(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row with the extent of all positions."""
    return df.agg(
        F.min(lat).alias("lat_min"),
        F.max(lat).alias("lat_max"),
        F.min(lon).alias("lon_min"),
        F.max(lon).alias("lon_max"),
    )


def grid_spec(df: DataFrame, lat: str, lon: str, cell: int = CELL_METRES) -> DataFrame:
    """The extent plus the number of cell rows and columns, as one row."""
    box = bounding_box(df, lat, lon)
    north = haversine(F.col("lat_min"), F.col("lon_min"), F.col("lat_max"), F.col("lon_min"))
    east = haversine(F.col("lat_min"), F.col("lon_min"), F.col("lat_min"), F.col("lon_max"))
    return box.withColumn(
        "grid_rows", F.greatest(F.ceil(north / cell), F.lit(1)).cast("long")
    ).withColumn("grid_cols", F.greatest(F.ceil(east / cell), F.lit(1)).cast("long"))


def grid_of(df: DataFrame, lat: str, lon: str, cell: int = CELL_METRES) -> Grid:
    """The grid of a frame: one aggregate, whose single row becomes literals.

    Literals fold into every expression that uses the grid, in any frame, without a
    join and without running the aggregate again.
    """
    row = grid_spec(df, lat, lon, cell).first()
    return Grid(
        lat_min=F.lit(row["lat_min"]),
        lat_max=F.lit(row["lat_max"]),
        lon_min=F.lit(row["lon_min"]),
        lon_max=F.lit(row["lon_max"]),
        rows=F.lit(row["grid_rows"]).cast("long"),
        cols=F.lit(row["grid_cols"]).cast("long"),
        cell=cell,
    )
