"""Measurement reports and base stations: explicit schemas and a star-schema view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cartwave.functions.geo import haversine
from cartwave.session import spread_out
from cartwave.sources.trade import star_table

SLOTS = 7

# fixed values: report columns, slot columns carry the suffixes _1 .. _7
REPORT_COLUMNS = ("IMSI", "MRTime", "Longitude", "Latitude", "Num_connected")
SLOT_COLUMNS = ("RNCID", "CellID", "AsuLevel", "SignalLevel", "RSSI")
STATION_COLUMNS = ("RNCID", "CellID", "Longitude", "Latitude")

_WHOLE = ("RNCID", "CellID", "Num_connected")
_TEXT = ("IMSI", "MRTime")


def typed_schema(columns: Sequence[str]) -> T.StructType:
    """Schema for a header; unknown columns are read as text."""
    fields = []
    for name in columns:
        stem = name.rsplit("_", 1)[0] if name.rsplit("_", 1)[-1].isdigit() else name
        if stem in _WHOLE:
            kind = T.LongType()
        elif stem in _TEXT or stem not in REPORT_COLUMNS + SLOT_COLUMNS + STATION_COLUMNS:
            kind = T.StringType()
        else:
            kind = T.DoubleType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


def report_header() -> list[str]:
    return [*REPORT_COLUMNS, *[f"{c}_{i}" for i in range(1, SLOTS + 1) for c in SLOT_COLUMNS]]


def read_reports_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None
) -> DataFrame:
    return spark.read.schema(typed_schema(columns or report_header())).csv(path, header=True)


def read_stations_csv(
    spark: SparkSession, path: str, columns: Sequence[str] = STATION_COLUMNS
) -> DataFrame:
    return spark.read.schema(typed_schema(columns)).csv(path, header=True)


def star_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations as a view over the supplier table."""
    return star_table(spark, sf_dir, "supplier").selectExpr(
        "cast(s_nationkey as bigint) as RNCID",
        "s_suppkey as CellID",
        "121.2013D + ((s_suppkey * 7919) % 1000) * 1.69e-5D as Longitude",
        "31.2818D + ((s_suppkey * 104729) % 1000) * 1.15e-5D as Latitude",
    )


def star_reports(
    spark: SparkSession, sf_dir: str, slots: Sequence[int] = range(1, SLOTS + 1)
) -> DataFrame:
    """Reports as a view over the events; ``row_id`` identifies a record.

    ``slots`` limits the stations whose area code and signal are worked out.

    Slot keys and positions follow from the event id by integer arithmetic, so no
    join is needed to place a record; only the station's area code is looked up.
    """
    from cartwave.operators.stations import slot_lookup

    stations = star_stations(spark, sf_dir)
    count = stations.agg(F.count(F.lit(1)).alias("n")).scalar()
    events = star_table(spark, sf_dir, "events")
    events = spread_out(events, "event_id").withColumn("_n", count)
    cells = []
    for i in range(1, SLOTS + 1):
        cell = f"(event_id * 31 + {(i - 1) * 17}) % _n"
        if i > 1:
            cell = f"case when event_id % {i + 5} = 0 then null else {cell} end"
        cells.append(f"{cell} as CellID_{i}")
    keyed = events.selectExpr(
        "event_id as row_id",
        "cast(user_id as string) as IMSI",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as MRTime",
        *cells,
    )
    placed = keyed.selectExpr(
        "*",
        "31.2818D + ((CellID_1 * 104729) % 1000) * 1.15e-5D "
        "+ (((row_id * 37) % 201) - 100) * 2e-6D as Latitude",
        "121.2013D + ((CellID_1 * 7919) % 1000) * 1.69e-5D "
        "+ (((row_id * 53) % 201) - 100) * 2e-6D as Longitude",
        "cast("
        + " + ".join(f"int(CellID_{i} is not null)" for i in range(1, SLOTS + 1))
        + " as bigint) as Num_connected",
    )
    known = slot_lookup(
        placed,
        stations.select("RNCID", "CellID"),
        ["CellID"],
        ["RNCID"],
        slots,
        row_id="row_id",
    )
    signal = {}
    for i in slots:
        away = haversine(
            F.col("Latitude"),
            F.col("Longitude"),
            F.expr(f"31.2818D + ((CellID_{i} * 104729) % 1000) * 1.15e-5D"),
            F.expr(f"121.2013D + ((CellID_{i} * 7919) % 1000) * 1.69e-5D"),
        )
        signal[f"RSSI_{i}"] = (F.lit(-50) - F.floor(away / 20)).cast("double")
    levels = {}
    for i in slots:
        levels[f"AsuLevel_{i}"] = (F.col(f"RSSI_{i}") + 113) / 2
        levels[f"SignalLevel_{i}"] = F.when(
            F.col(f"CellID_{i}").isNotNull(), ((F.col("row_id") + i) % 5).cast("double")
        )
    return known.withColumns(signal).withColumns(levels) if signal else known
