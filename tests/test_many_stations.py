"""Reports and their grid where the stations are too many for a broadcast."""

import pytest

from cartwave.operators import stations as st
from cartwave.registry.signal import extent_of, training_of
from cartwave.sources.reports import star_reports


@pytest.fixture()
def tables(spark, tmp_path):
    supplier = [(i, i % 5) for i in range(30)]
    spark.createDataFrame(supplier, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    events = spark.range(400).selectExpr("id as event_id", "id % 7 as user_id", "timestamp_ntz '2024-01-01 00:00:00' as ts")
    events.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_no_slot_is_looked_up(spark, tables, monkeypatch):
    """Above the limit of a broadcast the positions alone, which need no station, could not be read."""
    few = sorted(map(tuple, extent_of(spark, tables).collect()))
    monkeypatch.setattr(st, "fits_broadcast", lambda *_: False)
    assert sorted(map(tuple, extent_of(spark, tables).collect())) == few
    assert star_reports(spark, tables, slots=()).count() == 400


def test_training_table_is_the_same(spark, tables, monkeypatch):
    few = training_of(spark, tables)
    expected = sorted(map(str, few.select(*sorted(few.columns)).collect()))
    monkeypatch.setattr(st, "fits_broadcast", lambda *_: False)
    many = training_of(spark, tables)
    assert sorted(map(str, many.select(*sorted(many.columns)).collect())) == expected
