"""Every registered query with check SQL, on the smallest tables."""

import pytest

from cartwave.registry import registry
from check import compare, connect

R = registry()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in R.queries if n in R.sql])
def test_same_as_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, R.queries[name], R.sql[name]) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
