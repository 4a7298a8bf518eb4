"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, duck
from workload.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], SF) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "asset_uuid", "id", "value", "type", "tag", "timestamp"]
    assert df.count() > 0
