"""Every registered query runs; those with SQL give DuckDB's rows."""

import pytest
from oracle import compare

from sparkloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, name):
    compare(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["a", "b", "shared", "united"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
