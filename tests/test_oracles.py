"""Every registered query against its DuckDB equivalent."""

import pytest

from stavework.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_duckdb(name, same_as_duckdb):
    same_as_duckdb(registry.QUERIES[name], registry.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "pitches" in df.columns


def test_every_query_is_registered():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
