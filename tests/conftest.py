"""One session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    scratch = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(scratch)).config("spark.sql.warehouse.dir", str(scratch / "warehouse")).config("spark.checkpoint.dir", str(scratch / "checkpoints")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(x):
    """A value as text, the same from Spark and DuckDB."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else f"{x:.9g}"
    return str(x)


def counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    import duckdb

    def check(query, sql: str, folder: str) -> None:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
        want = con.sql(sql)
        df = query(spark, folder)
        assert sorted(df.columns) == sorted(want.columns)
        got, expected = counted(df.columns, df.collect()), counted(want.columns, want.fetchall())
        assert sum(got.values()) == sum(expected.values())
        assert got == expected, f"only Spark: {list((got - expected).items())[:3]}; only DuckDB: {list((expected - got).items())[:3]}"

    return check
