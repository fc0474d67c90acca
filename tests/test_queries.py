"""Every registered archive query against its DuckDB twin on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from snapweave.plans.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return tuple(sorted((k, plain(v)) for k, v in value.items())) if isinstance(value, dict) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    rows = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        columns = list(found.columns)
        assert sorted(columns) == sorted(df.columns)
        at = [columns.index(c) for c in df.columns]
        assert sorted(str(plain(tuple(r))) for r in rows) == sorted(str(plain(tuple(r[k] for k in at))) for r in found.fetchall())


def test_names_and_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 100
