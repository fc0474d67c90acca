"""How queries are registered: name -> (spark, sf_dir) -> DataFrame, with DuckDB text beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Names given to times in results: microseconds since 1970, the same number on both engines.
_MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {})"


def settle(df: DataFrame) -> DataFrame:
    """Times as microseconds."""
    return df.select([F.expr(_MICROS.format(f"`{c}`")).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables under its name; its times are settled."""

    def wrap(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: settle(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[key] = oracle(sql)
        return f

    return wrap


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
