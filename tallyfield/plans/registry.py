"""Registered queries, each with its SQL twin beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            SQL[key] = sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Decimals rounded to four places, exactly, then as doubles: the form in which results are compared."""
    shown = [F.round(F.col(f"`{f.name}`"), 4).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema]
    return df.select(*shown)


def d(expression: str, name: str | None = None) -> str:
    """The same form in SQL."""
    return f"CAST(round({expression}, 4) AS DOUBLE) AS {name or expression}"
