"""Names, queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def r(c: str | Column, digits: int = 8) -> Column:
    """Rounded for comparison; adding zero removes negative zeros."""
    col = F.col(c) if isinstance(c, str) else c
    rounded = F.round(col, digits) + F.lit(0.0)
    return rounded.alias(c) if isinstance(c, str) else rounded


def rs(columns, digits: int = 8) -> list[Column]:
    return [r(c, digits) for c in columns]


def sql_round(columns, digits: int = 8) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def wall_clock(c: str = "ts") -> Column:
    """UTC wall-clock time, the type the given tables use."""
    return F.col(c).cast("timestamp_ntz").alias(c)
