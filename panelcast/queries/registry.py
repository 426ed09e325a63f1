"""Queries register themselves here with their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def r8(c: Column | str) -> Column:
    """Rounded to 8 places, minus zero as zero, for comparison across engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 8) + F.lit(0.0)
