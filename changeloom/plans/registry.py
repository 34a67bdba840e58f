"""Registry of named queries and the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` it is checked by tests on small fixtures."""

    def add(function: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add
