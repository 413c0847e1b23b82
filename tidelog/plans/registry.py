"""Registered queries: a name, a function of (spark, directory), and SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. `sql` is its counterpart for a plain SQL engine."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return function(prepare(spark), directory)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register
