"""Named queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name; sql is left out where SQL can't express it."""

    def keep(f: Query) -> Query:
        known = name or f.__name__
        if known in QUERIES:
            raise ValueError(f"{known} is registered twice")
        QUERIES[known] = f
        if sql:
            SQL[known] = sql
        return f

    return keep
