"""Registry of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``key``; ``check`` is the equivalent DuckDB text."""

    def register(fn):
        assert key not in QUERIES, key
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = with_views(check)
        return fn

    return register
