"""Registry of named queries with, where SQL can say it, an equal SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stacklens.plans.bindings import with_views
from stacklens.plans.context import Context
from stacklens.plans.oracle_views import OV

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Context], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Context(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_views(sql, OV)
        return fn
    return register
