"""Registry of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: dict[str, str] | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = with_views(sql, views)
        return fn

    return add


def flag(col: Column) -> Column:
    """Boolean as 0/1 BIGINT, NULL as 0."""
    return F.coalesce(col, F.lit(False)).cast("int").cast("bigint")


def quoted_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
