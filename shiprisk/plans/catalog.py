"""Registry of named queries and their independent DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``; the oracle (when the
operator is SQL-expressible) is ANSI SQL over the driver's raw tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_fixtures import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, fixtures: list[str] | None = None, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is the oracle body using ``fixtures``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fixtures(fixtures or [], sql) if fixtures else sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (enrichment, expressions_q, geo_q, ml_q, monitoring_q,  # noqa: F401
                   reports_q, sources_q, streaming_q, weather_q)
