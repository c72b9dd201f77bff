"""Registry of named queries: Spark callable + optional DuckDB oracle text.

Names follow the survey inventory: lower-case ID plus a slug
(``q_g_network_queue``).  Every query reads the driver tables of ``sf_dir``
through ``kiloqueue.sources.adapter`` and returns a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kiloqueue.plans.oracle_base import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: str = ""):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, ctes)
        return fn

    return deco
