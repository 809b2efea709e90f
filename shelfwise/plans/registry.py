"""Registry of named queries and their oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` that reads whole driver
tables (through the stand-in views) and applies one or more operators.  Its
oracle, when SQL can express it, is an independent DuckDB query over the same
parquet tables; every computed column carries the same alias in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that its queries register themselves."""
    from shelfwise.plans import (  # noqa: F401
        q_catalog,
        q_search,
        q_accounts,
        q_reports,
        q_changes,
        q_streams,
    )
