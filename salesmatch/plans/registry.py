"""Named queries over the driver tables, each with an optional DuckDB twin.

A query is ``fn(spark, sf_dir) -> DataFrame``; its SQL twin runs on the
same parquet files (views named like the tables) and must return the same
columns and values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its oracle (None = rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from salesmatch.plans import (  # noqa: F401
        q_matching, q_tables, q_metrics, q_text, q_requests, q_quality, q_streaming, q_stored, q_needs, q_templates, q_replies, q_rules)
