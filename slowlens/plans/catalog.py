"""Registered queries: each operator over the driver's tables, next to the SQL
that computes the same rows from the source columns.

``query`` registers a callable ``(spark, sf_dir) -> DataFrame`` and, when given,
the views and statement for the other engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slowlens.plans.views import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(views, sql)
        return fn

    return register


def same_rows_as(name: str, other: str):
    """Register under the SQL of another query, which must be registered before."""

    def register(fn):
        query(name)(fn)
        ORACLES[name] = ORACLES[other]
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from slowlens.plans import (  # noqa: F401
        q_detect,
        q_execreport,
        q_fleet,
        q_reports,
        q_snapshots,
        q_sources,
        q_streaming,
        q_text,
        q_traces,
    )
