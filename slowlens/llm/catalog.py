"""Registered text queries ``(spark, sf_dir) -> DataFrame`` and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import every module that registers queries."""
    from slowlens.llm import (  # noqa: F401
        contamination,
        language,
        licenses,
        lines,
        mixing,
        near_vectors,
        ngram_join,
        pages,
        paragraphs,
        quality,
        ranked_search,
        shards,
        whitening,
    )
