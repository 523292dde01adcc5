"""Plan shape helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once per row.

    The optimizer copies the expression of an ordinary column into every filter
    and expression that uses it.  It does not do so across a generator, so a
    one-element ``inline`` keeps a costly expression from being repeated.
    """
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
