"""Running values over ordered lines, safe for one very large file.

A window partitioned by file alone puts a whole file into one task.  Here a
file is cut into slices of ``slice_lines`` lines; the window runs inside a
slice, and a tiny table with one row per slice carries the state from one
slice to the next.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, key: str, order: list[str], value: Column, out: str, slice_lines: int) -> DataFrame:
    """Inclusive running sum of ``value`` per ``key`` in the given order.

    ``order[0]`` must be a line number; it decides the slice.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order[0]) / slice_lines)).withColumn("_v", value)
    totals = sliced.groupBy(key, "_slice").agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key, "_slice", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_c"))
    inside = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(carry, [key, "_slice"])
        .withColumn(out, F.col("_c") + F.sum("_v").over(inside))
        .drop("_v", "_c", "_slice")
    )


def running_state(
    df: DataFrame,
    key: str,
    order: str,
    lasts: Mapping[str, Column],
    firsts: Mapping[str, Column],
    slice_lines: int,
) -> DataFrame:
    """For each line the last (first) non-null state at or before it, per key.

    Rows of one line share a state; at most one of them may set it.
    """
    names = [*lasts, *firsts]
    sliced = df.withColumn("_slice", F.floor(F.col(order) / slice_lines))
    for name, expr in {**lasts, **firsts}.items():
        sliced = sliced.withColumn(f"_s_{name}", expr)

    def when_set(name):
        return F.when(F.col(f"_s_{name}").isNotNull(), F.col(order))

    ends = sliced.groupBy(key, "_slice").agg(
        *[F.max_by(f"_s_{n}", when_set(n)).alias(f"_t_{n}") for n in lasts],
        *[F.min_by(f"_s_{n}", when_set(n)).alias(f"_t_{n}") for n in firsts],
    )
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        key,
        "_slice",
        *[F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in lasts],
        *[F.first(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in firsts],
    )
    inside = Window.partitionBy(key, "_slice").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = sliced.join(carry, [key, "_slice"])
    for n in lasts:
        out = out.withColumn(n, F.coalesce(F.last(f"_s_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")))
    for n in firsts:
        out = out.withColumn(n, F.coalesce(F.col(f"_c_{n}"), F.first(f"_s_{n}", ignorenulls=True).over(inside)))
    return out.drop("_slice", *[f"_s_{n}" for n in names], *[f"_c_{n}" for n in names])
