"""Detection of slow statements."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from slowlens.config import DEFAULTS, EXCLUDE_PATTERNS, SYSTEM_SCHEMAS, Settings
from slowlens.functions.labels import band


def detect_slow_sql(
    stmt_stats: DataFrame,
    elapsed_ms: int = DEFAULTS.elapsed_ms,
    min_exec: int = DEFAULTS.min_executions,
    limit: int = DEFAULTS.detect_limit,
) -> DataFrame:
    """Statements over both limits, slowest first.

    The limits are strict and on totals, not per execution.  Both conditions
    are plain comparisons on stored columns, so they reach the scan; the order
    and limit become one top-k step without a full sort.
    """
    slow = stmt_stats.filter((F.col("elapsed_time") > elapsed_ms * 1000) & (F.col("executions") > min_exec))
    ties = [c for c in ("sql_id", "plan_hash_value", "parsing_schema_name") if c in stmt_stats.columns]
    return (
        slow.orderBy(F.desc("elapsed_time"), *ties)
        .limit(limit)
        .select(
            "sql_id",
            "sql_text",
            (F.col("elapsed_time") / F.lit(1000.0)).alias("elapsed_time_ms"),
            (F.col("cpu_time") / F.lit(1000.0)).alias("cpu_time_ms"),
            "executions",
            "buffer_gets",
            "parse_calls",
            "first_load_time",
        )
    )


def per_exec(total: Column, executions: Column) -> Column:
    """A total per execution; the total itself when nothing was executed."""
    return F.when(executions > 0, total / executions).otherwise(total)


def per_exec_metrics(df: DataFrame) -> DataFrame:
    """Seconds, buffer gets and disk reads per execution, as doubles."""
    n = F.col("executions")
    return (
        df.withColumn("elapsed_sec_per_exec", per_exec(F.col("elapsed_time") / F.lit(1e6), n))
        .withColumn("buffer_gets_per_exec", per_exec(F.col("buffer_gets").cast("double"), n))
        .withColumn("disk_reads_per_exec", per_exec(F.col("disk_reads").cast("double"), n))
    )


def detect_over_thresholds(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows at or above any per-execution limit, with the ``reasons`` that held."""
    limits = (
        ("elapsed", "elapsed_sec_per_exec", settings.elapsed_threshold_sec),
        ("buffer_gets", "buffer_gets_per_exec", settings.buffer_gets_threshold),
        ("disk_reads", "disk_reads_per_exec", settings.disk_reads_threshold),
    )
    over = [F.col(c) >= v for _, c, v in limits]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, (name, _, _) in zip(over, limits)]))
    return df.filter(over[0] | over[1] | over[2]).withColumn("reasons", reasons)


def exclude_statements(
    df: DataFrame,
    users: Sequence[str] = SYSTEM_SCHEMAS,
    patterns: Sequence[str] = EXCLUDE_PATTERNS,
    now: datetime | None = None,
    recent_minutes: int = DEFAULTS.recent_minutes,
    time_column: str = "last_active_time",
) -> DataFrame:
    """Without the listed users, matching texts and, given ``now``, old rows.

    A row with an unknown user, text or time stays: nothing says it is to go.
    """
    keep = F.coalesce(~F.col("parsing_schema_name").isin(*users), F.lit(True))
    for p in patterns:
        keep = keep & F.coalesce(~F.col("sql_text").rlike(p), F.lit(True))
    if now is not None:
        keep = keep & F.coalesce(F.col(time_column) >= F.lit(now - timedelta(minutes=recent_minutes)), F.lit(True))
    return df.filter(keep)


def plan_key() -> Column:
    """Plan identity as text; an unknown plan is ``'0'``."""
    return F.coalesce(F.col("plan_hash_value").cast("string"), F.lit("0"))


def dedup_recent(df: DataFrame, ledger: DataFrame, now: datetime, hours: int = DEFAULTS.dedup_hours) -> DataFrame:
    """Rows whose statement and plan were not collected in the last ``hours``.

    The ledger is reduced to distinct recent keys before the anti join, so a
    statement collected very often is one row there.
    """
    cutoff = now - timedelta(hours=hours)
    recent = (
        ledger.filter(F.col("collected_at") >= F.lit(cutoff))
        .select("sql_id", plan_key().alias("_plan"))
        .distinct()
    )
    return df.withColumn("_plan", plan_key()).join(recent, ["sql_id", "_plan"], "left_anti").drop("_plan")


def append_ledger(
    df: DataFrame, ledger: DataFrame, now: datetime, hours: int = DEFAULTS.dedup_hours
) -> DataFrame:
    """The ledger with ``df`` marked as collected and old entries gone."""
    marked = df.select(
        "sql_id",
        plan_key().alias("plan_hash_value"),
        F.lit(now).alias("collected_at"),
        F.col("elapsed_sec_per_exec"),
    )
    kept = ledger.filter(F.col("collected_at") >= F.lit(now - timedelta(hours=hours)))
    return kept.unionByName(marked)


def recent_detections(
    ledger: DataFrame, now: datetime, hours: int = DEFAULTS.dedup_hours, n: int = 5
) -> DataFrame:
    """The newest ``n`` entries of the last ``hours``, each with the full count."""
    recent = ledger.filter(F.col("collected_at") >= F.lit(now - timedelta(hours=hours)))
    total = recent.agg(F.count("*"))
    newest = recent.orderBy(F.desc("collected_at"), "sql_id", "plan_hash_value").limit(n)
    return newest.withColumn("recent_count", total.scalar())


def canonical_detection(df: DataFrame) -> DataFrame:
    """Both spellings of the time and user fields under the first one."""
    spellings = {
        "elapsed_sec_per_exec": "elapsed_time_per_exec",
        "parsing_schema_name": "parsing_user",
    }
    for name, other in spellings.items():
        if name in df.columns and other in df.columns:
            df = df.withColumn(name, F.coalesce(name, other)).drop(other)
        elif other in df.columns:
            df = df.withColumnRenamed(other, name)
    return df


def detected_report(detection: DataFrame) -> DataFrame:
    """Sheet rows of detected statements; bands above 10 and above 3 seconds."""
    elapsed = F.coalesce(F.col("elapsed_sec_per_exec").cast("double"), F.lit(0.0))
    return canonical_detection(detection).select(
        "sql_id",
        "plan_hash_value",
        "parsing_schema_name",
        "module",
        F.round(elapsed.cast("decimal(28,9)"), 3).cast("double").alias("elapsed_sec_per_exec"),
        "buffer_gets_per_exec",
        "disk_reads_per_exec",
        "executions",
        "detected_at",
        band(elapsed, 10, 3).alias("band"),
    )


def detected_preview(detection: DataFrame, n: int = 50, order: Sequence[str] = ("detected_at", "sql_id")) -> DataFrame:
    """The first ``n`` detections, text cut to 100 characters."""
    found = canonical_detection(detection)
    return (
        found.orderBy(*order)
        .limit(n)
        .select(
            "sql_id",
            "parsing_schema_name",
            "elapsed_sec_per_exec",
            "buffer_gets_per_exec",
            "disk_reads_per_exec",
            F.substring(F.coalesce("sql_text", F.lit("")), 1, 100).alias("sql_preview"),
        )
    )


def detected_ids(detection: DataFrame) -> DataFrame:
    """Ids that are there, one row per detection."""
    return detection.filter(F.col("sql_id").isNotNull() & (F.col("sql_id") != "")).select("sql_id")
