"""Queries on detection."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slowlens.operators import detect as d
from slowlens.plans.catalog import query, same_rows_as
from slowlens.plans.views import view
from slowlens.session import scratch_path
from slowlens.sinks.ledger import not_in_ledger, read_ledger, upsert_entries, upsert_ledger

NOW = datetime(2024, 1, 20, 12, 0, 0)
NOW_SQL = "timestamp '2024-01-20 12:00:00'"
STATS_NOW = datetime(2000, 1, 1)
PATTERNS_SQL = r"""not regexp_matches(sql_text, '^SELECT .* FROM V\$') and not regexp_matches(sql_text, '^SELECT .* FROM GV\$')
  and not regexp_matches(sql_text, '^/\*.*tuning_auto\*/') and not regexp_matches(sql_text, 'DBMS_')"""


@query(
    "detect_slow_sql",
    "stmt_stats",
    """
select sql_id, sql_text, elapsed_time / cast(1000 as double) as elapsed_time_ms,
  cpu_time / cast(1000 as double) as cpu_time_ms, executions, buffer_gets, parse_calls, first_load_time
from stmt_stats where elapsed_time > 5000000 and executions > 10
order by elapsed_time desc, sql_id, plan_hash_value, parsing_schema_name limit 100""",
)
def detect_slow_sql(spark, sf):
    return d.detect_slow_sql(view(spark, sf, "stmt_stats"))


@query(
    "per_exec_metrics",
    "stmt_stats",
    """
select sql_id, plan_hash_value, parsing_schema_name,
  case when executions > 0 then elapsed_time / cast(1000000 as double) / executions
       else elapsed_time / cast(1000000 as double) end as elapsed_sec_per_exec,
  case when executions > 0 then cast(buffer_gets as double) / executions else cast(buffer_gets as double) end
    as buffer_gets_per_exec,
  case when executions > 0 then cast(disk_reads as double) / executions else cast(disk_reads as double) end
    as disk_reads_per_exec
from stmt_stats""",
)
def per_exec_metrics(spark, sf):
    return d.per_exec_metrics(view(spark, sf, "stmt_stats")).select(
        "sql_id",
        "plan_hash_value",
        "parsing_schema_name",
        "elapsed_sec_per_exec",
        "buffer_gets_per_exec",
        "disk_reads_per_exec",
    )


@query(
    "detect_over_thresholds",
    "detection",
    """
select sql_id, detected_at, elapsed_sec_per_exec, buffer_gets_per_exec, disk_reads_per_exec,
  concat_ws(',', case when elapsed_sec_per_exec >= 3 then 'elapsed' end,
    case when buffer_gets_per_exec >= 100000 then 'buffer_gets' end,
    case when disk_reads_per_exec >= 10000 then 'disk_reads' end) as reasons
from detection
where elapsed_sec_per_exec >= 3 or buffer_gets_per_exec >= 100000 or disk_reads_per_exec >= 10000""",
)
def detect_over_thresholds(spark, sf):
    return d.detect_over_thresholds(view(spark, sf, "detection")).select(
        "sql_id",
        "detected_at",
        "elapsed_sec_per_exec",
        "buffer_gets_per_exec",
        "disk_reads_per_exec",
        F.array_join("reasons", ",").alias("reasons"),
    )


@query(
    "exclude_statements",
    "stmt_stats",
    f"""
select sql_id, plan_hash_value, parsing_schema_name, sql_text, last_active_time from stmt_stats
where parsing_schema_name not in ('SYS', 'SYSTEM', 'DBSNMP', 'OUTLN') and {PATTERNS_SQL}
  and last_active_time >= timestamp '2000-01-01 00:00:00' - interval '1440' minute""",
)
def exclude_statements(spark, sf):
    return d.exclude_statements(view(spark, sf, "stmt_stats"), now=STATS_NOW).select(
        "sql_id", "plan_hash_value", "parsing_schema_name", "sql_text", "last_active_time"
    )


@query(
    "exclude_statements_null_user",
    "detection",
    f"""
select sql_id, parsing_schema_name, module, sql_text, detected_at from detection
where (parsing_schema_name is null or parsing_schema_name not in ('SYS', 'SYSTEM', 'DBSNMP', 'OUTLN'))
  and {PATTERNS_SQL}""",
)
def exclude_statements_null_user(spark, sf):
    return d.exclude_statements(view(spark, sf, "detection")).select(
        "sql_id", "parsing_schema_name", "module", "sql_text", "detected_at"
    )


@query(
    "dedup_recent",
    "detection ledger",
    f"""
select sql_id, plan_hash_value, detected_at from detection d
where not exists (select 1 from ledger l where l.sql_id = d.sql_id
    and coalesce(l.plan_hash_value, '0') = coalesce(cast(d.plan_hash_value as varchar), '0')
    and l.collected_at >= {NOW_SQL} - interval '24' hour)""",
)
def dedup_recent(spark, sf):
    return d.dedup_recent(view(spark, sf, "detection"), view(spark, sf, "ledger"), NOW).select(
        "sql_id", "plan_hash_value", "detected_at"
    )


@query(
    "append_ledger",
    "detection ledger",
    f"""
select sql_id, plan_hash_value, collected_at, elapsed_sec_per_exec from ledger
where collected_at >= {NOW_SQL} - interval '24' hour
union all
select sql_id, coalesce(cast(plan_hash_value as varchar), '0'), {NOW_SQL}, elapsed_sec_per_exec from detection""",
)
def append_ledger(spark, sf):
    ledger = d.append_ledger(view(spark, sf, "detection"), view(spark, sf, "ledger"), NOW)
    return ledger.withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz"))


def keyed_ledger_path(spark, sf) -> str:
    path = scratch_path(spark, "ledger")
    upsert_entries(view(spark, sf, "ledger"), path, NOW - timedelta(hours=24))
    return path


@same_rows_as("dedup_by_keyed_ledger", "dedup_recent")
def dedup_by_keyed_ledger(spark, sf):
    found = not_in_ledger(view(spark, sf, "detection"), keyed_ledger_path(spark, sf), NOW)
    return found.select("sql_id", "plan_hash_value", "detected_at")


@query(
    "keyed_ledger",
    "detection ledger",
    f"""
, entries as (
select sql_id, coalesce(plan_hash_value, '0') as plan_hash_value, collected_at, elapsed_sec_per_exec from ledger
where collected_at >= {NOW_SQL} - interval '24' hour
union all
select sql_id, coalesce(cast(plan_hash_value as varchar), '0'), {NOW_SQL}, elapsed_sec_per_exec from detection)
select sql_id, plan_hash_value, collected_at, elapsed_sec_per_exec from entries
qualify row_number() over (partition by sql_id, plan_hash_value order by collected_at desc, elapsed_sec_per_exec desc) = 1""",
)
def keyed_ledger(spark, sf):
    path = keyed_ledger_path(spark, sf)
    upsert_ledger(view(spark, sf, "detection"), path, NOW)
    return read_ledger(spark, path).withColumn("collected_at", F.col("collected_at").cast("timestamp_ntz"))


@query(
    "recent_detections",
    "ledger",
    f"""
select *, (select count(*) from ledger where collected_at >= {NOW_SQL} - interval '24' hour) as recent_count
from ledger where collected_at >= {NOW_SQL} - interval '24' hour
order by collected_at desc, sql_id, plan_hash_value limit 5""",
)
def recent_detections(spark, sf):
    return d.recent_detections(view(spark, sf, "ledger"), NOW)


@query(
    "detected_report",
    "detection",
    """
select sql_id, plan_hash_value, parsing_schema_name, module, elapsed_sec_per_exec, buffer_gets_per_exec,
  disk_reads_per_exec, executions, detected_at,
  case when elapsed_sec_per_exec > 10 then 'danger' when elapsed_sec_per_exec > 3 then 'warn' else 'none' end as band
from detection""",
)
def detected_report(spark, sf):
    return d.detected_report(view(spark, sf, "detection"))


@query(
    "detected_preview",
    "detection",
    """
select sql_id, parsing_schema_name, elapsed_sec_per_exec, buffer_gets_per_exec, disk_reads_per_exec,
  substring(coalesce(sql_text, ''), 1, 100) as sql_preview
from detection order by detected_at, sql_id limit 50""",
)
def detected_preview(spark, sf):
    return d.detected_preview(view(spark, sf, "detection"))


@query("detected_ids", "detection", "select sql_id from detection where sql_id is not null and sql_id <> ''")
def detected_ids(spark, sf):
    return d.detected_ids(view(spark, sf, "detection"))
