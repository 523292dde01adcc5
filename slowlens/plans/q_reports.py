"""Queries on the report set: all tables of a run written in one call and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from slowlens.operators.execlines import report_statements
from slowlens.operators.execrules import with_issues
from slowlens.plans import q_execreport, q_fleet, q_snapshots, render  # noqa: F401  their SQL is used
from slowlens.plans.catalog import query, same_rows_as
from slowlens.plans.q_traces import numbered
from slowlens.plans.views import view
from slowlens.session import scratch_path
from slowlens.sinks.documents import write_tkprof_docs
from slowlens.sinks.report_set import Inputs, Workload, read_report_set, write_report_set
from slowlens.sources.documents import read_tkprof_docs

DAY = date(2024, 2, 10)


def workload(spark, sf) -> Workload:
    names = ("sqlstat", "snapshot", "sqltext", "sysstat")
    return Workload(*[view(spark, sf, n) for n in names], q_snapshots.START, q_snapshots.END)


def published(spark, sf, **inputs):
    path = scratch_path(spark, "report-set")
    write_report_set(spark, Inputs(**inputs), path, DAY)
    return read_report_set(spark, path, DAY)


@same_rows_as("report_set_documents", "awr_stats_report")
def report_set_documents(spark, sf):
    return published(spark, sf, docs=render.awr_docs(spark, sf))["statistics"]


@same_rows_as("report_set_guide", "tuning_guide")
def report_set_guide(spark, sf):
    return published(spark, sf, docs=render.awr_docs(spark, sf))["tuning_guide"].drop("symptom", "advice")


@same_rows_as("report_set_waits", "exec_wait_report")
def report_set_waits(spark, sf):
    return published(spark, sf, reports=render.exec_reports(spark, sf))["waits"]


@same_rows_as("report_set_access", "access_path_report")
def report_set_access(spark, sf):
    return numbered(published(spark, sf, traces=render.traces(spark, sf))["access_paths"])


@same_rows_as("report_set_plans", "preferred_plan")
def report_set_plans(spark, sf):
    return published(spark, sf, plan_rows=view(spark, sf, "plan_rows"))["cursor_plans"].select("sql_id", "format", "line_no", "line")


@same_rows_as("report_set_instances", "instance_status")
def report_set_instances(spark, sf):
    return published(spark, sf, fleet={"instances": view(spark, sf, "instances")})["instances"]


@query(
    "report_set_totals",
    "sqlstat snapshot sqltext sysstat detection",
    q_snapshots.with_top(
        """
select (select count(*) from top_sql) as top_sql_count, (select count(*) from detection) as detected_count,
  cast(0 as bigint) as report_count, db_time_sec, sql_elapsed_sec from db_time, sql_elapsed""",
        q_snapshots.TOP_SQL,
        q_snapshots.DB_TIME,
    ),
)
def report_set_totals(spark, sf):
    return published(spark, sf, workload=workload(spark, sf), detections=view(spark, sf, "detection"))["workload_totals"]


@same_rows_as("report_set_cover", "cover_kpis")
def report_set_cover(spark, sf):
    """All inputs together; the cover is made of what was counted on the way."""
    names = ("env_metric", "env_param", "instances", "databases", "targets")
    return published(
        spark,
        sf,
        docs=render.awr_docs(spark, sf),
        detections=view(spark, sf, "detection"),
        reports=render.exec_reports(spark, sf),
        traces=render.traces(spark, sf),
        plan_rows=view(spark, sf, "plan_rows"),
        workload=workload(spark, sf),
        fleet={n: view(spark, sf, n) for n in names},
    )["cover"]


@query(
    "tkprof_docs_with_texts",
    "exec_src",
    """
select concat('run', cast(file_no as varchar)) as doc_id, concat('run', cast(file_no as varchar), '_trace.prf') as tkprof_file,
  count(*) as blocks, count(*) filter (where fetch_elapsed_cs > 0) as statements,
  cast(0 as bigint) as plan_lines, cast(0 as bigint) as stats_count, concat('select /* ', min_by(sql_id, block_no), ' */ *') as first_line
from exec_src group by file_no""",
)
def tkprof_docs_with_texts(spark, sf):
    """Documents with the text of their report: its rules tell the number of blocks."""
    path = scratch_path(spark, "tkprof")
    reports = render.exec_reports(spark, sf)
    write_tkprof_docs(with_issues(report_statements(reports)), path, reports=reports, compression="gzip")
    found = read_tkprof_docs(spark, path, glob="*.json.gz", multi_line=False).docs
    return found.select(
        F.col("sql_id").alias("doc_id"),
        "tkprof_file",
        F.size(F.split("tkprof_full_text", r"\*{80}")).cast("bigint").alias("blocks"),
        F.size("tkprof_statements").cast("bigint").alias("statements"),
        F.size("plan").cast("bigint").alias("plan_lines"),
        F.size("stats").cast("bigint").alias("stats_count"),
        F.substring_index("tkprof_full_text", "\n", 1).alias("first_line"),
    )
