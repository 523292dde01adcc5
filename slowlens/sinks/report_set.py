"""All report tables of a run in one call.

Texts and documents are parsed once: statements, trace facts and documents are
written to the shared folder, and every table is made from those.  Counts that
the cover and the totals show are observed while the tables are written, so no
table is read or made a second time to count it.

A run writes its tables to a folder of its own and then, as the last step, one
manifest for its date.  Readers go by the manifest: they see the tables of a
finished run or of the one before, never a part.  A run that is repeated, after
a failure or on purpose, takes a new folder and replaces the manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from slowlens.config import DEFAULTS, Settings
from slowlens.functions.text import plan_text
from slowlens.operators import detect, execreport as e, fleet, optreports as v, optrules, opttrace as o, planrules, snapshots as s
from slowlens.operators.execlines import report_statements
from slowlens.operators.execrules import with_issues
from slowlens.session import scratch_path
from slowlens.sinks.documents import materialize
from slowlens.sources.texts import TextSet, text_files

#: Kinds of facts that tables of traces are made from.
TRACE_KINDS = (*optrules.FACT_KINDS, "db", "join", "parameter")

MANIFEST = "run_date date, report string, folder string, row_count bigint"


@dataclass(frozen=True)
class Workload:
    """Counter tables and the window of the top statements."""

    sqlstat: DataFrame
    snapshot: DataFrame
    sqltext: DataFrame
    sysstat: DataFrame
    start: datetime
    end: datetime


@dataclass(frozen=True)
class Inputs:
    """What a run reports on; what is not given has no tables.

    ``fleet`` names ``env_metric``, ``env_param``, ``instances``, ``databases`` and ``targets``.
    """

    docs: DataFrame | None = None
    detections: DataFrame | None = None
    reports: TextSet | None = None
    traces: TextSet | None = None
    plan_rows: DataFrame | None = None
    workload: Workload | None = None
    fleet: Mapping[str, DataFrame] = field(default_factory=dict)


#: What was counted while a table was written, by table.
Counts = dict[str, dict[str, object]]


@dataclass(frozen=True)
class Table:
    """A table, or how it follows from the counts of those before it, and what
    is counted while it is written: ``counts`` on its rows, ``seen`` inside its plan."""

    rows: DataFrame | Callable[[Counts], DataFrame]
    counts: Mapping[str, Column] = field(default_factory=dict)
    seen: Observation | None = None


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_tables(docs: DataFrame) -> dict[str, Table]:
    """Summary, plans, statistics and tuning guide of statistics documents."""
    docs = _written(docs, "documents")
    slow = F.count_if(F.coalesce(F.col("avg_elapsed_sec"), F.lit(0.0)) > 5)
    return {
        "summary": Table(s.awr_summary(docs)),
        "plans": Table(docs.select("sql_id", "plan_hash_value", plan_text(F.col("plan")).alias("plan"))),
        "statistics": Table(s.awr_stats_report(docs), {"high_elapsed": slow}),
        "tuning_guide": Table(planrules.tuning_guide(docs)),
    }


def report_tables(reports: TextSet, settings: Settings = DEFAULTS) -> dict[str, Table]:
    """Texts, phases, waits, binds and issues of execution reports."""
    statements = _written(with_issues(report_statements(reports, settings), settings), "statements")
    key = ["file", "block_no", "sql_id"]
    issues = statements.select(*key, F.posexplode("issues").alias("issue_no", "i"))
    return {
        "report_texts": Table(e.exec_text_report(reports, settings)),
        "phases": Table(e.exec_phase_report(statements)),
        "waits": Table(e.exec_wait_report(e.exec_waits(statements))),
        "binds": Table(e.exec_bind_report(e.exec_binds(statements))),
        "report_issues": Table(issues.select(*key, (F.col("issue_no") + 1).cast("bigint").alias("issue_no"), "i.*")),
        "report_totals": Table(e.exec_report_totals(statements)),
        "report_files": Table(text_files(reports)),
    }


def trace_tables(traces: TextSet, settings: Settings = DEFAULTS) -> dict[str, Table]:
    """Summary, access paths, statistics, issues and parameters of optimizer traces."""
    spark = traces.texts.sparkSession
    facts = materialize(o.trace_facts(traces, settings, TRACE_KINDS), spark, "facts", "kind")
    statements = _written(o.trace_sql(traces), "trace-statements")
    best, blocks = _written(o.best_access(facts), "best-access"), o.access_blocks(facts)
    issues = _written(optrules.trace_issues(facts), "trace-issues")
    db_info, params = o.trace_db_info(facts), o.trace_params(facts)
    system = o.trace_system_stats(facts)
    return {
        "trace_summary": Table(
            v.trace_summary(text_files(traces), statements, o.trace_table_stats(facts), blocks, best, o.best_join(facts), issues, db_info)
        ),
        "access_paths": Table(v.access_path_report(o.access_methods(facts, settings), best, o.scan_costs(facts))),
        "table_statistics": Table(v.table_size_report(o.trace_table_stats(facts))),
        "index_statistics": Table(v.index_quality_report(o.trace_index_stats(facts))),
        "column_statistics": Table(v.column_stats_report(o.trace_column_stats(facts))),
        "system_statistics": Table(v.system_stats_report(system)),
        "trace_issues": Table(optrules.trace_issue_report(issues, statements)),
        "parameters": Table(v.key_params_report(params)),
        "other_parameters": Table(v.other_params_count(params)),
        "trace_environment": Table(fleet.environment_from_trace(db_info)),
        "trace_system_environment": Table(v.system_stats_environment(system)),
    }


def fleet_tables(given: Mapping[str, DataFrame]) -> dict[str, Table]:
    """Memory, hosts, parameters, instances and services of the databases."""
    makers = {
        "memory": (fleet.memory_report, ("env_metric",)),
        "hosts": (fleet.os_report, ("env_metric",)),
        "instance_parameters": (fleet.param_report, ("env_param",)),
        "instances": (fleet.instance_status, ("instances",)),
        "services": (fleet.service_match, ("targets", "instances", "databases")),
    }
    return {
        name: Table(make(*[given[n] for n in needs])) for name, (make, needs) in makers.items() if all(n in given for n in needs)
    }


def workload_tables(work: Workload, settings: Settings = DEFAULTS) -> dict[str, Table]:
    """Top statements, and the totals; elapsed time is summed in the scan that finds the top."""
    seen = Observation("window")
    top = s.top_sql(work.sqlstat, work.snapshot, work.sqltext, work.start, work.end, settings.top_n, observation=seen)

    def totals(counts: Counts) -> DataFrame:
        time = s.db_time(work.sysstat, work.snapshot, work.start, work.end)
        return time.select(
            F.lit(counts["top_sql"]["rows"]).cast("bigint").alias("top_sql_count"),
            F.lit(counts.get("detected", {}).get("rows", 0)).cast("bigint").alias("detected_count"),
            F.lit(counts.get("report_files", {}).get("rows", 0)).cast("bigint").alias("report_count"),
            "db_time_sec",
            s.elapsed_seconds(F.lit(counts["top_sql"]["elapsed"])).alias("sql_elapsed_sec"),
        )

    return {"top_sql": Table(s.top_sql_report(top), seen=seen), "workload_totals": Table(totals)}


def cover(spark: SparkSession, counts: Counts) -> DataFrame:
    """Six counts of the run; the last two raise an alert when not 0."""

    def of(table: str, name: str = "rows") -> int:
        return counts.get(table, {}).get(name) or 0

    items = (
        ("awr_sql", of("summary"), None),
        ("detected_sql", of("detected"), None),
        ("tkprof_docs", of("report_files"), None),
        ("trace_docs", of("trace_summary"), None),
        ("high_elapsed", of("statistics", "high_elapsed"), "danger"),
        ("trace_issues", of("trace_issues"), "warn"),
    )
    rows = [(i, item, n, alert if alert and n else "none") for i, (item, n, alert) in enumerate(items, 1)]
    return spark.createDataFrame(rows, "item_no bigint, item string, count bigint, alert string")


def all_tables(inputs: Inputs, settings: Settings = DEFAULTS) -> dict[str, Table]:
    """Every table that the inputs allow, in the order in which they are written."""
    out: dict[str, Table] = {}
    if inputs.docs is not None:
        out |= document_tables(inputs.docs)
    if inputs.detections is not None:
        out["detected"] = Table(detect.detected_report(inputs.detections))
    if inputs.plan_rows is not None:
        out["cursor_plans"] = Table(s.preferred_plan(inputs.plan_rows))
    if inputs.reports is not None:
        out |= report_tables(inputs.reports, settings)
    if inputs.traces is not None:
        out |= trace_tables(inputs.traces, settings)
    out |= fleet_tables(inputs.fleet)
    if inputs.workload is not None:
        out |= workload_tables(inputs.workload, settings)
    return out


def write_report_set(
    spark: SparkSession, inputs: Inputs, path: str, run_date: date, settings: Settings = DEFAULTS
) -> dict[str, int]:
    """Write all tables of a run and publish them together; the number of rows of each."""
    root = path.rstrip("/")
    folder = f"{root}/runs/{run_date:%Y-%m-%d}-{uuid.uuid4().hex}"
    counts: Counts = {}

    def write(name: str, table: Table) -> None:
        rows = table.rows(counts) if callable(table.rows) else table.rows
        counted = Observation(name)
        observed = rows.observe(counted, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in table.counts.items()])
        observed.write.mode("errorifexists").parquet(f"{folder}/{name}")
        counts[name] = counted.get | (table.seen.get if table.seen else {})

    for name, table in all_tables(inputs, settings).items():
        write(name, table)
    write("cover", Table(cover(spark, counts)))
    entries = [(run_date, name, f"{folder}/{name}", found["rows"]) for name, found in counts.items()]
    (
        spark.createDataFrame(entries, MANIFEST)
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(f"{root}/manifest")
    )
    return {name: found["rows"] for name, found in counts.items()}


def read_report_set(spark: SparkSession, path: str, run_date: date) -> dict[str, DataFrame]:
    """The tables published for a date, by name."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    entries = manifest.filter(F.col("run_date") == F.lit(run_date)).collect()  # a row per table
    return {r.report: spark.read.parquet(r.folder) for r in entries}
