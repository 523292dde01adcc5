"""Queries on snapshot workload and statistics documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from slowlens.operators import planrules, snapshots as s
from slowlens.operators.detect import detected_ids
from slowlens.operators.optrules import FACT_KINDS, trace_issues
from slowlens.operators.opttrace import trace_facts, trace_sql
from slowlens.plans import render
from slowlens.plans.catalog import query
from slowlens.plans.q_execreport import statements
from slowlens.plans.views import view
from slowlens.sinks.documents import materialize, tkprof_docs

START, END = datetime(1996, 1, 1), datetime(2000, 12, 31, 23, 59, 59)
WINDOW_SQL = (
    "begin_interval_time >= timestamp '1996-01-01 00:00:00' and end_interval_time <= timestamp '2000-12-31 23:59:59'"
)
MICRO = "cast(1000000 as double)"
HUNDREDTHS = "cast(({0} + 5000) // 10000 as double) / cast(100 as double)"

TOP_SQL = f"""
top_sql as (
select ss.sql_id, ss.plan_hash_value, substring(st.sql_text, 1, 4000) as sql_text, ss.parsing_schema_name,
  cast(sum(executions_delta) as bigint) as executions,
  {HUNDREDTHS.format('sum(elapsed_time_delta)')} as elapsed_sec,
  cast(case when sum(executions_delta) > 0
    then (2 * sum(elapsed_time_delta) + 1000 * sum(executions_delta)) // (2000 * sum(executions_delta))
    else (sum(elapsed_time_delta) + 500) // 1000 end as double) / cast(1000 as double) as elapsed_per_exec,
  cast(sum(buffer_gets_delta) as bigint) as buffer_gets,
  cast(case when sum(executions_delta) > 0
    then (2 * sum(buffer_gets_delta) + sum(executions_delta)) // (2 * sum(executions_delta))
    else sum(buffer_gets_delta) end as bigint) as buffer_gets_per_exec,
  cast(sum(disk_reads_delta) as bigint) as disk_reads,
  {HUNDREDTHS.format('sum(cpu_time_delta)')} as cpu_sec,
  cast(sum(rows_processed_delta) as bigint) as rows_processed,
  cast(sum(iowait_delta) as double) / {MICRO} as io_wait_sec,
  sha256(substring(st.sql_text, 1, 4000)) as digest
from sqlstat ss join snapshot sn using (dbid, instance_number, snap_id)
  left join sqltext st on st.sql_id = ss.sql_id and st.dbid = ss.dbid
where {WINDOW_SQL} and ss.parsing_schema_name not in ('SYS', 'SYSTEM', 'DBSNMP', 'OUTLN')
group by ss.sql_id, ss.plan_hash_value, substring(st.sql_text, 1, 4000), ss.parsing_schema_name
order by elapsed_sec desc, ss.sql_id, ss.plan_hash_value, ss.parsing_schema_name, digest limit 20)"""
DB_TIME = f"""
db_time as (
select coalesce({HUNDREDTHS.format('sum(e.value - b.value)')}, 0) as db_time_sec
from sysstat b join sysstat e on e.stat_name = b.stat_name and e.dbid = b.dbid
    and e.instance_number = b.instance_number and e.snap_id = b.snap_id + 1
  join snapshot sb on sb.dbid = b.dbid and sb.instance_number = b.instance_number and sb.snap_id = b.snap_id
  join snapshot se on se.dbid = e.dbid and se.instance_number = e.instance_number and se.snap_id = e.snap_id
where b.stat_name = 'DB time' and sb.begin_interval_time >= timestamp '1996-01-01 00:00:00'
  and se.end_interval_time <= timestamp '2000-12-31 23:59:59'),
sql_elapsed as (
select coalesce({HUNDREDTHS.format('sum(elapsed_time_delta)')}, 0) as sql_elapsed_sec
from sqlstat join snapshot using (dbid, instance_number, snap_id) where {WINDOW_SQL})"""


def with_top(select: str, *ctes: str) -> str:
    return "," + ",".join(c.strip() for c in ctes) + "\n" + select


def top_frame(spark, sf):
    return s.top_sql(view(spark, sf, "sqlstat"), view(spark, sf, "snapshot"), view(spark, sf, "sqltext"), START, END)


def summary_frame(spark, sf):
    return s.db_summary(
        view(spark, sf, "sysstat"), view(spark, sf, "sqlstat"), view(spark, sf, "snapshot"), START, END
    )


@query("top_sql", "sqlstat snapshot sqltext", with_top("select * exclude (digest) from top_sql", TOP_SQL))
def top_sql(spark, sf):
    return top_frame(spark, sf)


@query("db_time", "sqlstat snapshot sysstat", with_top("select * from db_time", DB_TIME))
def db_time(spark, sf):
    return s.db_time(view(spark, sf, "sysstat"), view(spark, sf, "snapshot"), START, END)


@query("sql_elapsed", "sqlstat snapshot sysstat", with_top("select * from sql_elapsed", DB_TIME))
def sql_elapsed(spark, sf):
    return s.sql_elapsed(view(spark, sf, "sqlstat"), view(spark, sf, "snapshot"), START, END)


def _report_window(kind, lower, upper):
    @query(
        f"report_window_{kind}",
        "sqlstat snapshot",
        f"""
select sql_id, cast(sum(executions_delta) as bigint) as executions, count(*) as samples
from sqlstat join snapshot using (dbid, instance_number, snap_id)
where begin_interval_time >= timestamp '{lower}' and end_interval_time <= timestamp '{upper}' group by sql_id""",
    )
    def run(spark, sf):
        start, end = s.report_window(kind, datetime(1998, 6, 15))
        return (
            s.in_window(view(spark, sf, "sqlstat"), view(spark, sf, "snapshot"), start, end)
            .groupBy("sql_id")
            .agg(F.sum("executions_delta").alias("executions"), F.count("*").alias("samples"))
        )


_report_window("weekly", "1998-06-08 00:00:00", "1998-06-15 00:00:00")
_report_window("daily", "1998-06-15 00:00:00", "1998-06-15 23:59:59")


@query(
    "top_sql_report",
    "sqlstat snapshot sqltext",
    with_top(
        """
select row_number() over (order by elapsed_sec desc, sql_id, plan_hash_value, parsing_schema_name, digest) as rank,
  row_number() over (order by elapsed_sec desc, sql_id, plan_hash_value, parsing_schema_name, digest) <= 3 as is_top3,
  sql_id, parsing_schema_name, elapsed_sec, elapsed_per_exec,
  case when elapsed_per_exec >= 10 then 'SLOW' when elapsed_per_exec >= 5 then 'WARN' else '' end as severity,
  executions, buffer_gets, buffer_gets_per_exec, disk_reads, cpu_sec,
  substring(coalesce(sql_text, ''), 1, 120) as sql_preview from top_sql""",
        TOP_SQL,
    ),
)
def top_sql_report(spark, sf):
    return s.top_sql_report(top_frame(spark, sf))


@query(
    "workload_kpis",
    "sqlstat snapshot sqltext sysstat detection file_list",
    with_top(
        """
select (select count(*) from top_sql) as top_sql_count, (select count(*) from detection) as detected_count,
  (select count(*) from file_list) as report_count, db_time_sec, sql_elapsed_sec from db_time, sql_elapsed""",
        TOP_SQL,
        DB_TIME,
    ),
)
def workload_kpis(spark, sf):
    return s.workload_kpis(
        top_frame(spark, sf), view(spark, sf, "detection"), view(spark, sf, "file_list"), summary_frame(spark, sf)
    )


# --- statistics documents ---------------------------------------------------


@query(
    "awr_stats_report",
    "awr_stat_src awr_plan_src",
    """
select sql_id, lpad(cast(snap_id as varchar), 6, '0') as snap_time, '1' as plan_hash_value, executions_delta,
  avg_elapsed_sec, avg_cpu_sec, cast(avg_buffer_gets as varchar) as avg_buffer_gets,
  cast(avg_disk_reads as varchar) as avg_disk_reads, cast(avg_rows as varchar) as avg_rows,
  case when avg_elapsed_sec > 5 then 'danger' when avg_elapsed_sec > 1 then 'warn' else 'none' end as band
from awr_stat_src""",
)
def awr_stats_report(spark, sf):
    return s.awr_stats_report(render.awr_docs(spark, sf))


FIRST = """
first_stat as (select * from (select *, row_number() over (partition by sql_id order by snap_id desc) as rn,
  count(*) over (partition by sql_id) as n from awr_stat_src) where rn = 1)"""
PLAN_LINES = """3 + has_full_scan::int + has_ffs::int + has_partition_all::int + has_sort::int + has_hash_join::int
  + 2 * has_nl::int"""


@query(
    "awr_summary",
    "awr_stat_src awr_plan_src",
    with_top(
        f"""
select p.sql_id, concat('select /* ', name, ' */ 1 from dual') as sql_preview, '1' as plan_hash_value,
  cast({PLAN_LINES} as bigint) as plan_lines, coalesce(n, 0) as stats_count, avg_elapsed_sec,
  cast(avg_buffer_gets as varchar) as avg_buffer_gets, 'awr' as source
from awr_plan_src p left join first_stat f on f.sql_id = p.sql_id""",
        FIRST,
    ),
)
def awr_summary(spark, sf):
    return s.awr_summary(render.awr_docs(spark, sf))


@query(
    "high_elapsed_count",
    "awr_stat_src awr_plan_src",
    "select count(*) as high_elapsed from awr_stat_src where avg_elapsed_sec > 5",
)
def high_elapsed_count(spark, sf):
    return s.high_elapsed_count(render.awr_docs(spark, sf))


POINTS = """
figures as (select p.*, coalesce(avg_elapsed_sec, 0) as el, coalesce(cast(avg_buffer_gets as double), 0) as bg,
  coalesce(cast(avg_disk_reads as double), 0) as dr, coalesce(cast(avg_rows as double), 0) as ro
  from awr_plan_src p left join first_stat f on f.sql_id = p.sql_id),
found as (
select sql_id, 1 as rule_no, case when el > 10 then 'HIGH' else 'MEDIUM' end as severity, 'elapsed' as type, el as measure
  from figures where el > 3
union all select sql_id, 2, case when bg > 1000000 then 'HIGH' else 'MEDIUM' end, 'buffer_gets', bg from figures where bg > 100000
union all select sql_id, 3, 'HIGH', 'physical_reads', dr from figures where dr > 10000
union all select sql_id, 4, 'MEDIUM', 'gets_per_row', bg / greatest(ro, 1.0::double) from figures
  where ro > 0 and bg > 0 and bg / greatest(ro, 1.0::double) > 100
union all select sql_id, 5, 'MEDIUM', 'index_fast_full_scan', null from figures where has_ffs
union all select sql_id, 6, 'HIGH', 'full_table_scan', null from figures where has_full_scan
union all select sql_id, 7, 'MEDIUM', 'no_partition_pruning', null from figures where has_partition_all
union all select sql_id, 8, 'MEDIUM', 'large_nested_loop', nl_rows_k * 1000.0::double from figures
  where has_nl and nl_rows_k > 100
union all select sql_id, 9, 'LOW', 'sort', null from figures where has_sort
union all select sql_id, 10, 'LOW', 'hash_join', null from figures where has_hash_join),
points as (
select * from found
union all select sql_id, 11, 'GOOD', 'nothing_found', null from figures where sql_id not in (select sql_id from found))"""
LABEL = "case severity when 'HIGH' then '🔴 HIGH' when 'MEDIUM' then '🟡 MEDIUM' else concat('🟢 ', severity) end"


@query(
    "tuning_guide",
    "awr_stat_src awr_plan_src",
    with_top(
        f"""
select sql_id, row_number() over (partition by sql_id order by rule_no) as point_no, cast(rule_no as bigint) as rule_no,
  severity, type, measure, {LABEL} as severity_label from points""",
        FIRST,
        POINTS,
    ),
)
def tuning_guide(spark, sf):
    return planrules.tuning_guide(render.awr_docs(spark, sf)).drop("symptom", "advice")


def _tuning_rule(kind):
    @query(
        f"tuning_rule_{kind}",
        "awr_stat_src awr_plan_src",
        with_top(f"select sql_id, severity, measure from points where type = '{kind}'", FIRST, POINTS),
    )
    def run(spark, sf):
        guide = planrules.tuning_guide(render.awr_docs(spark, sf))
        return guide.filter(F.col("type") == kind).select("sql_id", "severity", "measure")


for _kind in planrules.GUIDE:
    _tuning_rule(_kind)


# --- ids ----------------------------------------------------------------------

INELIGIBLE = """
ineligible as (select username from accounts
  where account_status like '%LOCKED%' or username in ('SYS', 'SYSTEM', 'DBSNMP', 'OUTLN', 'AUDSYS'))"""


@query(
    "top_statement_ids",
    "stmt_stats accounts",
    with_top(
        """
select sql_id, max(elapsed_time) as elapsed_time from stmt_stats
where parsing_schema_name not in (select username from ineligible) and elapsed_time > 0
group by sql_id order by 2 desc, 1 limit 20""",
        INELIGIBLE,
    ),
)
def top_statement_ids(spark, sf):
    return s.top_statement_ids(view(spark, sf, "stmt_stats"), view(spark, sf, "accounts"))


@query(
    "eligible_ids",
    "stmt_stats accounts sqltext",
    with_top(
        """
select distinct sql_id from sqltext where sql_id in (select sql_id from stmt_stats
  where parsing_schema_name not in (select username from ineligible))""",
        INELIGIBLE,
    ),
)
def eligible_ids(spark, sf):
    return s.eligible_ids(view(spark, sf, "sqltext"), view(spark, sf, "stmt_stats"), view(spark, sf, "accounts"))


@query(
    "sql_text_for",
    "stmt_stats sqltext detection",
    """
select i.sql_id, min(s.sql_text) as sql_text, min(s.sql_text) is not null as found
from (select sql_id from sqltext union select sql_id from detection) i left join stmt_stats s on s.sql_id = i.sql_id
group by i.sql_id""",
)
def sql_text_for(spark, sf):
    ids = view(spark, sf, "sqltext").select("sql_id").union(detected_ids(view(spark, sf, "detection")))
    return s.sql_text_for(ids, view(spark, sf, "stmt_stats"))


@query(
    "preferred_plan",
    "plan_rows awr_plan_src",
    """
select r.* from plan_rows r join awr_plan_src p on p.sql_id = r.sql_id
where (not has_full_scan and format = 'ALLSTATS LAST') or (has_full_scan and not has_ffs and format = 'TYPICAL')""",
)
def preferred_plan(spark, sf):
    return s.preferred_plan(view(spark, sf, "plan_rows")).select("sql_id", "format", "line_no", "line")


@query(
    "target_ids",
    "awr_plan_src trace_src",
    "select sql_id from awr_plan_src union select sql_id from trace_src",
)
def target_ids(spark, sf):
    return s.target_ids(render.awr_docs(spark, sf), trace_sql(render.traces(spark, sf)))


@query(
    "run_summary",
    "file_list",
    "select count(*) as detected, count(*) filter (where status = 'collected') as collected from file_list",
)
def run_summary(spark, sf):
    return s.run_summary(view(spark, sf, "file_list"))


@query("collected_rows", "file_list", "select * from file_list where status = 'collected'")
def collected_rows(spark, sf):
    return s.collected_rows(view(spark, sf, "file_list"))


ISSUE_COUNT = """(select count(*) from trace_src where scan_cost <= index_cost and table_rows > 100000)
  + (select count(*) from trace_src where scan_cost > index_cost and two_tables)
  + (select count(*) from trace_src where index_rows > 0 and clustering_factor / index_rows::double > 0.3)
  + (select count(*) from trace_src where ndv <= 10 and histogram is null and not column_no_stats)
  + (select count(*) from trace_src where stats_type = 'NOWORKLOAD') + (select count(*) from trace_src where mbrc_unset)
  + (select count(*) from trace_src where not_analyzed) + (select count(*) from trace_src where index_not_analyzed)
  + (select count(*) from trace_src where sampling_lines > 0)"""


@query(
    "cover_kpis",
    "awr_stat_src awr_plan_src detection exec_src trace_src",
    f"""
select * from (values
  (cast(1 as bigint), 'awr_sql', (select count(*) from awr_plan_src), 'none'),
  (2, 'detected_sql', (select count(*) from detection), 'none'),
  (3, 'tkprof_docs', (select count(distinct file_no) from exec_src), 'none'),
  (4, 'trace_docs', (select count(*) from trace_src), 'none'),
  (5, 'high_elapsed', (select count(*) from awr_stat_src where avg_elapsed_sec > 5),
     case when (select count(*) from awr_stat_src where avg_elapsed_sec > 5) > 0 then 'danger' else 'none' end),
  (6, 'trace_issues', {ISSUE_COUNT}, 'warn')) as t(item_no, item, count, alert)""",
)
def cover_kpis(spark, sf):
    traces = render.traces(spark, sf)
    return s.cover_kpis(
        render.awr_docs(spark, sf),
        view(spark, sf, "detection"),
        tkprof_docs(statements(spark, sf), blocks_per_doc=30),
        traces.texts,
        trace_issues(materialize(trace_facts(traces, kinds=FACT_KINDS), spark, "facts", "kind")),
    )
