"""Queries on execution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from slowlens.operators import execreport as e, execrules as r
from slowlens.plans import render
from slowlens.plans.catalog import query
from slowlens.sources.documents import PHASES

FILE = "concat('run', cast(file_no as varchar), '_trace.prf')"
KEY = f"{FILE} as file, block_no, sql_id"
SQL_TEXT = "concat('select /* ', sql_id, ' */ *', chr(10), '  from t where x = ', cast(o_orderkey as varchar))"
PREVIEW = "concat('select /* ', sql_id, ' */ *   from t where x = ', cast(o_orderkey as varchar))"
CPU = "cast(fetch_cpu_cs as double) / cast(100 as double)"
ELAPSED = "cast(fetch_elapsed_cs as double) / cast(100 as double)"
KEPT = "fetch_elapsed_cs > 0"
TOTAL_COUNT = "parse_count + execute_count + fetch_count"


def statements(spark, sf):
    return e.exec_statements(e.exec_blocks(render.exec_reports(spark, sf)))


def seconds_as_double(df):
    seconds = [f.name for f in df.schema if f.dataType.typeName() == "decimal"]
    return df.withColumns({c: F.col(c).cast("double") for c in seconds})


@query(
    "exec_blocks",
    "exec_src",
    f"""
select {FILE} as file, block_no, concat('select /* ', sql_id, ' */ *') as first_line, case
  when bind_count = 0 then concat('  log file sync  ', cast(execute_count as varchar), '  0.25  1.00')
  else '  value="not a bind"' end as last_line
from exec_src""",
)
def exec_blocks(spark, sf):
    lines = F.split("block", "\n")
    return e.exec_blocks(render.exec_reports(spark, sf)).select(
        "file", "block_no", F.get(lines, F.lit(0)).alias("first_line"), F.element_at(lines, -1).alias("last_line")
    )


@query(
    "exec_statements",
    "exec_src",
    f"""
select {KEY}, {SQL_TEXT} as sql_text, parse_count, execute_count, fetch_count, {CPU} as total_cpu,
  {ELAPSED} as total_elapsed, fetch_disk as total_disk, fetch_query as total_query, fetch_current as total_current,
  fetch_rows as total_rows
from exec_src where {KEPT}""",
)
def exec_statements(spark, sf):
    return seconds_as_double(
        statements(spark, sf).select(
            *e.KEY,
            "sql_text",
            *[f"{p}_count" for p in PHASES],
            *[f"total_{c}" for c in ("cpu", "elapsed", "disk", "query", "current", "rows")],
        )
    )


def _phases(text: str) -> str:
    cs = "cast({0} as double) / cast(100 as double)"
    return f"""
select {KEY}, {text}, 'Parse' as phase, parse_count as count, {cs.format(1)} as cpu, {cs.format('parse_count')} as elapsed, 0 as disk,
  parse_count as query, 0 as current, 0 as rows from exec_src where {KEPT}
union all select {KEY}, {text}, 'Execute', execute_count, {cs.format('execute_count')}, {cs.format(2)}, execute_count, 7, execute_count, 3
  from exec_src where {KEPT}
union all select {KEY}, {text}, 'Fetch', fetch_count, {CPU}, {ELAPSED}, fetch_disk, fetch_query, fetch_current, fetch_rows
  from exec_src where {KEPT}
union all select {KEY}, {text}, 'Total', null, {CPU}, {ELAPSED}, fetch_disk, fetch_query, fetch_current, fetch_rows
  from exec_src where {KEPT}"""


@query("exec_phases", "exec_src", _phases(f"{SQL_TEXT} as sql_text"))
def exec_phases(spark, sf):
    return seconds_as_double(e.exec_phases(statements(spark, sf)))


@query("exec_phase_report", "exec_src", _phases(f"{PREVIEW} as sql_preview"))
def exec_phase_report(spark, sf):
    return seconds_as_double(e.exec_phase_report(statements(spark, sf)))


@query(
    "exec_plan_lines",
    "exec_src",
    f"""
select {KEY}, cast(1 as bigint) as line_no, '-------  ---------------------------------------------------' as line
  from exec_src where {KEPT}
union all select {KEY}, 2, concat(cast(plan_rows as varchar), '  ', plan_op, ' T', cast(o_orderkey as varchar))
  from exec_src where {KEPT}
union all select {KEY}, 3, concat('     ', cast(fetch_rows as varchar), '   SORT ORDER BY (cr=', cast(fetch_query as varchar), ')')
  from exec_src where {KEPT}""",
)
def exec_plan_lines(spark, sf):
    return e.exec_plan_lines(statements(spark, sf))


WAIT = "cast(max_wait_cs as double) / cast(100 as double)"


@query(
    "exec_waits",
    "exec_src",
    f"""
select {KEY}, wait_event as event, times_waited, {WAIT} as max_wait from exec_src where {KEPT}
union all select {KEY}, 'log file sync', execute_count, cast(0.25 as double) from exec_src where {KEPT}""",
)
def exec_waits(spark, sf):
    return e.exec_waits(statements(spark, sf))


@query(
    "exec_wait_report",
    "exec_src",
    f"""
select {KEY}, wait_event as event, times_waited, {WAIT} as max_wait,
  case when max_wait_cs > 100 then 'danger' when max_wait_cs > 10 then 'warn' else 'none' end as band
from exec_src where {KEPT}
union all select {KEY}, 'log file sync', execute_count, cast(0.25 as double), 'warn' from exec_src where {KEPT}""",
)
def exec_wait_report(spark, sf):
    return e.exec_wait_report(e.exec_waits(statements(spark, sf)))


def _binds(text: str) -> str:
    return f"""
select {KEY}, {text}, cast(i + 1 as bigint) as position,
  case i when 0 then 'VARCHAR2' when 1 then 'NUMBER' when 2 then 'DATE' else 'TYPE(99)' end as type,
  concat('"', bind_value, ' ', cast(i as varchar), '"') as value
from exec_src cross join (values (0), (1), (2), (3)) as n(i) where {KEPT} and i < bind_count"""


@query("exec_binds", "exec_src", _binds(f"{SQL_TEXT} as sql_text"))
def exec_binds(spark, sf):
    return e.exec_binds(statements(spark, sf))


@query("exec_bind_report", "exec_src", _binds(f"{PREVIEW} as sql_preview"))
def exec_bind_report(spark, sf):
    return e.exec_bind_report(e.exec_binds(statements(spark, sf)))


GETS = "(fetch_query + fetch_current)"


def _ratio(a: str, b: str, digits: int) -> str:
    scale = 10**digits
    return f"cast((2 * {scale} * {a} + {b}) // (2 * {b}) as double) / cast({scale} as double)"


RULES = {
    "FULL_TABLE_SCAN": (
        1,
        "case when plan_rows > 100000 then 'HIGH' else 'MEDIUM' end",
        "concat('T', cast(o_orderkey as varchar))",
        "cast(plan_rows as double)",
        "plan_op = 'TABLE ACCESS FULL' and plan_rows >= 10000",
    ),
    "HIGH_COST_NL_JOIN": (2, "'HIGH'", "null", "cast(plan_rows as double)", "plan_op = 'NESTED LOOPS' and plan_rows >= 100000"),
    "HIGH_BUFFER_GETS_PER_ROW": (
        3,
        "'MEDIUM'",
        "null",
        f"case when fetch_rows > 0 then {_ratio(GETS, 'nullif(fetch_rows, 0)', 1)} end",
        f"fetch_rows > 0 and {GETS} > 100 * fetch_rows",
    ),
    "EXCESSIVE_PARSING": (
        4,
        "'MEDIUM'",
        "null",
        _ratio("parse_count", "execute_count", 2),
        "parse_count > 1 and execute_count > 0 and 2 * parse_count > execute_count",
    ),
    "HIGH_DISK_READ_RATIO": (
        5,
        f"case when 2 * fetch_disk < {GETS} then 'LOW' else 'MEDIUM' end",
        "null",
        f"case when {GETS} > 0 then {_ratio('fetch_disk', f'nullif({GETS}, 0)', 2)} end",
        f"{GETS} > 0 and fetch_disk > 0 and fetch_disk / {GETS}::double > cast(0.3 as double)",
    ),
    "EXCESSIVE_INDEX_READ": (
        6,
        "'MEDIUM'",
        "wait_event",
        "cast(times_waited as double)",
        "wait_event = 'db file sequential read' and times_waited > 1000",
    ),
    "EXCESSIVE_FTS_READ": (
        7,
        "'HIGH'",
        "wait_event",
        "cast(times_waited as double)",
        "wait_event = 'db file scattered read' and times_waited > 100",
    ),
}
ISSUES = ", issues as (" + "\nunion all ".join(
    f"""select {KEY}, cast({no} as bigint) as rule_no, {severity} as severity, '{kind}' as type, {subject} as subject,
  {measure} as measure, {ELAPSED} as elapsed from exec_src where {KEPT} and {condition}"""
    for kind, (no, severity, subject, measure, condition) in RULES.items()
) + ")\n"


@query(
    "exec_issues",
    "exec_src",
    ISSUES
    + """select file, block_no, sql_id, row_number() over (partition by file, block_no order by rule_no) as issue_no,
  rule_no, severity, type, subject, measure from issues""",
)
def exec_issues(spark, sf):
    return r.exec_issues(statements(spark, sf)).drop("message")


def _rule(kind: str):
    @query(
        f"exec_rule_{kind.lower()}",
        "exec_src",
        ISSUES + f"select file, block_no, sql_id, severity, subject, measure from issues where type = '{kind}'",
    )
    def run(spark, sf):
        found = r.exec_issues(statements(spark, sf)).filter(F.col("type") == kind)
        return found.select(*e.KEY, "severity", "subject", "measure")


for _kind in RULES:
    _rule(_kind)


@query(
    "exec_report_totals",
    "exec_src",
    ISSUES
    + f"""
select s.file, s.statements, coalesce(i.issues, 0) as issues, coalesce(i.high_issues, 0) as high_issues, s.total_elapsed
from (select {FILE} as file, count(*) as statements, cast(sum(fetch_elapsed_cs) as double) / cast(100 as double) as total_elapsed
      from exec_src where {KEPT} group by 1) s
  left join (select file, count(*) as issues, count(*) filter (where severity = 'HIGH') as high_issues
             from issues group by file) i on i.file = s.file""",
)
def exec_report_totals(spark, sf):
    return e.exec_report_totals(r.with_issues(statements(spark, sf)))


@query(
    "exec_worst_severity",
    "exec_src",
    ISSUES
    + """
select file, block_no, sql_id, count(*) as issue_count,
  case max(case severity when 'HIGH' then 3 when 'MEDIUM' then 2 else 1 end) when 3 then 'HIGH' when 2 then 'MEDIUM'
    else 'LOW' end as severity
from issues group by file, block_no, sql_id""",
)
def exec_worst_severity(spark, sf):
    return e.exec_worst_severity(r.with_issues(statements(spark, sf)))


@query(
    "exec_text_report",
    "exec_src",
    """
select concat('run', cast(file_no as varchar)) as doc_id, concat('run', cast(file_no as varchar), '_trace.prf') as file_name,
  cast(sum(22 + case when bind_count > 0 then 3 + 4 * bind_count else 0 end) + count(*) - 1 as bigint) as line_count
from exec_src group by file_no""",
)
def exec_text_report(spark, sf):
    return e.exec_text_report(render.exec_reports(spark, sf)).drop("file", "full_text", "part", "parts")
