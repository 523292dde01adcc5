"""Workload tables derived from the driver's tables, as SQL both engines read.

Every view uses its whole source table.  ``{days}`` is the only part that the
two dialects spell in their own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DAYS = {
    "spark": "datediff(l_shipdate, timestamp'1995-01-01')",
    "duckdb": "date_diff('day', timestamp '1995-01-01', l_shipdate)",
}

# name -> (views it reads, text)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sqlstat": (
        (),
        """
select cast(l_suppkey % 2 + 1 as bigint) as dbid, cast(l_linenumber as bigint) as instance_number,
  cast({days} as bigint) as snap_id,
  concat('s', lpad(cast(l_partkey as varchar(20)), 9, '0')) as sql_id,
  cast(l_suppkey % 5 as bigint) as plan_hash_value,
  case l_returnflag when 'A' then 'SYS' when 'N' then 'APP' else 'BATCH' end as parsing_schema_name,
  cast(l_quantity as bigint) - 1 as executions_delta,
  cast(round(l_extendedprice * 1000) as bigint) as elapsed_time_delta,
  cast(round(l_extendedprice * 700) as bigint) as cpu_time_delta,
  cast(round(l_extendedprice) as bigint) as buffer_gets_delta,
  cast(round(l_discount * 10000) as bigint) as disk_reads_delta,
  cast(l_quantity as bigint) as rows_processed_delta,
  cast(round(l_tax * 1000000) as bigint) as iowait_delta,
  l_shipdate as sample_time
from lineitem""",
    ),
    "snapshot": (
        ("sqlstat",),
        """
select distinct dbid, instance_number, snap_id, sample_time as begin_interval_time,
  sample_time + interval '1' hour as end_interval_time
from sqlstat""",
    ),
    "sqltext": (
        (),
        """
select cast(1 as bigint) as dbid, concat('s', lpad(cast(p_partkey as varchar(20)), 9, '0')) as sql_id,
  concat('select ', p_name, ' from ', p_type, ' where brand = ''', p_brand, '''') as sql_text
from part
union all
select cast(2 as bigint), concat('s', lpad(cast(p_partkey as varchar(20)), 9, '0')),
  concat(case when p_size % 2 = 0 then '' else '/* db2 */ ' end, 'select ', p_name, ' from ', p_type,
         ' where brand = ''', p_brand, '''')
from part""",
    ),
    "sysstat": (
        ("sqlstat",),
        """
select dbid, instance_number, snap_id, 'DB time' as stat_name,
  cast(sum(v) over (partition by dbid, instance_number order by snap_id) as bigint) as value
from (select dbid, instance_number, snap_id, cast(sum(elapsed_time_delta) as bigint) as v
      from sqlstat group by dbid, instance_number, snap_id) x
union all
select dbid, instance_number, snap_id, 'CPU time', cast(sum(cpu_time_delta) as bigint)
from sqlstat group by dbid, instance_number, snap_id""",
    ),
    "stmt_stats": (
        ("sqlstat",),
        """
select sql_id, plan_hash_value, parsing_schema_name,
  min(case when plan_hash_value = 4 then concat('begin DBMS_STATS.run(', sql_id, ')')
           else concat('select /* ', sql_id, ' */ 1') end) as sql_text,
  cast(sum(elapsed_time_delta) as bigint) as elapsed_time, cast(sum(cpu_time_delta) as bigint) as cpu_time,
  cast(sum(executions_delta) as bigint) as executions, cast(sum(buffer_gets_delta) as bigint) as buffer_gets,
  cast(sum(disk_reads_delta) as bigint) as disk_reads, count(*) as parse_calls,
  cast(min(snap_id) as varchar(20)) as first_load_time, max(sample_time) as last_active_time
from sqlstat group by sql_id, plan_hash_value, parsing_schema_name""",
    ),
    "accounts": (
        (),
        """
select * from (values ('SYS', 'OPEN'), ('SYSTEM', 'OPEN'), ('APP', 'OPEN'), ('BATCH', 'EXPIRED & LOCKED'))
  as t(username, account_status)""",
    ),
    "detection": (
        (),
        """
select concat('u', lpad(cast(user_id as varchar(20)), 9, '0')) as sql_id,
  case when event_id % 7 = 0 then null else event_id % 3 end as plan_hash_value,
  case event_type when 'error' then 'SYS' when 'view' then 'APP' when 'click' then 'WEB'
       when 'signup' then 'BATCH' else null end as parsing_schema_name,
  event_type as module, concat('select /* ', event_type, ' */ ', props) as sql_text,
  value as elapsed_sec_per_exec, cast(round(value * 4000) as bigint) as buffer_gets_per_exec,
  cast(round(value * 300) as bigint) as disk_reads_per_exec, event_id % 20 as executions, ts as detected_at
from events""",
    ),
    "ledger": (
        (),
        """
select concat('u', lpad(cast(user_id as varchar(20)), 9, '0')) as sql_id,
  cast(event_id % 2 as varchar(20)) as plan_hash_value, ts as collected_at, value as elapsed_sec_per_exec
from events""",
    ),
    "exec_src": (
        (),
        """
select o_orderkey, cast(floor(o_orderkey / 100) as bigint) as file_no,
  cast(row_number() over (partition by cast(floor(o_orderkey / 100) as bigint) order by o_orderkey) - 1 as bigint)
    as block_no,
  concat('o', cast(o_orderkey as varchar(20))) as sql_id,
  o_orderkey % 4 as parse_count, o_orderkey % 7 + 1 as execute_count, o_orderkey % 9 as fetch_count,
  o_orderkey % 1000 as fetch_cpu_cs, o_orderkey % 1700 as fetch_elapsed_cs,
  o_orderkey % 500 as fetch_disk, o_orderkey % 3000 as fetch_query, o_orderkey % 11 as fetch_current,
  o_orderkey % 13 as fetch_rows, (o_orderkey * 37) % 200000 as plan_rows,
  case when o_orderkey % 3 = 0 then 'TABLE ACCESS FULL' when o_orderkey % 3 = 1 then 'NESTED LOOPS'
       else 'INDEX RANGE SCAN' end as plan_op,
  case when o_orderkey % 2 = 0 then 'db file sequential read' else 'db file scattered read' end as wait_event,
  (o_orderkey * 3) % 2000 as times_waited, o_orderkey % 300 as max_wait_cs,
  o_orderkey % 4 as bind_count, o_orderpriority as bind_value
from orders""",
    ),
    "trace_src": (
        (),
        """
select p_partkey as trace_no, concat('q', cast(p_partkey as varchar(20))) as sql_id,
  concat('10053_q', cast(p_partkey as varchar(20)), '_20240101_000000.trc') as file,
  concat('T', cast(p_size as varchar(20))) as table_name, concat('U', cast(p_size as varchar(20))) as table2_name,
  p_partkey % 4 = 0 as two_tables,
  (p_partkey * 7919) % 300000 as table_rows, p_partkey % 900 + 1 as table_blocks, p_partkey % 5 = 0 as not_analyzed,
  concat('IX_', cast(p_partkey as varchar(20))) as index_name, p_partkey % 7 = 0 as index_not_analyzed,
  (p_partkey * 31) % 1000 as clustering_factor, p_partkey % 3000 as index_rows, p_partkey % 20 as ndv,
  case when p_partkey % 4 = 0 then 'Frequency' else null end as histogram, p_partkey % 3 = 0 as column_no_stats,
  p_partkey % 100 + 1 as scan_cost, p_partkey % 60 + 2 as index_cost, p_partkey % 6 = 0 as nl_line,
  p_partkey % 11 + 1 as cardinality,
  case when p_partkey % 2 = 0 then 'NOWORKLOAD' else 'WORKLOAD' end as stats_type,
  p_partkey % 3 = 1 as mbrc_unset, 1000 + p_partkey % 2000 as cpu_speed,
  p_partkey % 3 as sampling_lines, p_partkey % 3 + 1 as permutations,
  case when p_partkey % 5 = 1 then 'typical' else 'all' end as statistics_level, p_partkey % 64 + 1 as cpu_count,
  p_partkey % 8 as instance_no, p_partkey % 5 = 2 as unnested, p_name as comment
from part""",
    ),
    "awr_stat_src": (
        ("sqlstat",),
        """
select sql_id, snap_id, cast(sum(executions_delta) as bigint) as executions_delta,
  cast(sum(elapsed_time_delta) as double) / 10000000 as avg_elapsed_sec,
  cast(sum(cpu_time_delta) as double) / 10000000 as avg_cpu_sec,
  cast(sum(buffer_gets_delta) as bigint) as avg_buffer_gets,
  cast(sum(disk_reads_delta) * 20 as bigint) as avg_disk_reads, cast(sum(rows_processed_delta) as bigint) as avg_rows
from sqlstat group by sql_id, snap_id""",
    ),
    "awr_plan_src": (
        (),
        """
select concat('s', lpad(cast(p_partkey as varchar(20)), 9, '0')) as sql_id, p_name as name,
  p_size % 2 = 0 as has_full_scan, p_size % 3 = 0 as has_ffs, p_size % 5 = 0 as has_partition_all,
  p_size % 7 = 0 as has_sort, p_size % 4 = 0 as has_hash_join, p_size % 6 = 0 as has_nl, p_partkey % 300 as nl_rows_k
from part""",
    ),
    "plan_rows": (
        ("awr_plan_src",),
        """
select sql_id, 'ALLSTATS LAST' as format, cast(1 as bigint) as line_no,
  case when has_full_scan then 'NOTE: cannot fetch plan for SQL_ID' else concat('plan of ', name) end as line
from awr_plan_src
union all select sql_id, 'ALLSTATS LAST', cast(12 as bigint), 'cannot fetch plan, far down' from awr_plan_src
union all select sql_id, 'TYPICAL', cast(1 as bigint), concat('typical ', name) from awr_plan_src
union all select sql_id, 'TYPICAL', cast(2 as bigint),
  case when has_ffs then 'cannot fetch plan' else 'end' end from awr_plan_src
union all select sql_id, 'BASIC', cast(1 as bigint), 'not asked for' from awr_plan_src""",
    ),
    "bind_capture": (
        (),
        """
select concat('o', cast(o_orderkey as varchar(20))) as sql_id, cast(1 as bigint) as position, ':B1' as name,
  'NUMBER' as datatype_string, cast(o_custkey as varchar(20)) as value_string from orders
union all select concat('o', cast(o_orderkey as varchar(20))), cast(2 as bigint), 'b10', 'VARCHAR2(15)',
  concat(o_orderpriority, '''s :b1') from orders
union all select concat('o', cast(o_orderkey as varchar(20))), cast(3 as bigint), ':D', 'DATE', null from orders
union all select concat('o', cast(o_orderkey as varchar(20))), cast(4 as bigint), ':b1', 'NUMBER', '-1' from orders
union all select concat('o', cast(o_orderkey as varchar(20))), cast(5 as bigint), null, 'NUMBER', '7' from orders""",
    ),
    "bind_sql": (
        (),
        """
select concat('o', cast(o_orderkey as varchar(20))) as sql_id,
  concat('  explain plan for select * from t where a = :b1 and b = :B10 and c = :d and e = :left',
         cast(o_orderkey % 3 as varchar(20)), ' ') as sql_text from orders""",
    ),
    "instances": (
        (),
        """
select cast(n_regionkey as bigint) as db_id, cast(n_nationkey as bigint) as inst_id,
  concat('INST', cast(n_nationkey as varchar(20))) as instance_name, concat('host-', lower(n_name)) as host_name,
  case when n_nationkey % 4 = 0 then 'MOUNTED' else 'OPEN' end as status,
  concat('2024-01-', lpad(cast(n_nationkey + 1 as varchar(20)), 2, '0'), ' 06:30:00') as startup_time from nation""",
    ),
    "databases": (
        (),
        """
select cast(r_regionkey as bigint) as db_id, upper(r_name) as db_name,
  concat(lower(r_name), '_svc,', lower(r_name), '_ro') as service_names from region""",
    ),
    "targets": (
        (),
        """
select cast(n_regionkey as bigint) as db_id, cast(n_nationkey as bigint) as inst_id,
  case n_nationkey % 5 when 0 then concat(lower(r_name), '_svc') when 1 then 'other' when 2 then lower(r_name)
       else null end as service_name,
  case n_nationkey % 5 when 3 then concat('inst', cast(n_nationkey as varchar(20))) when 4 then
       case when n_nationkey % 2 = 0 then 'wrong' else '' end else 'unused' end as sid
from nation join region on n_regionkey = r_regionkey""",
    ),
    "env_metric": (
        (),
        """
select cast(s_nationkey as bigint) as inst_id, case s_suppkey % 3 when 0 then 'sga' when 1 then 'pga' else 'os' end as kind,
  case s_suppkey % 3 when 0 then concat('pool', cast(s_suppkey as varchar(20)))
    when 1 then case s_suppkey % 2 when 0 then 'total PGA inuse' else 'process count' end
    else case s_suppkey % 4 when 0 then 'PHYSICAL_MEMORY_BYTES' when 1 then 'NUM_CPUS' when 2 then 'BUSY_TIME' else 'LOAD' end
  end as name,
  case when s_suppkey % 10 = 9 then null else cast(s_suppkey as bigint) * 104857600 + cast(round(s_acctbal) as bigint) end as value
from supplier""",
    ),
    "env_param": (
        (),
        """
select cast(s_nationkey as bigint) as inst_id,
  case s_suppkey % 4 when 0 then 'sga_target' when 1 then 'optimizer_mode' when 2 then 'open_cursors' else '_hidden' end as name,
  case s_suppkey % 4 when 0 then cast(cast(s_suppkey as bigint) * 1500000 as varchar(20)) when 1 then 'ALL_ROWS'
    when 2 then cast(s_suppkey as varchar(20)) else '1' end as value,
  s_suppkey % 3 = 0 as is_default from supplier""",
    ),
    "file_list": (
        (),
        """
select case event_id % 3 when 0 then 'traces' when 1 then 'tkprof' else 'reports' end as dir,
  concat(case event_id % 4 when 0 then '10053_' when 1 then 'detected_' when 2 then 'trace_results_' else 'run_' end,
    cast(event_id as varchar(20)),
    case event_id % 3 when 0 then '.trc' when 1 then '.prf' else '.html' end) as file_name, ts as mtime,
  case when event_id % 5 = 0 then 'failed' else 'collected' end as status from events""",
    ),
    "done_list": (
        (),
        """
select concat(case (event_id * 2) % 4 when 0 then '10053_' else 'trace_results_' end,
    cast(event_id * 2 as varchar(20)), '.prf') as file_name from events""",
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in out:
            out.append(name)

    for name in names:
        visit(name)
    return out


def oracle(views: str, select: str) -> str:
    """A statement for the other engine: the views it names, then ``select``."""
    parts = [f"{n} as ({VIEWS[n][1].format(days=DAYS['duckdb']).strip()})" for n in _needed(tuple(views.split()))]
    head = "with " + ",\n".join(parts) + "\n" if parts else ""
    return head + select.strip()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One workload table as a lazy DataFrame."""
    text = "\n".join(VIEWS[n][1] for n in _needed((name,)))
    bases = [
        f"{t} as (select * from parquet.`{sf_dir.rstrip('/')}/{t}.parquet`)"
        for t in BASE_TABLES
        if f"from {t}" in text or f"join {t}" in text
    ]
    parts = bases + [f"{n} as ({VIEWS[n][1].format(days=DAYS['spark']).strip()})" for n in _needed((name,))]
    return spark.sql("with " + ",\n".join(parts) + f"\nselect * from {name}")
