"""Queries on fleet environment tables."""

from __future__ import annotations

from slowlens.config import INSTANCE_PARAMETERS, OS_ITEMS, PGA_ITEMS
from slowlens.operators import fleet as f
from slowlens.operators.opttrace import trace_db_info, trace_facts
from slowlens.plans import render
from slowlens.plans.catalog import query
from slowlens.plans.views import view


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(
    "memory_report",
    "env_metric",
    f"""
select inst_id, kind, name, coalesce(cast(value as double) / cast(1048576 as double), 0) as size_mb from env_metric
where kind = 'sga' or (kind = 'pga' and name in {_in(PGA_ITEMS)})""",
)
def memory_report(spark, sf):
    return f.memory_report(view(spark, sf, "env_metric"))


@query(
    "os_report",
    "env_metric",
    f"""
select inst_id, name, case when value is null then null when name like '%MEMORY%' then concat(
    cast((value * 20 + 1073741824) // 2147483648 // 10 as varchar), '.',
    cast((value * 20 + 1073741824) // 2147483648 % 10 as varchar), ' GB')
  else cast(value as varchar) end as shown
from env_metric where kind = 'os' and name in {_in(OS_ITEMS)}""",
)
def os_report(spark, sf):
    return f.os_report(view(spark, sf, "env_metric"))


@query(
    "param_report",
    "env_param",
    f"""
select inst_id, name, case when try_cast(value as bigint) > 1048576
    then concat(value, ' (', cast((2 * cast(value as bigint) + 1048576) // (2 * 1048576) as varchar), ' MB)')
    else value end as shown, not is_default as is_changed
from env_param where name in {_in(INSTANCE_PARAMETERS)}""",
)
def param_report(spark, sf):
    return f.param_report(view(spark, sf, "env_param"))


@query(
    "instance_status",
    "instances",
    """
select db_id, inst_id, instance_name, host_name, status, startup_time, case when status = 'OPEN' then 'good' else 'warn' end as band
from instances where db_id in (select db_id from instances group by db_id having count(*) > 1)""",
)
def instance_status(spark, sf):
    return f.instance_status(view(spark, sf, "instances"))


@query(
    "service_match",
    "targets instances databases",
    """
, v as (select t.db_id, t.inst_id, service_name, sid, instance_name, db_name, case
  when coalesce(service_name, '') <> '' then case when contains(upper(service_names), upper(service_name))
    or upper(service_name) = upper(db_name) then 'service' else 'service mismatch' end
  when coalesce(sid, '') <> '' then case when upper(sid) in (upper(instance_name), upper(db_name)) then 'sid'
    else 'sid mismatch' end
  else 'none' end as verdict
from targets t join instances i on i.db_id = t.db_id and i.inst_id = t.inst_id join databases d on d.db_id = t.db_id)
select *, verdict in ('service', 'sid') as matched from v""",
)
def service_match(spark, sf):
    return f.service_match(view(spark, sf, "targets"), view(spark, sf, "instances"), view(spark, sf, "databases"))


@query(
    "environment_from_trace",
    "trace_src",
    """
select file, '19c Enterprise Edition Release 19.0.0.0.0 - Production' as oracle_version,
  concat('INST', cast(instance_no as varchar)) as instance_name, concat('DB', cast(instance_no as varchar)) as database_name,
  'PRIMARY' as database_role, concat('node', cast(instance_no as varchar)) as node_name
from trace_src order by file limit 1""",
)
def environment_from_trace(spark, sf):
    return f.environment_from_trace(trace_db_info(trace_facts(render.traces(spark, sf), kinds=("db",))))
