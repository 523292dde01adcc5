"""Queries on optimizer traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from slowlens.config import KEY_PARAMETERS_PAGE, Settings
from slowlens.operators import optreports as v, optrules as r, opttrace as o
from slowlens.plans import render
from slowlens.plans.catalog import query
from slowlens.sinks.documents import materialize
from slowlens.sources.texts import rejected_traces, text_files, texts_of, trace_content_check

V = "varchar"


def facts(spark, sf, *kinds):
    """Facts of the kinds that a query reads."""
    return o.trace_facts(render.traces(spark, sf), kinds=kinds)


def shared_facts(spark, sf, *kinds):
    """Facts for queries with several readers: written once, read by each."""
    return materialize(facts(spark, sf, *kinds), spark, "facts", "kind")


@query("trace_content_check", "trace_src", "select file, cast(case when two_tables then 3 else 2 end as bigint) as marker_lines from trace_src")
def content_check(spark, sf):
    return trace_content_check(render.traces(spark, sf))


@query("rejected_traces", "trace_src", "select file from trace_src where trace_no % 3 = 0")
def rejected(spark, sf):
    """Traces of which every third one has lost its marker lines."""
    number = F.regexp_extract("file", r"10053_q(\d+)_", 1).cast("bigint")
    lost = F.regexp_replace("text", "(?m)^(?:SINGLE TABLE ACCESS PATH|PARAMETERS USED BY THE OPTIMIZER).*$", "")
    texts = render.trace_texts(spark, sf).withColumn("text", F.when(number % 3 == 0, lost).otherwise(F.col("text")))
    return rejected_traces(texts_of(texts))


@query(
    "trace_db_info",
    "trace_src",
    """
select file, '19c Enterprise Edition Release 19.0.0.0.0 - Production' as oracle_version,
  concat('INST', cast(instance_no as varchar)) as instance_name, concat('DB', cast(instance_no as varchar)) as database_name,
  'PRIMARY' as database_role, concat('node', cast(instance_no as varchar)) as node_name from trace_src""",
)
def trace_db_info(spark, sf):
    return o.trace_db_info(facts(spark, sf, "db"))


SQL_TEXT = "concat('select /* ', comment, ' */ * from ', table_name, chr(10), ' where c1 = ''a = b''')"


@query("trace_sql", "trace_src", f"select file, sql_id, {SQL_TEXT} as sql_text from trace_src")
def trace_sql(spark, sf):
    return o.trace_sql(render.traces(spark, sf))


SYSTEM = """
select file, 'stats_type' as item, stats_type as value, null as unit, null as default_value, null as is_default from trace_src
union all select file, 'CPUSPEEDNW', cast(cpu_speed as varchar), 'millions instructions/sec', '1000', cpu_speed = 1000 from trace_src
union all select file, 'MBRC', case when mbrc_unset then 'NO' else '16' end,
  case when mbrc_unset then 'VALUE blocks' else 'blocks' end, '8', mbrc_unset from trace_src"""


@query("trace_system_stats", "trace_src", SYSTEM)
def trace_system_stats(spark, sf):
    return o.trace_system_stats(facts(spark, sf, "system"))


PARAMS = """
select file, 'altered' as section, 'statistics_level' as name, statistics_level as value from trace_src
union all select file, 'default', 'optimizer_mode', 'all_rows' from trace_src
union all select file, 'default', 'cpu_count', cast(cpu_count as varchar) from trace_src
union all select file, 'default', '_optimizer_skip_scan_enabled', 'true' from trace_src
union all select file, 'default', '_other_parameter', cast(trace_no as varchar) from trace_src
union all select file, 'default', '_second_parameter', cast(cpu_count as varchar) from trace_src where two_tables"""


@query("trace_params", "trace_src", PARAMS)
def trace_params(spark, sf):
    return o.trace_params(facts(spark, sf, "parameter"))


TABLES = """
select file, table_name, 'A' as alias, table_rows as rows, table_blocks as blocks, cast(100 as double) as avg_row_len,
  not_analyzed from trace_src
union all select file, table2_name, 'B', 7, 3, cast(12.5 as double), false from trace_src where two_tables"""


@query("trace_table_stats", "trace_src", TABLES)
def trace_table_stats(spark, sf):
    return o.trace_table_stats(facts(spark, sf, "table")).drop("at")


INDEX_COLUMNS = """file, index_name, '1 2' as columns, cast(1 as bigint) as levels, cast(25 as bigint) as leaf_blocks,
  cast(100 as bigint) as distinct_keys, cast(1 as double) as lb_per_key, cast(2.5 as double) as db_per_key,
  cast(clustering_factor as double) as clustering_factor"""


@query(
    "trace_index_stats",
    "trace_src",
    f"""select {INDEX_COLUMNS}, cast(index_rows as double) as num_rows, index_not_analyzed as not_analyzed from trace_src""",
)
def trace_index_stats(spark, sf):
    return o.trace_index_stats(facts(spark, sf, "index")).drop("at")


HISTOGRAM = "coalesce(histogram, case when column_no_stats then 'N/A (no stats)' else 'None' end)"


@query(
    "trace_column_stats",
    "trace_src",
    f"""
select file, 'C1' as column_name, cast(2 as bigint) as col_num, 'NUMBER' as data_type, cast(5 as bigint) as avg_len, ndv,
  cast(2 as bigint) as nulls, cast(0.25 as double) as density, {HISTOGRAM} as histogram,
  cast(case when histogram is null then 0 else 10 end as bigint) as buckets,
  column_no_stats as no_statistics from trace_src""",
)
def trace_column_stats(spark, sf):
    return o.trace_column_stats(facts(spark, sf, "column")).drop("at", "uncomp_buckets", "end_pt_vals")


@query(
    "trace_column_rows",
    "trace_src",
    """
select file, 'C1' as column_name, cast(1 as bigint) as ndv from trace_src
union all select file, 'C1', ndv from trace_src""",
)
def trace_column_rows(spark, sf):
    return o.trace_column_rows(facts(spark, sf, "column")).select("file", "column_name", "ndv")


BLOCK_NO = "row_number() over (partition by file order by block_at)"


def numbered(df):
    """Blocks by number instead of by line."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("block_at")
    return df.withColumn("block_no", F.dense_rank().over(w).cast("bigint")).drop("block_at")


@query(
    "access_blocks",
    "trace_src",
    """
select file, cast(1 as bigint) as block_no, table_name, cardinality from trace_src
union all select file, 2, table2_name, null from trace_src where two_tables
union all select file, case when two_tables then 3 else 2 end, concat('W', cast(trace_no as varchar)), null from trace_src
  where nl_line""",
)
def access_blocks(spark, sf):
    return numbered(o.access_blocks(facts(spark, sf, "access")))


METHODS = """
, methods as (
select file, cast(1 as bigint) as block_no, table_name, cast(1 as bigint) as entry_no, 'TableScan' as method, null as index_name,
  cast(scan_cost as double) as cost, cast(scan_cost as double) as response_time, cast(0 as bigint) as degree,
  scan_cost + 0.25::double as cost_io, cast(7121 as bigint) as cost_cpu, cast(null as double) as ix_sel,
  cast(null as double) as ix_sel_with_filters, null as join_type from trace_src
union all select file, 1, table_name, 2, 'index (RangeScan)', index_name, index_cost + 0.125::double, cast(1 as double), 2,
  cast(1.5 as double), 200, cast(0.25 as double), cast(0.5 as double), 'NL' from trace_src where nl_line
union all select file, 1, table_name, case when nl_line then 3 else 2 end, 'index (RangeScan)', index_name,
  cast(index_cost as double), cast(index_cost as double), 1, cast(1.5 as double), 200, cast(0.25 as double),
  cast(0.5 as double), null from trace_src
union all select file, 2, table2_name, 1, 'TableScan', null, cast(3.5 as double), cast(3.5 as double), 0,
  null, null, null, null, null from trace_src where two_tables)
"""


@query("access_methods", "trace_src", METHODS + "select * from methods")
def access_methods(spark, sf):
    return numbered(o.access_methods(shared_facts(spark, sf, "access"))).drop("at")


@query("access_methods_sliced", "trace_src", METHODS + "select * from methods")
def access_methods_sliced(spark, sf):
    """The same where every block is longer than a slice."""
    return numbered(o.access_methods(shared_facts(spark, sf, "access"), Settings(slice_lines=7))).drop("at")


@query(
    "scan_costs",
    "trace_src",
    """
select file, cast(1 as bigint) as block_no, table_name, scan_cost + 0.5::double as scan_io_cost,
  cast(7121.44 as double) as scan_cpu_cost, scan_cost + 0.75::double as total_scan_io_cost,
  cast(7121.44 as double) as total_scan_cpu_cost from trace_src
union all select file, 2, table2_name, null, null, null, null from trace_src where two_tables
union all select file, case when two_tables then 3 else 2 end, concat('W', cast(trace_no as varchar)), null, null, null, null
  from trace_src where nl_line""",
)
def scan_costs(spark, sf):
    return numbered(o.scan_costs(facts(spark, sf, "access")))


BEST = """
, best as (select file, cast(1 as bigint) as block_no, table_name,
  case when scan_cost <= index_cost then 'TableScan' when two_tables then 'IndexFFS' else 'IndexRange' end as method,
  case when scan_cost <= index_cost then null else index_name end as index_name,
  cast(least(scan_cost, index_cost) as double) as cost, cast(1 as bigint) as degree,
  cast(least(scan_cost, index_cost) as double) as response_time, cast(10 as double) as cardinality from trace_src)
"""


@query("best_access", "trace_src", BEST + "select * from best")
def best_access(spark, sf):
    return numbered(o.best_access(facts(spark, sf, "access")))


@query(
    "join_orders",
    "trace_src",
    """
select file, cast(1 as bigint) as order_num, concat(table_name, case when two_tables then ',' || table2_name else '' end) as tables,
  concat(table_name, '[A]#0', case when two_tables then '  ' || table2_name || '[B]#1' else '' end) as raw from trace_src
union all select file, 2, table2_name, concat(table2_name, '[B]#1') from trace_src""",
)
def join_orders(spark, sf):
    found = o.join_orders(facts(spark, sf, "join")).drop("at")
    return found.withColumn("tables", F.array_join("tables", ","))


@query(
    "best_join",
    "trace_src",
    """
select file, cast(1 as bigint) as table_num, index_cost + 0.5::double as cost, cast(cardinality as double) as cardinality,
  cast(12 as double) as bytes from trace_src""",
)
def best_join(spark, sf):
    return o.best_join(facts(spark, sf, "join"))


@query(
    "overall_cost",
    "trace_src",
    """
select file, index_cost + 0.5::double as total_cost, cast(cardinality as double) as total_card,
  cast(12 as double) as total_bytes from trace_src""",
)
def overall_cost(spark, sf):
    return o.overall_cost(o.best_join(facts(spark, sf, "join")))


@query(
    "join_search",
    "trace_src",
    """
select file, permutations, cast(case when two_tables then 2 else 1 end as bigint) as tables,
  permutations = 1 and not two_tables as is_single_table from trace_src""",
)
def join_search(spark, sf):
    # every trace names its database
    return o.join_search(facts(spark, sf, "db", "join", "table"))


@query(
    "access_cost_analysis",
    "trace_src",
    METHODS
    + """
select file, table_name, arg_min(method, cost * 1000 + entry_no) as best_method,
  case when arg_min(entry_no, cost * 1000 + entry_no) = 1 then null
    else max(index_name) end as best_index,
  min(cost) as best_cost, max(cost) as worst_cost, case when count(*) > 1 then max(cost) / min(cost) end as cost_ratio,
  count(*) as alternatives
from methods group by file, table_name, block_no""",
)
def access_cost_analysis(spark, sf):
    return o.access_cost_analysis(o.access_methods(shared_facts(spark, sf, "access")))


@query(
    "dynamic_sampling",
    "trace_src",
    """
select file, concat('Dynamic sampling updated table stats.: blocks=', cast(i as varchar)) as message
from trace_src cross join (values (0), (1)) as n(i) where i < sampling_lines""",
)
def dynamic_sampling(spark, sf):
    return o.dynamic_sampling(facts(spark, sf, "sampling")).drop("at")


TRANSFORMATIONS = """
, t as (
select file, cast(1 as bigint) as kind_no, 'PM' as type, 'Predicate Move-Around' as name, 'considered' as status, null as detail
  from trace_src
union all select file, 2, 'CBQT', 'Cost-Based Query Transformation', 'bypassed',
  'CBQT bypassed for query block SEL$1 (#0): no complex view.' from trace_src
union all select file, 2, 'CBQT', 'Cost-Based Query Transformation', 'applied', 'CBQT: Considering view merge' from trace_src
union all select file, 3, 'TE', 'Table Expansion', 'considered', 'TE: Checking validity of table expansion' from trace_src
union all select file, 4, 'SU', 'Subquery Unnesting', case when unnested then 'applied' else 'considered' end,
  concat('SU: ', case when unnested then 'Unnested subquery' else 'Considering subquery unnesting' end) from trace_src
union all select file, 5, 'JE', 'Join Elimination', 'considered', 'JE:   Considering join elimination' from trace_src
union all select file, 6, 'CVM', 'Complex View Merging', 'considered', 'CVM: Considering view merge in query block SEL$2'
  from trace_src where unnested
union all select file, 7, 'ST', 'Star Transformation', 'considered', 'ST: not valid since star transformation is off'
  from trace_src where two_tables
union all select file, 8, 'ORE', 'Or Expansion', 'considered', 'ORE: bypassed - No valid predicate' from trace_src
union all select file, 9, 'GENERIC', 'Query Block Transformation', 'applied', 'query block SEL$1 #1 transformed' from trace_src)
"""


@query("transformations", "trace_src", TRANSFORMATIONS + "select * from t")
def transformations(spark, sf):
    return o.transformations(facts(spark, sf, "transformation")).drop("at")


@query(
    "transformation_summary",
    "trace_src",
    TRANSFORMATIONS
    + """
select file, kind_no, type, name, count(*) as entries, string_agg(distinct status, ', ' order by status) as statuses
from t group by file, kind_no, type, name""",
)
def transformation_summary(spark, sf):
    return o.transformation_summary(o.transformations(facts(spark, sf, "transformation")))


@query(
    "transformation_report",
    "trace_src",
    TRANSFORMATIONS
    + """
select file, type, name, status, substring(detail, 1, 30) as detail,
  case status when 'applied' then 'good' when 'bypassed' then 'warn' else 'none' end as band from t""",
)
def transformation_report(spark, sf):
    return v.transformation_report(o.transformations(facts(spark, sf, "transformation")), cut=30).drop("at")


# --- rules ---------------------------------------------------------------------

ISSUES = """
, issues as (
select file, cast(1 as bigint) as rule_no, 'WARNING' as severity, 'Full Table Scan' as type,
  cast(table_rows as double) as measure, concat(table_name, ': full scan is the best path for ', cast(table_rows as varchar), ' rows') as message
  from trace_src where scan_cost <= index_cost and table_rows > 100000
union all select file, 2, 'INFO', 'Index Fast Full Scan', null, concat(table_name, ' is read from index ', index_name)
  from trace_src where scan_cost > index_cost and two_tables
union all select file, 3, case when clustering_factor / index_rows::double > 0.5 then 'WARNING' else 'INFO' end,
  'High Clustering Factor', clustering_factor / index_rows::double,
  concat(index_name, ' has a clustering factor far from its row order')
  from trace_src where index_rows > 0 and clustering_factor / index_rows::double > cast(0.3 as double)
union all select file, 4, 'WARNING', 'Missing Histogram', cast(ndv as double),
  concat('C1: ', cast(ndv as varchar), ' distinct values and no histogram')
  from trace_src where ndv <= 10 and histogram is null and not column_no_stats
union all select file, 5, 'INFO', 'NOWORKLOAD System Stats', null, 'System statistics are not from a workload'
  from trace_src where stats_type = 'NOWORKLOAD'
union all select file, 6, 'WARNING', 'MBRC Not Set', cast(8 as double),
  'Multiblock read count is not set, the default applies: 8' from trace_src where mbrc_unset
union all select file, 7, 'WARNING', 'Table NOT ANALYZED', cast(1 as double), table_name from trace_src where not_analyzed
union all select file, 8, 'WARNING', 'Index NOT ANALYZED', cast(1 as double), index_name from trace_src where index_not_analyzed
union all select file, 9, 'INFO', 'Dynamic Sampling Used', cast(sampling_lines as double),
  concat('Dynamic sampling was used: ', cast(sampling_lines as varchar), ' messages') from trace_src where sampling_lines > 0)
"""


def issues(spark, sf):
    return r.trace_issues(shared_facts(spark, sf, *r.FACT_KINDS))


@query("trace_issues", "trace_src", ISSUES + "select * from issues")
def trace_issues(spark, sf):
    return issues(spark, sf).drop("at", "recommendation")


SINGLE_RULES = {
    1: ("full_table_scan", ("access", "table"), lambda f: r.full_scan_issues(o.best_access(f), o.trace_table_stats(f))),
    2: ("fast_full_scan", ("access",), lambda f: r.fast_full_scan_issues(o.best_access(f))),
    3: ("clustering_factor", ("index",), lambda f: r.clustering_issues(o.trace_index_stats(f))),
    4: ("missing_histogram", ("column",), lambda f: r.histogram_issues(o.trace_column_stats(f))),
    5: ("noworkload", ("system",), lambda f: r.system_stats_issues(o.trace_system_stats(f)).filter("rule_no = 5")),
    6: ("mbrc", ("system",), lambda f: r.system_stats_issues(o.trace_system_stats(f)).filter("rule_no = 6")),
    7: ("table_not_analyzed", ("table",), lambda f: r.not_analyzed_issues(o.trace_table_stats(f), "table_name", 7, "Table NOT ANALYZED")),
    8: ("index_not_analyzed", ("index",), lambda f: r.not_analyzed_issues(o.trace_index_stats(f), "index_name", 8, "Index NOT ANALYZED")),
    9: ("dynamic_sampling", ("sampling",), lambda f: r.sampling_issues(o.dynamic_sampling(f))),
}


def _rule(no: int):
    name, kinds, rule = SINGLE_RULES[no]

    @query(f"trace_rule_{name}", "trace_src", ISSUES + f"select file, severity, measure, message from issues where rule_no = {no}")
    def run(spark, sf):
        return rule(facts(spark, sf, *kinds)).select("file", "severity", "measure", "message")


for _no in SINGLE_RULES:
    _rule(_no)


@query(
    "issue_counts",
    "trace_src",
    ISSUES
    + """
select file, count(*) filter (where severity = 'WARNING') as warnings, count(*) filter (where severity = 'INFO') as infos,
  count(*) as issues from issues group by file""",
)
def issue_counts(spark, sf):
    return r.issue_counts(issues(spark, sf))


@query(
    "trace_issue_report",
    "trace_src",
    ISSUES
    + """
select i.file, sql_id, rule_no, case severity when 'WARNING' then '🟡 WARNING' else '🟢 INFO' end as severity_label, type, message
from issues i join trace_src t on t.file = i.file""",
)
def trace_issue_report(spark, sf):
    report = r.trace_issue_report(issues(spark, sf), o.trace_sql(render.traces(spark, sf)))
    return report.drop("at", "recommendation")


# --- report tables -------------------------------------------------------------


@query(
    "trace_summary",
    "trace_src",
    ISSUES.rstrip()
    + BEST
    + """
select s.file, s.sql_id, substring(concat('select /* ', comment, ' */ * from ', s.table_name, '  where c1 = ''a = b'''), 1, 80) as sql_preview,
  s.table_name, s.table_rows, b.method as best_method, b.index_name as best_index, b.cost as best_cost,
  index_cost + 0.5::double as total_cost, coalesce(n, 0) as issue_count,
  case when n > 2 then 'danger' when n > 0 then 'warn' else 'none' end as band,
  concat('INST', cast(instance_no as varchar)) as instance_name
from trace_src s join best b on b.file = s.file
  left join (select file, count(*) as n from issues group by file) c on c.file = s.file""",
)
def trace_summary(spark, sf):
    texts = render.traces(spark, sf)
    f = shared_facts(spark, sf, "db", "join", *r.FACT_KINDS)
    return v.trace_summary(
        text_files(texts),
        o.trace_sql(texts),
        o.trace_table_stats(f),
        o.access_blocks(f),
        o.best_access(f),
        o.best_join(f),
        r.trace_issues(f),
        o.trace_db_info(f),
    )


@query(
    "access_path_report",
    "trace_src",
    METHODS.rstrip()
    + BEST
    + """
, ranked as (select m.*, row_number() over (partition by m.file, m.block_no order by m.cost, entry_no) as rank,
  b.cost as best_cost, t.scan_cost from methods m left join best b on b.file = m.file and b.block_no = m.block_no
  join trace_src t on t.file = m.file),
scored as (select *, case when best_cost > 0 then cost / best_cost else 0 end as cost_ratio from ranked)
select file, block_no, table_name, rank, method, coalesce(index_name, '-') as index_name, cost, response_time, degree,
  cost_io, cost_cpu, ix_sel, case when block_no = 1 then scan_cost + 0.5::double end as scan_io_cost,
  case when block_no = 1 then scan_cost + 0.75::double end as total_scan_io_cost, rank = 1 as is_best, cost_ratio,
  case when rank = 1 then 'good' when cost_ratio > 5 then 'danger' else 'none' end as band
from scored""",
)
def access_path_report(spark, sf):
    f = shared_facts(spark, sf, "access")
    return numbered(v.access_path_report(o.access_methods(f), o.best_access(f), o.scan_costs(f)))


@query(
    "access_rank_html",
    "trace_src",
    METHODS
    + """
select file, block_no, table_name, row_number() over (partition by file, block_no order by cost, entry_no) as rank,
  method, index_name, cost, cost / min(cost) over (partition by file, block_no) as cost_ratio,
  count(*) over (partition by file, block_no) as methods,
  case when method like '%TableScan%' then 'FTS' when method like '%FFS%' then 'FFS' when method like '%FullScan%' then 'Full'
    else '' end as badge,
  row_number() over (partition by file, block_no order by cost, entry_no) = count(*) over (partition by file, block_no)
    and count(*) over (partition by file, block_no) > 1 as is_worst
from methods""",
)
def access_rank_html(spark, sf):
    return numbered(v.access_rank_html(o.access_methods(shared_facts(spark, sf, "access"))))


@query(
    "table_size_report",
    "trace_src",
    f"select file, table_name, alias, rows, blocks, avg_row_len, blocks * 8192 / cast(1048576 as double) as size_mb from ({TABLES})",
)
def table_size_report(spark, sf):
    return v.table_size_report(o.trace_table_stats(facts(spark, sf, "table")))


@query(
    "index_quality_report",
    "trace_src",
    f"""
select {INDEX_COLUMNS}, case when index_rows > 0 then clustering_factor / index_rows::double else 0 end as cf_ratio,
  case when index_rows = 0 then 'good' when clustering_factor / index_rows::double > cast(0.5 as double) then 'danger'
    when clustering_factor / index_rows::double > cast(0.3 as double) then 'warn'
    when clustering_factor / index_rows::double < cast(0.1 as double) then 'good' else 'none' end as band from trace_src""",
)
def index_quality_report(spark, sf):
    return v.index_quality_report(o.trace_index_stats(facts(spark, sf, "index")))


@query(
    "column_stats_report",
    "trace_src",
    f"""
select file, 'C1' as column_name, 'NUMBER' as data_type, ndv, cast(2 as bigint) as nulls, cast(0.25 as double) as density,
  cast(5 as bigint) as avg_len, {HISTOGRAM} as histogram,
  cast(case when histogram is null then 0 else 10 end as bigint) as buckets,
  case when histogram is null then 'warn' else 'good' end as band from trace_src""",
)
def column_stats_report(spark, sf):
    return v.column_stats_report(o.trace_column_stats(facts(spark, sf, "column")))


@query(
    "system_stats_report",
    "trace_src",
    f"select *, case when is_default then 'warn' else 'none' end as band from ({SYSTEM}) where item <> 'stats_type'",
)
def system_stats_report(spark, sf):
    return v.system_stats_report(o.trace_system_stats(facts(spark, sf, "system")))


@query(
    "system_stats_environment",
    "trace_src",
    f"""
select item, value, default_value, case when item = 'stats_type' then case when value = 'NOWORKLOAD' then 'warn' else 'good' end
  when is_default then 'warn' else 'none' end as band
from ({SYSTEM}) where file = (select min(file) from trace_src)""",
)
def system_stats_environment(spark, sf):
    return v.system_stats_environment(o.trace_system_stats(shared_facts(spark, sf, "system")))


@query(
    "key_params_report",
    "trace_src",
    f"select * from ({PARAMS}) where section = 'altered' or name in ('optimizer_mode', 'cpu_count')",
)
def key_params_report(spark, sf):
    return v.key_params_report(o.trace_params(facts(spark, sf, "parameter")))


@query("other_params_count", "trace_src", "select file, cast(case when two_tables then 2 else 1 end as bigint) as other_params from trace_src")
def other_params_count(spark, sf):
    return v.other_params_count(o.trace_params(facts(spark, sf, "parameter")), KEY_PARAMETERS_PAGE)
