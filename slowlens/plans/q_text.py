"""Queries on scalar text functions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from slowlens.functions import labels, text as t
from slowlens.plans import render
from slowlens.plans.catalog import query
from slowlens.plans.views import view

FLAGS = ("has_full_scan", "has_ffs", "has_partition_all", "has_sort", "has_hash_join")


@query(
    "plan_text",
    "awr_plan_src",
    """
, w as (select *, case when has_nl then length('|  7 |  TABLE ACCESS BY INDEX ROWID | ' || cast(nl_rows_k as varchar) || 'K | 2 |')
    else greatest(32, case when has_ffs then length('|  2 |  INDEX FAST FULL SCAN | 10 | 2 |') else 0 end,
      case when has_full_scan then length('|  1 |  TABLE ACCESS FULL | 10 | 2 |') else 0 end,
      case when has_partition_all then length('|  3 |  PARTITION RANGE ALL | 10 | 2 |') else 0 end) end as width
  from awr_plan_src)
select sql_id, concat('| Id | Operation | Rows | Cost |', chr(10), repeat('-', width), chr(10),
  case when has_full_scan then '|  1 |  TABLE ACCESS FULL | 10 | 2 |' || chr(10) else '' end,
  case when has_ffs then '|  2 |  INDEX FAST FULL SCAN | 10 | 2 |' || chr(10) else '' end,
  case when has_partition_all then '|  3 |  PARTITION RANGE ALL | 10 | 2 |' || chr(10) else '' end,
  case when has_sort then '|  4 |  SORT GROUP BY | 10 | 2 |' || chr(10) else '' end,
  case when has_hash_join then '|  5 |  HASH JOIN | 10 | 2 |' || chr(10) else '' end,
  case when has_nl then '|  6 |  NESTED LOOPS | 5 | 2 |' || chr(10) || '|  7 |  TABLE ACCESS BY INDEX ROWID | '
    || cast(nl_rows_k as varchar) || 'K | 2 |' || chr(10) else '' end, repeat('-', width)) as plan_text
from w""",
)
def plan_text(spark, sf):
    return render.awr_docs(spark, sf).select("sql_id", t.plan_text(F.col("plan")).alias("plan_text"))


@query(
    "preview",
    "bind_sql",
    """
select sql_id, replace(substring(concat(sql_text, chr(10), sql_text), 1, 80), chr(10), ' ') as short,
  case when length(concat(sql_text, chr(10), sql_text)) > 100 then substring(concat(sql_text, chr(10), sql_text), 1, 100) || '...'
    else concat(sql_text, chr(10), sql_text) end as long from bind_sql""",
)
def preview(spark, sf):
    twice = F.concat("sql_text", F.lit("\n"), "sql_text")
    return view(spark, sf, "bind_sql").select(
        "sql_id", t.preview(twice, 80).alias("short"), t.preview(twice, 100, ellipsis=True).alias("long")
    )


NUMBER_CASES = (
    ("K", "{0}K", "{0} * 1000.0::double"),
    ("M", "{0}.5M", "({0} + 0.5::double) * 1000000.0::double"),
    ("G", " {0}G ", "{0} * 1000000000.0::double"),
    ("comma", "1,{0},000", None),
    ("bad", "{0}X", "0.0::double"),
    ("plain", "{0}.25", "{0} + 0.25::double"),
)


@query(
    "parse_num",
    "",
    """
select p_partkey, 'K' as shape, p_size * 1000.0::double as number from part
union all select p_partkey, 'M', (p_size + 0.5::double) * 1000000.0::double from part
union all select p_partkey, 'G', p_size * 1000000000.0::double from part
union all select p_partkey, 'comma', cast('1' || cast(p_size as varchar) || '000' as double) from part
union all select p_partkey, 'bad', 0.0::double from part
union all select p_partkey, 'plain', p_size + 0.25::double from part""",
)
def parse_num(spark, sf):
    size = F.col("p_size").cast("string")
    shapes = F.array(
        *[
            F.struct(F.lit(name).alias("shape"), F.replace(F.lit(form), F.lit("{0}"), size).alias("text"))
            for name, form, _ in NUMBER_CASES
        ]
    )
    part = spark.read.parquet(f"{sf}/part.parquet")
    return (
        part.select("p_partkey", F.explode(shapes).alias("s"))
        .select("p_partkey", "s.shape", t.parse_num(F.col("s.text")).alias("number"))
    )


@query(
    "literalise",
    "bind_sql bind_capture",
    """
select sql_id, concat('  explain plan for select * from t where a = ', max(case when position = 1 then value_string end),
  ' and b = ''', replace(max(case when position = 2 then value_string end), '''', ''''''), ''' and c = NULL and e = ''DUMMY'' ')
  as literal_sql
from bind_capture group by sql_id""",
)
def literalise(spark, sf):
    return t.literalise(view(spark, sf, "bind_sql"), view(spark, sf, "bind_capture"))


@query(
    "strip_explain",
    "bind_sql",
    "select sql_id, substring(trim(sql_text), 18) as statement from bind_sql",
)
def strip_explain(spark, sf):
    return view(spark, sf, "bind_sql").select("sql_id", t.strip_explain(F.col("sql_text")).alias("statement"))


@query(
    "bind_placeholders",
    "bind_sql",
    """
select sql_id, concat('b1,B10,d,left', right(trim(sql_text), 1)) as names from bind_sql""",
)
def bind_placeholders(spark, sf):
    return view(spark, sf, "bind_sql").select(
        "sql_id", F.array_join(t.bind_placeholders(F.col("sql_text")), ",").alias("names")
    )


@query(
    "file_names",
    "file_list",
    """
select file_name, mtime, file_name as base, regexp_replace(file_name, '\\.[^.]*$', '') as stem from file_list""",
)
def file_names(spark, sf):
    path = F.concat_ws("/", F.lit("/data"), "dir", "file_name")
    return view(spark, sf, "file_list").select(
        "file_name", "mtime", t.base_name(path).alias("base"), t.split_stem(path).alias("stem")
    )


@query(
    "severity_labels",
    "detection",
    """
, s as (select sql_id, detected_at, case when executions < 5 then 'HIGH' when executions < 9 then 'MEDIUM'
  when executions < 12 then 'LOW' else 'OTHER' end as severity from detection)
select sql_id, detected_at, case severity when 'HIGH' then '🔴 HIGH' when 'MEDIUM' then '🟡 MEDIUM' when 'LOW' then '🟢 LOW'
  else severity end as label, cast(case severity when 'HIGH' then 3 when 'MEDIUM' then 2 when 'LOW' then 1 else 0 end as bigint) as weight
from s""",
)
def severity_labels(spark, sf):
    n = F.col("executions")
    severity = F.when(n < 5, "HIGH").when(n < 9, "MEDIUM").when(n < 12, "LOW").otherwise("OTHER")
    return view(spark, sf, "detection").select(
        "sql_id",
        "detected_at",
        labels.severity_label(severity).alias("label"),
        labels.severity_weight(severity).cast("bigint").alias("weight"),
    )


@query(
    "bind_type_names",
    "",
    """
select o_orderkey, case o_orderkey % 200 when 1 then 'VARCHAR2' when 2 then 'NUMBER' when 12 then 'DATE' when 23 then 'RAW'
  when 96 then 'CHAR' when 112 then 'CLOB' when 113 then 'BLOB' when 180 then 'TIMESTAMP' when 181 then 'TIMESTAMP WITH TZ'
  else 'TYPE(' || cast(o_orderkey % 200 as varchar) || ')' end as type from orders""",
)
def bind_type_names(spark, sf):
    code = (F.col("o_orderkey") % 200).cast("string")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", labels.bind_type_name(code).alias("type"))
