"""Snapshot workload: top statements, database time, statistics documents."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from slowlens.config import DEFAULTS, INELIGIBLE_USERS, PLAN_FORMATS, PLAN_MISSING, SYSTEM_SCHEMAS
from slowlens.functions.labels import band
from slowlens.functions.text import parse_num, preview

SNAP_KEY = ["dbid", "instance_number", "snap_id"]
# Snapshots per folder of a partitioned counter table, see ``snap_range``.
SNAPS_PER_RANGE = 24
# Fixed value: characters of statement text that identify a group.
TEXT_CUT = 4000


def report_window(kind: str, day: date | datetime) -> tuple[datetime, datetime]:
    """Bounds of a ``daily`` or ``weekly`` report."""
    start = day if isinstance(day, datetime) else datetime.combine(day, time.min)
    if kind == "weekly":
        return start - timedelta(days=7), start
    if kind == "daily":
        midnight = start.replace(hour=0, minute=0, second=0)
        return midnight, midnight.replace(hour=23, minute=59, second=59)
    raise ValueError(f"unknown report kind: {kind}")


def snapshots_between(snapshot: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Keys of the snapshots that lie in the window as a whole."""
    return snapshot.filter(
        (F.col("begin_interval_time") >= F.lit(start)) & (F.col("end_interval_time") <= F.lit(end))
    ).select(*SNAP_KEY)


def snap_range() -> Column:
    """Folder number of a snapshot in a counter table written in ranges."""
    return F.floor(F.col("snap_id") / SNAPS_PER_RANGE).cast("bigint")


def in_window(sqlstat: DataFrame, snapshot: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Counter rows of the snapshots in the window.

    Snapshot keys are unique, so this cannot multiply rows.  A counter table in
    ranges is joined on its folder as well, which prunes folders at run time.
    """
    keys = snapshots_between(snapshot, start, end)
    if "snap_range" in sqlstat.columns:
        return sqlstat.join(keys.withColumn("snap_range", snap_range()), [*SNAP_KEY, "snap_range"])
    return sqlstat.join(keys, SNAP_KEY)


def _exact_seconds(total: Column, digits: int) -> Column:
    """Microseconds as seconds, rounded half up on decimals."""
    return F.round(total.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"), digits).cast("double")


def _with_texts(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """The few ranked rows with their texts, as a left join that broadcasts the
    left side.

    ``ranked`` is read once and has at most ``top_n`` rows, which bounds the
    broadcast; texts are only scanned, never shuffled.  Each row looks for its
    own key and for an empty one, which a single extra row without text has, so
    a row whose text is missing survives.
    """

    def key(dbid: str) -> Column:
        return F.concat_ws(":", F.col(dbid).cast("string"), F.col("sql_id"))

    wanted = ranked.withColumn(
        "_key", F.explode(F.array_compact(F.array(F.when(F.col("_digest").isNotNull(), key("_dbid")), F.lit(""))))
    )
    extra = texts.sparkSession.range(1).select(F.lit("").alias("_key"), F.lit(None).cast("string").alias("sql_text"))
    keyed = texts.select(key("dbid").alias("_key"), "sql_text").unionByName(extra)
    hits = keyed.join(F.broadcast(wanted), "_key").filter(
        F.col("sql_text").isNull() | (F.sha2("sql_text", 256) == F.col("_digest"))
    )
    return hits.groupBy(*ranked.columns).agg(F.max("sql_text").alias("sql_text"))


def top_sql(
    sqlstat: DataFrame,
    snapshot: DataFrame,
    sqltext: DataFrame,
    start: datetime,
    end: datetime,
    top_n: int = DEFAULTS.top_n,
    excluded_schemas: Sequence[str] = SYSTEM_SCHEMAS,
    observation: Observation | None = None,
) -> DataFrame:
    """The ``top_n`` statements of a time window by elapsed seconds.

    ``observation`` gets ``elapsed``, the microseconds of all statements of the
    window, whatever their schema, from the same scan (see ``elapsed_seconds``).

    Groups are (sql_id, plan, first 4000 characters of text, schema), over all
    databases.  Counters are summed per database first; only then is the text
    joined, as a digest, so that neither the join nor the last aggregate moves
    any text.  The texts of the few result rows are looked up at the end.
    """
    counters = (
        "executions_delta",
        "elapsed_time_delta",
        "buffer_gets_delta",
        "disk_reads_delta",
        "cpu_time_delta",
        "rows_processed_delta",
        "iowait_delta",
    )
    group = ["sql_id", "plan_hash_value", "parsing_schema_name"]
    wanted = ~F.col("parsing_schema_name").isin(*excluded_schemas)
    if observation is None:
        rows = in_window(sqlstat.filter(wanted), snapshot, start, end)
    else:
        elapsed_sum = F.sum(F.col("elapsed_time_delta").cast("decimal(20,0)")).alias("elapsed")
        rows = in_window(sqlstat, snapshot, start, end).observe(observation, elapsed_sum).filter(wanted)
    per_db = (
        rows.groupBy("dbid", *group)
        .agg(*[F.sum(c).alias(c) for c in counters])
    )
    cut = F.substring("sql_text", 1, TEXT_CUT)
    digests = (
        sqltext.select("dbid", "sql_id", F.sha2(cut, 256).alias("_digest"))
        .groupBy("dbid", "sql_id")
        .agg(F.min("_digest").alias("_digest"))
    )
    totals = (
        per_db.join(digests, ["dbid", "sql_id"], "left")
        .groupBy(*group, "_digest")
        .agg(*[F.sum(c).alias(c) for c in counters], F.min("dbid").alias("_dbid"))
    )
    n, elapsed, gets = F.col("executions_delta"), F.col("elapsed_time_delta"), F.col("buffer_gets_delta")
    ranked = (
        totals.withColumn("elapsed_sec", _exact_seconds(elapsed, 2))
        .orderBy(F.desc("elapsed_sec"), *group, "_digest")
        .limit(top_n)
    )
    exact = "decimal(20,0)"
    found = _with_texts(ranked, sqltext.select("dbid", "sql_id", cut.alias("sql_text")))
    return found.select(
        "sql_id",
        "plan_hash_value",
        "sql_text",
        "parsing_schema_name",
        n.alias("executions"),
        "elapsed_sec",
        F.when(n > 0, F.round(elapsed.cast(exact) / n.cast(exact) / F.lit(1_000_000).cast("decimal(7,0)"), 3))
        .otherwise(F.round(elapsed.cast(exact) / F.lit(1_000_000).cast("decimal(7,0)"), 3))
        .cast("double")
        .alias("elapsed_per_exec"),
        gets.alias("buffer_gets"),
        F.when(n > 0, F.round(gets.cast(exact) / n.cast(exact), 0))
        .otherwise(gets)
        .cast("bigint")
        .alias("buffer_gets_per_exec"),
        F.col("disk_reads_delta").alias("disk_reads"),
        _exact_seconds(F.col("cpu_time_delta"), 2).alias("cpu_sec"),
        F.col("rows_processed_delta").alias("rows_processed"),
        (F.col("iowait_delta") / F.lit(1e6)).alias("io_wait_sec"),
    )


def db_time(
    sysstat: DataFrame,
    snapshot: DataFrame,
    start: datetime,
    end: datetime,
    stat_name: str = "DB time",
    unit: float = 1e6,
) -> DataFrame:
    """Growth of a cumulative counter over adjacent snapshots of the window.

    A pair needs snapshot ids that differ by exactly one; a gap gives no pair.
    The first snapshot of a pair must begin, the second one end, in the window.
    Every value is used once as begin and once as end of a pair, so the join is
    written as two keyed rows per value and one aggregate per pair key: one
    shuffle of the counter rows, and no hot key can fan out.
    """
    times = snapshot.select(*SNAP_KEY, "begin_interval_time", "end_interval_time")
    values = (
        sysstat.filter(F.col("stat_name") == stat_name)
        .select(*SNAP_KEY, "value")
        .join(times, SNAP_KEY)
        .select(
            "dbid",
            "instance_number",
            "value",
            F.explode(
                F.array(
                    F.struct(
                        F.col("snap_id").alias("pair"),
                        F.lit(True).alias("is_begin"),
                        (F.col("begin_interval_time") >= F.lit(start)).alias("inside"),
                    ),
                    F.struct(
                        (F.col("snap_id") - 1).alias("pair"),
                        F.lit(False).alias("is_begin"),
                        (F.col("end_interval_time") <= F.lit(end)).alias("inside"),
                    ),
                )
            ).alias("p"),
        )
        .select("dbid", "instance_number", "value", "p.*")
        .filter("inside")
    )
    pairs = (
        values.groupBy("dbid", "instance_number", "pair")
        .agg(
            F.max(F.when(F.col("is_begin"), F.col("value"))).alias("b"),
            F.max(F.when(~F.col("is_begin"), F.col("value"))).alias("e"),
        )
        .filter("b is not null and e is not null")
    )
    total = F.sum((F.col("e") - F.col("b")).cast("decimal(20,0)"))
    return pairs.agg(
        F.coalesce(F.round(total / F.lit(Decimal(str(unit))).cast("decimal(18,6)"), 2).cast("double"), F.lit(0.0)).alias(
            "db_time_sec"
        )
    )


def sql_elapsed(sqlstat: DataFrame, snapshot: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Elapsed seconds of all statements of the window, whatever their schema."""
    rows = in_window(sqlstat, snapshot, start, end)
    total = F.sum(F.col("elapsed_time_delta").cast("decimal(20,0)"))
    return rows.agg(elapsed_seconds(total).alias("sql_elapsed_sec"))


def elapsed_seconds(total: Column) -> Column:
    """Microseconds of a window as seconds, 0 without any row."""
    return F.coalesce(F.round(total.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(7,0)"), 2).cast("double"), F.lit(0.0))


def db_summary(sysstat, sqlstat, snapshot, start, end) -> DataFrame:
    """Both totals in one row."""
    elapsed = sql_elapsed(sqlstat, snapshot, start, end)
    return db_time(sysstat, snapshot, start, end).withColumn("sql_elapsed_sec", elapsed.scalar())


def top_sql_report(top: DataFrame) -> DataFrame:
    """Ranked sheet rows; ``top`` holds at most ``top_n`` rows."""
    order = Window.orderBy(
        F.desc("elapsed_sec"), "sql_id", "plan_hash_value", "parsing_schema_name", F.sha2("sql_text", 256)
    )
    each = F.coalesce("elapsed_per_exec", F.lit(0.0))
    return top.withColumn("rank", F.row_number().over(order).cast("bigint")).select(
        "rank",
        (F.col("rank") <= 3).alias("is_top3"),
        "sql_id",
        "parsing_schema_name",
        "elapsed_sec",
        "elapsed_per_exec",
        F.when(each >= 10, "SLOW").when(each >= 5, "WARN").otherwise("").alias("severity"),
        "executions",
        "buffer_gets",
        "buffer_gets_per_exec",
        "disk_reads",
        "cpu_sec",
        F.substring(F.coalesce("sql_text", F.lit("")), 1, 120).alias("sql_preview"),
    )


def workload_kpis(top: DataFrame, detected: DataFrame, reports: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: three counts and the two totals."""
    count = lambda df: df.agg(F.count("*")).scalar()
    return summary.select(
        count(top).alias("top_sql_count"),
        count(detected).alias("detected_count"),
        count(reports).alias("report_count"),
        "db_time_sec",
        "sql_elapsed_sec",
    )


# --- statistics documents ---------------------------------------------------


def awr_stat(docs: DataFrame) -> DataFrame:
    """One row per document and snapshot."""
    return docs.select("sql_id", F.explode("stats").alias("s")).select("sql_id", "s.*")


def awr_stats_report(docs: DataFrame) -> DataFrame:
    elapsed = F.coalesce(F.col("avg_elapsed_sec").cast("double"), F.lit(0.0))
    return awr_stat(docs).select(
        "sql_id",
        "snap_time",
        "plan_hash_value",
        "executions_delta",
        elapsed.alias("avg_elapsed_sec"),
        "avg_cpu_sec",
        F.coalesce("avg_buffer_gets", F.lit("0")).alias("avg_buffer_gets"),
        "avg_disk_reads",
        "avg_rows",
        band(elapsed, 5, 1).alias("band"),
    )


def awr_summary(docs: DataFrame) -> DataFrame:
    """One row per document; statistics are those of its first element."""
    first = F.try_element_at("stats", F.lit(1))
    return docs.select(
        "sql_id",
        preview(F.coalesce("sql_text", F.lit("")), 80).alias("sql_preview"),
        "plan_hash_value",
        F.coalesce(F.size("plan"), F.lit(0)).cast("bigint").alias("plan_lines"),
        F.coalesce(F.size("stats"), F.lit(0)).cast("bigint").alias("stats_count"),
        first["avg_elapsed_sec"].alias("avg_elapsed_sec"),
        first["avg_buffer_gets"].alias("avg_buffer_gets"),
        F.coalesce("source", F.lit("awr")).alias("source"),
    )


def high_elapsed_count(docs: DataFrame, limit_sec: float = 5.0) -> DataFrame:
    """Pairs of document and snapshot above the limit; counted inside each row."""
    slow = F.filter("stats", lambda s: F.coalesce(s["avg_elapsed_sec"].cast("double"), F.lit(0.0)) > limit_sec)
    return docs.agg(F.coalesce(F.sum(F.coalesce(F.size(slow), F.lit(0))), F.lit(0)).cast("bigint").alias("high_elapsed"))


# --- statement ids -----------------------------------------------------------


def ineligible_accounts(accounts: DataFrame, users: Sequence[str] = INELIGIBLE_USERS) -> DataFrame:
    """Locked accounts and the named ones, as ``parsing_schema_name``."""
    return accounts.filter(F.col("account_status").contains("LOCKED") | F.col("username").isin(*users)).select(
        F.col("username").alias("parsing_schema_name")
    )


def _eligible(per_schema: DataFrame, accounts: DataFrame) -> DataFrame:
    """Rows of schemas that are not ineligible.

    Takes rows that are already reduced to one per id and schema: a schema may
    own a large part of all statements, and only its distinct ids reach the join.
    """
    return per_schema.join(ineligible_accounts(accounts).distinct(), "parsing_schema_name", "left_anti")


def top_statement_ids(stmt_stats: DataFrame, accounts: DataFrame, n: int = DEFAULTS.top_n) -> DataFrame:
    """Ids of eligible schemas by their largest elapsed time."""
    per_schema = (
        stmt_stats.filter("elapsed_time > 0 and parsing_schema_name is not null")
        .groupBy("sql_id", "parsing_schema_name")
        .agg(F.max("elapsed_time").alias("elapsed_time"))
    )
    return (
        _eligible(per_schema, accounts)
        .groupBy("sql_id")
        .agg(F.max("elapsed_time").alias("elapsed_time"))
        .orderBy(F.desc("elapsed_time"), "sql_id")
        .limit(n)
    )


def eligible_ids(ids: DataFrame, stmt_stats: DataFrame, accounts: DataFrame) -> DataFrame:
    """Those ids that occur for an eligible schema, each once.

    The statement side is reduced to distinct pairs of id and schema first.
    """
    pairs = stmt_stats.filter("parsing_schema_name is not null").select("sql_id", "parsing_schema_name").distinct()
    return ids.select("sql_id").distinct().join(_eligible(pairs, accounts).select("sql_id"), "sql_id", "left_semi")


def sql_text_for(ids: DataFrame, stmt_stats: DataFrame) -> DataFrame:
    """One text per id; ``found`` is false where there is none."""
    texts = stmt_stats.filter("sql_text is not null").groupBy("sql_id").agg(F.min("sql_text").alias("sql_text"))
    return (
        ids.select("sql_id")
        .distinct()
        .join(texts, "sql_id", "left")
        .withColumn("found", F.col("sql_text").isNotNull())
    )


def preferred_plan(plan_rows: DataFrame, formats: Sequence[str] = PLAN_FORMATS) -> DataFrame:
    """Per id the lines of the first format that has a usable plan.

    ``plan_rows(sql_id, format, line_no, line)`` with lines from 1.  A plan is
    not usable when one of its first ten lines says that it cannot be fetched.
    The choice is made on one small row per id and format; lines are only
    joined to it, never collected.
    """
    priority = F.array_position(F.array(*[F.lit(f) for f in formats]), F.col("format"))
    usable = (
        plan_rows.groupBy("sql_id", "format")
        .agg(F.max((F.col("line_no") <= 10) & F.col("line").contains(PLAN_MISSING)).alias("missing"))
        .filter((~F.col("missing")) & (priority > 0))
        .groupBy("sql_id")
        .agg(F.min_by("format", priority).alias("format"))
    )
    return plan_rows.join(usable, ["sql_id", "format"])


def target_ids(docs: DataFrame, traces: DataFrame) -> DataFrame:
    """Distinct ids of both sources."""
    both = docs.select("sql_id").union(traces.select("sql_id"))
    return both.filter("sql_id is not null and sql_id <> ''").distinct()


def run_summary(results: DataFrame) -> DataFrame:
    """Counts of all and of collected results; ``collected_rows`` keeps the rows."""
    return results.agg(
        F.count("*").alias("detected"), F.count_if(F.col("status") == "collected").alias("collected")
    )


def collected_rows(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "collected")


def cover_kpis(
    docs: DataFrame, detected: DataFrame, tkprof: DataFrame, traces: DataFrame, trace_issues: DataFrame
) -> DataFrame:
    """Six counts of the cover page; the last two raise an alert when not 0.

    ``tkprof`` holds the documents of reports; the parts of one count once.
    """
    frames = (
        (1, "awr_sql", docs.agg(F.count("*").alias("count")), None),
        (2, "detected_sql", detected.agg(F.count("*").alias("count")), None),
        (3, "tkprof_docs", tkprof.agg(F.count_distinct("tkprof_file").alias("count")), None),
        (4, "trace_docs", traces.agg(F.count("*").alias("count")), None),
        (5, "high_elapsed", high_elapsed_count(docs).withColumnRenamed("high_elapsed", "count"), "danger"),
        (6, "trace_issues", trace_issues.agg(F.count("*").alias("count")), "warn"),
    )
    out = None
    for no, item, frame, alert in frames:
        flag = F.when(F.col("count") > 0, F.lit(alert)) if alert else F.lit(None)
        row = frame.select(
            F.lit(no).cast("bigint").alias("item_no"),
            F.lit(item).alias("item"),
            F.col("count").cast("bigint").alias("count"),
            F.coalesce(flag, F.lit("none")).alias("alert"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def first_stats() -> dict[str, Column]:
    """Figures of the first statistics element as doubles, 0 when missing."""
    first = F.try_element_at("stats", F.lit(1))
    return {
        "elapsed": F.coalesce(first["avg_elapsed_sec"].cast("double"), F.lit(0.0)),
        "gets": parse_num(first["avg_buffer_gets"]),
        "reads": parse_num(first["avg_disk_reads"]),
        "rows": parse_num(first["avg_rows"]),
    }
