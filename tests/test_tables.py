"""Detection, snapshots, documents, text functions and streams on small tables."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slowlens.functions import text as t
from slowlens.operators import detect as d, planrules, snapshots as s
from slowlens.sinks import documents as k
from slowlens.sources import documents as docs, files
from slowlens.session import scratch_path
from slowlens.streaming import jobs

T0 = datetime(2024, 1, 1)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


# --- detection ---------------------------------------------------------------


def test_detection_limits_are_strict(spark):
    schema = "sql_id string, sql_text string, elapsed_time bigint, cpu_time bigint, executions bigint, buffer_gets bigint, parse_calls bigint, first_load_time string"
    rows = [("a", "", 5_000_000, 0, 11, 0, 0, ""), ("b", "", 5_000_001, 0, 10, 0, 0, ""), ("c", "", 5_000_001, 0, 11, 0, 0, "")]
    assert [r.sql_id for r in d.detect_slow_sql(spark.createDataFrame(rows, schema)).collect()] == ["c"]


def test_threshold_limits_are_inclusive(spark):
    schema = "sql_id string, elapsed_sec_per_exec double, buffer_gets_per_exec bigint, disk_reads_per_exec bigint"
    rows = [("a", 2.99, 99_999, 9_999), ("b", 3.0, 0, 0), ("c", 0.0, 100_000, 10_000), ("d", None, None, 10_000)]
    found = d.detect_over_thresholds(spark.createDataFrame(rows, schema)).orderBy("sql_id").collect()
    assert [(r.sql_id, r.reasons) for r in found] == [("b", ["elapsed"]), ("c", ["buffer_gets", "disk_reads"]), ("d", ["disk_reads"])]


def test_exclusions(spark):
    schema = "sql_id string, parsing_schema_name string, sql_text string, last_active_time timestamp"
    rows = [
        ("user", "SYS", "select 1", T0),
        ("view", "APP", "SELECT x FROM V$SQL", T0),
        ("own", "APP", "/* run tuning_auto*/ select 1", T0),
        ("pack", "APP", "begin DBMS_STATS.x", T0),
        ("old", "APP", "select 1", T0 - timedelta(minutes=1441)),
        ("edge", "APP", "select 1", T0 - timedelta(minutes=1440)),
        ("null", None, "select 1", T0),
    ]
    found = d.exclude_statements(spark.createDataFrame(rows, schema), now=T0)
    assert [r.sql_id for r in found.orderBy("sql_id").collect()] == ["edge", "null"]


def test_both_spellings(spark):
    rows = [("a", None, 12.0, None, "U1"), ("b", 4.0, None, "U2", None)]
    schema = "sql_id string, elapsed_sec_per_exec double, elapsed_time_per_exec double, parsing_schema_name string, parsing_user string"
    df = spark.createDataFrame(rows, schema).selectExpr(
        "*", "1 plan_hash_value", "'m' module", "1 buffer_gets_per_exec", "1 disk_reads_per_exec", "1 executions", "'x' detected_at"
    )
    found = d.detected_report(df).orderBy("sql_id").collect()
    assert [(r.elapsed_sec_per_exec, r.parsing_schema_name, r.band) for r in found] == [(12.0, "U1", "danger"), (4.0, "U2", "warn")]


# --- snapshots ----------------------------------------------------------------


def snapshot_frames(spark, values):
    snaps = [(1, 1, i, T0 + timedelta(hours=i), T0 + timedelta(hours=i + 1)) for i in range(10)]
    snapshot = spark.createDataFrame(snaps, "dbid bigint, instance_number bigint, snap_id bigint, begin_interval_time timestamp, end_interval_time timestamp")
    stats = spark.createDataFrame([(1, 1, i, "DB time", v) for i, v in values], "dbid bigint, instance_number bigint, snap_id bigint, stat_name string, value bigint")
    return stats, snapshot


@pytest.mark.parametrize(
    "values, start, end, expected",
    [
        ([(0, 0), (1, 5_000_000), (2, 9_000_000)], 0, 10, 9.0),
        ([(0, 0), (2, 5_000_000), (3, 6_000_000)], 0, 10, 1.0),
        ([(0, 0), (1, 5_000_000), (2, 9_000_000)], 1, 10, 4.0),
        ([(0, 0), (1, 5_000_000), (2, 9_000_000)], 0, 2, 5.0),
        ([(0, 7)], 0, 10, 0.0),
    ],
)
def test_db_time(spark, values, start, end, expected):
    stats, snapshot = snapshot_frames(spark, values)
    got = s.db_time(stats, snapshot, T0 + timedelta(hours=start), T0 + timedelta(hours=end))
    assert got.first().db_time_sec == expected


def test_top_sql_groups_by_text_over_databases(spark):
    schema = (
        "dbid bigint, instance_number bigint, snap_id bigint, sql_id string, plan_hash_value bigint, parsing_schema_name string,"
        "executions_delta bigint, elapsed_time_delta bigint, buffer_gets_delta bigint, disk_reads_delta bigint, cpu_time_delta bigint,"
        "rows_processed_delta bigint, iowait_delta bigint"
    )
    base = lambda db, sql, n, us: (db, 1, 1, sql, 1, "APP", n, us, 10, 1, 1, 1, 1)
    stat = spark.createDataFrame(
        [base(1, "same", 1, 1_000_000), base(2, "same", 1, 2_000_000), base(1, "other", 0, 4_000_000), base(2, "other", 3, 5_000_000),
         base(1, "none", 2, 1_005_000)], schema
    )
    _, snapshot = snapshot_frames(spark, [(0, 0)])
    both = snapshot.union(snapshot.withColumn("dbid", F.lit(2)))
    long = "x" * 4000
    texts = spark.createDataFrame(
        [(1, "same", long + "1"), (2, "same", long + "2"), (1, "other", "a"), (2, "other", "b")], "dbid bigint, sql_id string, sql_text string"
    )
    found = s.top_sql(stat, both, texts, T0, T0 + timedelta(days=1)).collect()
    got = sorted((r.sql_id, r.sql_text, r.elapsed_sec, r.elapsed_per_exec) for r in found if r.sql_text)
    assert got == [("other", "a", 4.0, 4.0), ("other", "b", 5.0, 1.667), ("same", long, 3.0, 1.5)]
    none = [r for r in found if r.sql_text is None]
    assert [(r.sql_id, r.elapsed_sec, r.elapsed_per_exec) for r in none] == [("none", 1.01, 0.503)]


def test_counter_folders_are_pruned(spark, tmp_path):
    _, snapshot = snapshot_frames(spark, [(0, 0)])
    stat = snapshot.select("dbid", "instance_number", "snap_id", F.lit("a").alias("sql_id"), F.lit(1).alias("n"))
    wide = stat.union(stat.withColumn("snap_id", F.col("snap_id") + 1000))
    k.write_sqlstat(wide, str(tmp_path / "sqlstat"))
    back = spark.read.parquet(str(tmp_path / "sqlstat"))
    found = s.in_window(back, snapshot, T0, T0 + timedelta(hours=3))
    assert found.count() == 3
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_report_window():
    assert s.report_window("daily", datetime(2024, 5, 2, 7)) == (datetime(2024, 5, 2), datetime(2024, 5, 2, 23, 59, 59))
    assert s.report_window("weekly", datetime(2024, 5, 8)) == (datetime(2024, 5, 1), datetime(2024, 5, 8))


# --- documents -----------------------------------------------------------------


def test_bad_documents_are_set_apart(spark, tmp_path):
    (tmp_path / "a_awr_1.json").write_text(json.dumps({"sql_id": "a", "plan": ["x"], "stats": [{"avg_elapsed_sec": 2}]}, indent=2))
    (tmp_path / "b_awr_1.json").write_text("{ not json")
    (tmp_path / "c.json").write_text("{}")
    found = docs.read_awr_docs(spark, str(tmp_path))
    assert [r.sql_id for r in found.docs.collect()] == ["a"]
    assert found.docs.count() == 1 and found.rejects.count() == 1
    assert [(r.file, r.content) for r in found.rejects.collect()] == [("b_awr_1.json", "{ not json")]
    assert s.awr_stats_report(found.docs).first().band == "warn"
    single = docs.read_awr_docs(spark, str(tmp_path / "c.json"), glob=None)
    assert single.docs.count() == 1
    assert docs.read_awr_docs(spark, str(tmp_path / "a_*.json"), glob=None).docs.first().sql_id == "a"


def test_detections_carry_their_time(spark, tmp_path):
    (tmp_path / "detected_1.json").write_text(json.dumps({"detected_at": "t1", "sql_list": [{"sql_id": "a", "parsing_user": "U"}]}))
    (tmp_path / "detected_2.json").write_text(json.dumps({"detected_at": "t2"}))
    rows = docs.read_detections(spark, str(tmp_path)).docs.collect()
    assert [(r.sql_id, r.detected_at, r.parsing_user) for r in rows] == [("a", "t1", "U")]


def test_a_large_run_is_written_in_parts(spark):
    rows = spark.range(2500).select(F.lit("t").alias("detected_at"), F.col("id").cast("string").alias("sql_id"))
    sizes = [len(r.sql_list) for r in k.detection_docs(rows, rows_per_doc=100).collect()]
    assert sum(sizes) == 2500 and len(sizes) > 10


@pytest.mark.parametrize(
    "elapsed, gets, expected",
    [
        (3.0, "100,000", [("nothing_found", "GOOD")]),
        (3.1, "100001", [("elapsed", "MEDIUM"), ("buffer_gets", "MEDIUM"), ("gets_per_row", "MEDIUM")]),
        (10.1, "1.1M", [("elapsed", "HIGH"), ("buffer_gets", "HIGH"), ("gets_per_row", "MEDIUM")]),
    ],
)
def test_tuning_limits(spark, elapsed, gets, expected):
    stats = [{"avg_elapsed_sec": elapsed, "avg_buffer_gets": gets, "avg_rows": "1000"}, {"avg_elapsed_sec": 99.0}]
    df = spark.createDataFrame([("a", ["x"], stats)], "sql_id string, plan array<string>, stats array<struct<avg_elapsed_sec:double,avg_buffer_gets:string,avg_disk_reads:string,avg_rows:string>>")
    found = [(r.type, r.severity) for r in planrules.tuning_guide(df).orderBy("point_no").collect()]
    assert found == expected


# --- text functions ---------------------------------------------------------------


@pytest.mark.parametrize(
    "value, expected",
    [("1,234", 1234.0), ("12K", 12e3), ("1.5M", 1.5e6), (" 2G ", 2e9), ("", 0.0), (None, 0.0), ("K", 0.0), ("3k", 0.0), ("-1", -1.0)],
)
def test_parse_num(spark, value, expected):
    assert one(spark, t.parse_num(F.lit(value).cast("string"))) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("/a/b/c.tar.gz", "c.tar"), ("plain", "plain"), (".hidden", ".hidden"), ("x\\y.trc", "y")],
)
def test_split_stem(spark, value, expected):
    assert one(spark, t.split_stem(F.lit(value))) == expected


def test_plan_text(spark):
    plan = F.array(F.lit("ab"), F.lit(" -- "), F.lit(""), F.lit("abcdef"))
    assert one(spark, t.plan_text(plan)) == "ab\n------\n\nabcdef"
    assert one(spark, t.plan_text(F.array(F.lit(""), F.lit(" ")))) == "\n "


def test_literals(spark):
    sql = spark.createDataFrame([("a", "x = :b1 and y = :B10 and t = :T and z = :gone"), ("b", "q = :v")], "sql_id string, sql_text string")
    binds = spark.createDataFrame(
        [("a", 1, "B1", "NUMBER", "7"), ("a", 2, ":b10", "VARCHAR2(3)", "o'x\\1$0"), ("a", 3, ":t", "DATE", "10:20:30"), ("a", 4, "", "NUMBER", "1")],
        "sql_id string, position int, name string, datatype_string string, value_string string",
    )
    got = {r.sql_id: r.literal_sql for r in t.literalise(sql, binds).collect()}
    assert got == {"a": "x = 7 and y = 'o''x\\1$0' and t = '10:20:30' and z = 'DUMMY'", "b": "q = 'DUMMY'"}


def test_expiry_counts_whole_days(spark):
    now = datetime(2024, 3, 1)
    rows = [("traces", "a.trc", now - timedelta(days=31)), ("traces", "b.trc", now - timedelta(days=30, hours=23)), ("reports", "c.html", now - timedelta(days=90))]
    found = files.expired_files(spark.createDataFrame(rows, "dir string, file_name string, mtime timestamp"), now)
    assert [r.file_name for r in found.collect()] == ["a.trc"]


# --- streams ---------------------------------------------------------------------


def test_stream_dedup_agrees_with_the_batch_ledger(spark, tmp_path):
    """Arrivals in order, with one that moves the watermark on before keys return."""
    schema = "sql_id string, plan_hash_value bigint, ts timestamp, elapsed_sec_per_exec double"
    source = str(tmp_path / "in")
    batches = [[("a", 1, 0), ("b", None, 0)], [("a", 1, 10), ("c", 1, 10)], [("z", 1, 55)], [("a", 1, 60), ("b", None, 60), ("z", 1, 60)]]
    frames = [
        spark.createDataFrame([(i, p, T0 + timedelta(hours=h), 1.0) for i, p, h in rows], schema) for rows in batches
    ]
    ledger = frames[0].limit(0).selectExpr("sql_id", "string(plan_hash_value) plan_hash_value", "ts collected_at", "elapsed_sec_per_exec")
    expected = []
    for frame in frames:
        now = frame.first().ts
        new = d.dedup_recent(frame, ledger, now)
        expected += [(r.sql_id, r.ts) for r in new.collect()]
        ledger = spark.createDataFrame(d.append_ledger(new, ledger, now).collect(), ledger.schema)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        jobs.run_available(jobs.stream_dedup(spark.readStream.schema(schema).parquet(source)), out, checkpoint)
    got = [(r.sql_id, r.ts) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(expected)


def test_new_texts_are_read_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    for i in range(2):
        (source / f"10053_x{i}_1.trc").write_text(f"Access path analysis for T{i}\r\n  Access Path: A\r\n")
        jobs.run_available(jobs.stream_new_traces(spark, str(source)), out, checkpoint)
    lines = spark.read.parquet(out)
    assert lines.filter("kind = 'marker'").count() == 2


def test_large_texts_are_not_skipped(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    (source / "10053_big_1.trc").write_bytes(b"Access path analysis for T1\r\n  Access\xff Path: A\r\n" * 50)
    (source / "10053_small_1.trc").write_bytes(b"Access path analysis for T1\n")
    jobs.run_available(jobs.stream_new_traces(spark, str(source)), out, checkpoint)
    counts = spark.read.parquet(out).groupBy("file").count().collect()
    assert {r["file"].rsplit("/", 1)[1] for r in counts} == {"10053_big_1.trc", "10053_small_1.trc"}


def test_scratch_needs_a_shared_folder(spark):
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        conf = Conf({"spark.master": "spark://host:1", "spark.sql.warehouse.dir": "file:/tmp/w"})

    with pytest.raises(ValueError):
        scratch_path(Session, "x")
    Session.conf["spark.master"] = "local[2]"
    assert scratch_path(Session, "x").startswith("file:/tmp/w/x-")
    Session.conf["spark.checkpoint.dir"] = "s3a://shared/c/"
    assert scratch_path(Session, "x").startswith("s3a://shared/c/x-")

