"""Streams over several batches and restarts, against batch runs."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from slowlens.config import DEFAULTS
from slowlens.operators import detect as d, opttrace as o, optrules
from slowlens.plans import render
from slowlens.sinks import ledger as led
from slowlens.sinks.documents import write_packs
from slowlens.sources import texts as t
from slowlens.streaming import jobs

T0 = datetime(2024, 3, 1)
ROW = "sql_id string, plan_hash_value bigint, ts timestamp, elapsed_sec_per_exec double"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def runs(seed=3, n=8):
    """Detection runs at falling and rising distances; keys return, two of them twice in a run."""
    r = random.Random(seed)
    out, hour = [], 0
    for _ in range(n):
        hour += r.choice([3, 9, 13, 24, 25])
        keys = r.sample([("a", 1), ("a", 2), ("b", None), ("c", 7), ("d", 0)], r.randint(2, 5))
        out.append([(i, p, T0 + timedelta(hours=hour), float(hour)) for i, p in keys + keys[:1]])
    return out


def collected(batches, hours=24):
    """What the batch ledger lets through, run by run."""
    last, out = {}, []
    for batch in batches:
        now = batch[0][2]
        new = [b for b in batch if not (k := last.get((b[0], b[1] or 0))) or k < now - timedelta(hours=hours)]
        out += new
        last |= {(b[0], b[1] or 0): now for b in new}
    return out


def test_the_plain_ledger_is_the_batch_ledger(spark):
    empty = spark.createDataFrame([], "sql_id string, plan_hash_value string, collected_at timestamp, elapsed_sec_per_exec double")
    ledger, out = empty, []
    for batch in runs():
        new = d.dedup_recent(spark.createDataFrame(batch, ROW), ledger, batch[0][2])
        out += [tuple(r) for r in new.select("sql_id", "plan_hash_value", "ts", "elapsed_sec_per_exec").collect()]
        ledger = spark.createDataFrame(d.append_ledger(new, ledger, batch[0][2]).collect(), empty.schema)
    assert sorted(out, key=str) == sorted(collected(runs()), key=str)


@pytest.mark.parametrize("restart", [False, True])
def test_collection_state_is_renewed(spark, tmp_path, restart):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    stream = lambda: jobs.stream_collect(spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source), late="30 hours")
    for batch in runs():
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(source)
        if restart:
            jobs.run_available(stream(), out, checkpoint)
    jobs.run_available(stream(), out, checkpoint)
    found = spark.read.parquet(out).select("sql_id", "plan_hash_value", "ts", "elapsed_sec_per_exec").collect()
    assert sorted(map(tuple, found), key=str) == sorted(collected(runs()), key=str)


def test_rows_out_of_order_are_within_the_period_of_the_later_ones(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for hours in ((30,), (10, 55), (54, 80)):  # 10 and 54 come after a later collection
        data = [("a", 1, T0 + timedelta(hours=h), 1.0) for h in hours]
        spark.createDataFrame(data, ROW).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROW).parquet(source)
        jobs.run_available(jobs.stream_collect(stream, late="48 hours"), out, checkpoint)
    assert sorted(r.ts.hour + 24 * (r.ts.day - 1) for r in spark.read.parquet(out).collect()) == [30, 55, 80]


def test_keys_of_a_bucket_are_collected_apart(spark, tmp_path):
    """Five keys in two states, null keys among them: rows as by the batch ledger."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    batches = [[(None if i == "d" else i, *rest) for i, *rest in batch] for batch in runs(seed=5)]
    for batch in batches:
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        jobs.stream_collect(stream, late="30 hours", buckets=2)
        .writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 2
    found = spark.read.parquet(out).select("sql_id", "plan_hash_value", "ts", "elapsed_sec_per_exec").collect()
    assert sorted(map(tuple, found), key=str) == sorted(collected(batches), key=str)


def test_collection_by_the_keyed_ledger_survives_a_replay(spark, tmp_path):
    source, out, checkpoint, ledger = (str(tmp_path / n) for n in ("in", "out", "checkpoint", "ledger"))
    for k, batch in enumerate(runs()):
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(source)
        jobs.run_collection(spark.readStream.schema(ROW).parquet(source), ledger, out, checkpoint)
        if k == 3:  # a batch that is done again: its rows and its marks are already there
            rows_again = spark.createDataFrame(batch, ROW)
            before = rows(spark.read.parquet(out)), rows(led.read_ledger(spark, ledger))
            led.upsert_ledger(spark.read.schema(ROW).parquet(f"{out}/batch_id={k}"), ledger, batch[0][2])
            assert led.not_in_ledger(rows_again, ledger, batch[0][2]).count() == 0
            assert (rows(spark.read.parquet(out)), rows(led.read_ledger(spark, ledger))) == before
    found = spark.read.parquet(out).select("sql_id", "plan_hash_value", "ts", "elapsed_sec_per_exec").collect()
    assert sorted(map(tuple, found), key=str) == sorted(collected(runs()), key=str)
    entries = led.read_ledger(spark, ledger)
    assert entries.count() == entries.select("sql_id", "plan_hash_value").distinct().count() <= 5


def test_the_ledger_holds_keys_and_touches_their_folders(spark, tmp_path):
    path = str(tmp_path / "ledger")
    many = spark.range(3000).selectExpr("concat('k', id % 30) sql_id", "id % 2 plan_hash_value", "double(id) elapsed_sec_per_exec")
    led.upsert_ledger(many, path, T0, folders=16)
    entries = led.read_ledger(spark, path)
    assert entries.count() == 30 and entries.agg(F.max("elapsed_sec_per_exec")).first()[0] == 2999.0
    one = spark.createDataFrame([("k3", 1, 5.0), ("new", None, 6.0)], "sql_id string, plan_hash_value bigint, elapsed_sec_per_exec double")
    left = led.not_in_ledger(one, path, T0 + timedelta(hours=1))
    assert [r.sql_id for r in left.collect()] == ["new"]
    files = {f for f in left.inputFiles() if "/data/" in f}
    assert len({f.split("/folder=")[1].split("/")[0] for f in files}) <= 2
    before = led._index(spark, path)[1]
    led.upsert_ledger(one, path, T0 + timedelta(hours=30))
    after = led._index(spark, path)[1]
    assert sum(before.get(f) != g for f, g in after.items()) <= 2
    newest = {r.sql_id: r.collected_at for r in led.read_ledger(spark, path).filter("sql_id in ('k3', 'new')").collect()}
    assert newest == {"k3": T0 + timedelta(hours=30), "new": T0 + timedelta(hours=30)}


def test_ranks_of_batches_survive_restarts_and_replays(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    schema = "sql_id string, ts timestamp, executions bigint, buffer_gets_per_exec bigint, elapsed_sec_per_exec double"
    r = random.Random(4)
    everything = []
    for day in range(5):
        data = [(f"s{r.randrange(9)}", T0 + timedelta(days=day, hours=r.randrange(24)), 1, r.randrange(1000), 1.0) for _ in range(60)]
        everything += data
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.run_period_top(jobs.stream_daily_rollup(stream), out, checkpoint, n=3)
    found = spark.read.parquet(out).select("period_start", "sql_id", "buffer_gets", "rank")
    batch = spark.createDataFrame(everything, schema).groupBy(F.date_trunc("day", "ts").alias("period_start"), "sql_id").agg(F.sum("buffer_gets_per_exec").alias("buffer_gets"))
    wanted = jobs.period_top(batch.filter(F.col("period_start") < F.lit(T0 + timedelta(days=4))), 3)
    assert rows(found) == rows(wanted.select(*found.columns)) and found.count() == 12
    last = max(int(f.split("batch_id=")[1].split("/")[0]) for f in spark.read.parquet(out).inputFiles())
    again = spark.read.parquet(f"{out}/batch_id={last}").drop("rank").collect()
    spark.createDataFrame(again, "period_start timestamp, sql_id string, samples bigint, executions bigint, buffer_gets bigint, max_elapsed_sec double").createOrReplaceTempView("again")
    jobs.period_top(spark.table("again"), 3).write.mode("overwrite").parquet(f"{out}/batch_id={last}")
    assert rows(spark.read.parquet(out).select(*found.columns)) == rows(wanted.select(*found.columns))


def test_traces_of_a_stream_equal_those_of_the_batch_reader(spark, sf_dir, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    source.mkdir()
    settings = replace(DEFAULTS, whole_file_bytes=6000, slice_lines=40)
    texts = [r.text for r in render.trace_texts(spark, sf_dir).orderBy("file").limit(9).collect()]
    texts[4] *= 3  # too large to be read whole
    for i in range(0, 9, 3):
        for k in range(i, i + 3):
            (source / f"10053_t{k}_1.trc").write_text(texts[k])
        jobs.run_trace_facts(spark, str(source), out, checkpoint, settings=settings, per_batch=2)
    batch = o.trace_facts(t.read_traces(spark, str(source), settings=settings), settings)
    assert t.read_traces(spark, str(source), settings=settings).long_lines is not None
    found = spark.read.parquet(f"{out}/facts")
    columns = [c for c in batch.columns if c != "kind"] + ["kind"]
    assert rows(found.select(*columns)) == rows(batch.select(*columns))
    issues = optrules.trace_issues(batch)
    assert rows(spark.read.parquet(f"{out}/issues").select(*issues.columns)) == rows(issues)
    assert found.select("batch_id").distinct().count() >= 5


def test_candidate_lines_of_a_batch_are_looked_for_once(spark, sf_dir, tmp_path, monkeypatch):
    """Facts of large traces come from written candidates, and a stream that is asked for some kinds writes these."""
    texts = render.trace_texts(spark, sf_dir).orderBy("file").limit(3)
    settings = replace(DEFAULTS, whole_file_bytes=100, slice_lines=40)
    write_packs(texts, str(tmp_path / "in"))
    traces = t.read_traces(spark, str(tmp_path / "in"), "*.txt", settings, packed=True)
    plan = o.trace_facts(traces, settings)._jdf.queryExecution().optimizedPlan().toString()
    assert "candidate-lines" in str(o.trace_facts(traces, settings).inputFiles()) and plan.count("Relation [value") == 1  # whole texts
    out = str(tmp_path / "out")
    key = t.folder_value(path=F.col("path"))
    jobs.run_trace_facts(spark, str(tmp_path / "in"), out, str(tmp_path / "checkpoint"), "*.txt", settings, file=key, packed=True, kinds=optrules.FACT_KINDS)
    batch = o.trace_facts(t.texts_of(texts))
    found = spark.read.parquet(f"{out}/facts")
    assert rows(found.select(*batch.columns)) == rows(batch.filter(F.col("kind").isin(*optrules.FACT_KINDS)).withColumn("section", F.lit(None).cast("string")))
    issues = optrules.trace_issues(batch)
    assert rows(spark.read.parquet(f"{out}/issues").select(*issues.columns)) == rows(issues)
