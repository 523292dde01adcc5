"""The report set: all tables of a run, published together."""

from __future__ import annotations

from dataclasses import replace
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import Observation, functions as F

from slowlens.config import DEFAULTS
from slowlens.operators import snapshots as s
from slowlens.operators.execlines import report_statements
from slowlens.operators.execrules import with_issues
from slowlens.plans import q_snapshots, render
from slowlens.plans.q_reports import workload
from slowlens.plans.views import view
from slowlens.sinks import documents as k, report_set
from slowlens.sinks.report_set import Inputs, read_report_set, write_report_set
from slowlens.sources import documents as docs, texts as t

DAY = date(2024, 5, 2)
FLEET = ("env_metric", "env_param", "instances", "databases", "targets")


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return Inputs(
        docs=render.awr_docs(spark, sf_dir),
        detections=view(spark, sf_dir, "detection"),
        reports=render.exec_reports(spark, sf_dir),
        traces=render.traces(spark, sf_dir),
        plan_rows=view(spark, sf_dir, "plan_rows"),
        workload=workload(spark, sf_dir),
        fleet={n: view(spark, sf_dir, n) for n in FLEET},
    )


@pytest.fixture(scope="module")
def published(spark, inputs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("set"))
    return path, write_report_set(spark, inputs, path, DAY)


def test_all_tables_are_there(spark, published):
    path, counts = published
    tables = read_report_set(spark, path, DAY)
    assert set(tables) == set(counts) and len(tables) == 32
    assert all(tables[name].count() == n for name, n in counts.items())
    assert min(n for name, n in counts.items() if name != "trace_system_environment") > 0


def test_a_second_run_gives_the_same_and_other_dates_stay(spark, inputs, published):
    path, _ = published
    before = {n: rows(df) for n, df in read_report_set(spark, path, DAY).items()}
    few = Inputs(plan_rows=inputs.plan_rows, fleet=inputs.fleet)
    write_report_set(spark, few, path, date(2024, 5, 3))
    write_report_set(spark, inputs, path, DAY)
    assert {n: rows(df) for n, df in read_report_set(spark, path, DAY).items()} == before
    assert set(read_report_set(spark, path, date(2024, 5, 3))) == {
        "cursor_plans", "memory", "hosts", "instance_parameters", "instances", "services", "cover",
    }


def test_a_run_that_fails_publishes_nothing(spark, inputs, published):
    path, _ = published
    bad = inputs.plan_rows.withColumn("line", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_report_set(spark, replace(inputs, plan_rows=bad, docs=None, reports=None, traces=None, workload=None), path, DAY)
    assert len(read_report_set(spark, path, DAY)) == 32


def test_texts_are_parsed_once(spark, sf_dir, monkeypatch):
    parsed = []
    for name in ("report_statements",):
        real = getattr(report_set, name)
        monkeypatch.setattr(report_set, name, lambda *a, real=real, name=name: parsed.append(name) or real(*a))
    real = report_set.o.trace_facts
    monkeypatch.setattr(report_set.o, "trace_facts", lambda *a: parsed.append("trace_facts") or real(*a))
    tables = report_set.all_tables(Inputs(reports=render.exec_reports(spark, sf_dir), traces=render.traces(spark, sf_dir)))
    assert sorted(parsed) == ["report_statements", "trace_facts"]
    for name, table in tables.items():  # nothing is made from text again
        plan = table.rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Access path analysis" not in plan or name in ("report_texts", "trace_summary"), name
        assert "FileScan" in table.rows._jdf.queryExecution().executedPlan().toString() or name in ("report_texts", "report_files"), name


def test_totals_take_one_scan_of_the_counters(spark, sf_dir, tmp_path):
    names = ("sqlstat", "snapshot", "sqltext")
    for name in names:
        view(spark, sf_dir, name).write.parquet(str(tmp_path / name))
    frames = [spark.read.parquet(str(tmp_path / n)) for n in names]
    seen = Observation("w")
    top = s.top_sql(*frames, q_snapshots.START, q_snapshots.END, observation=seen)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4 and plan.count("CollectMetrics") >= 1  # sqlstat, snapshot, 2 x sqltext
    assert rows(top) == rows(s.top_sql(*frames, q_snapshots.START, q_snapshots.END))
    wanted = s.sql_elapsed(frames[0], frames[1], q_snapshots.START, q_snapshots.END).first()[0]
    assert spark.range(1).select(s.elapsed_seconds(F.lit(Decimal(seen.get["elapsed"])))).first()[0] == wanted > 0


def test_documents_hold_texts_and_reports_without_statements(spark, tmp_path):
    call = "call count cpu elapsed disk query current rows\n------- ------\nFetch 1 0.01 0.02 1 2 3 4\ntotal 1 0.01 0.02 1 2 3 4\n"
    texts = {
        "a1_x.prf": "select 1 from t\nsql_id='a1'\n\n" + call,
        "none_y.prf": "a report without any statement at all, but with words",
        "big_w.prf": ("select 2 from u\n\n" + call + "*" * 80 + "\n") * 30 + "end",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    for settings in (DEFAULTS, replace(DEFAULTS, whole_file_bytes=1000, slice_lines=50)):
        reports = t.read_exec_reports(spark, str(tmp_path), settings=settings)
        found = k.tkprof_docs(with_issues(report_statements(reports, settings)), 10, reports, settings).collect()
        by = {}
        for d in sorted(found, key=lambda d: (d.tkprof_file, d.part)):
            by.setdefault(d.tkprof_file.rsplit("/", 1)[1], []).append(d)
        assert set(by) == set(texts)
        assert "\n".join(d.tkprof_full_text for d in by["big_w.prf"] if d.tkprof_full_text) == texts["big_w.prf"]
        assert sum(len(d.tkprof_statements) for d in by["big_w.prf"]) == 30
        assert [(d.sql_id, d.tkprof_full_text, d.sql_text, len(d.tkprof_statements)) for n in ("a1_x.prf", "none_y.prf") for d in by[n]] == [
            ("a1", texts["a1_x.prf"], "select 1 from t", 1), ("none_y", texts["none_y.prf"], "", 0)
        ]
        assert all(d.plan == [] and d.stats == [] for d in found)
    empty = t.texts_of(spark.createDataFrame([("empty_z.prf", "")], "file string, text string"))
    only = k.tkprof_docs(with_issues(report_statements(empty)), 10, empty).collect()
    assert [(d.sql_id, d.part, d.tkprof_full_text, d.tkprof_statements) for d in only] == [("empty_z", 0, "", [])]


def test_documents_read_the_texts_once(spark, tmp_path):
    """One pass gives the texts of all documents, empty ones too; another one the statements."""
    spark.createDataFrame([("a_x.prf", "some words"), ("b_y.prf", ""), ("c_z.prf", None)], "file string, text string").write.parquet(str(tmp_path / "t"))
    reports = t.texts_of(spark.read.parquet(str(tmp_path / "t")))
    docs = k.tkprof_docs(with_issues(report_statements(reports)), 10, reports)
    assert sorted((d.tkprof_file, d.part, d.tkprof_full_text) for d in docs.collect()) == [("a_x.prf", 0, "some words"), ("b_y.prf", 0, "")]
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_detection_parts_are_numbered_through(spark):
    data = spark.range(2500).select(F.when(F.col("id") < 2490, "hot").otherwise("small").alias("detected_at"), F.concat(F.lit("s"), F.col("id")).alias("sql_id"))
    found = k.detection_docs(data, rows_per_doc=100).collect()
    hot = [d for d in found if d.detected_at == "hot"]
    assert sorted(d.part for d in hot) == list(range(25)) and {d.parts for d in hot} == {25}
    assert [len(d.sql_list) for d in found if d.detected_at == "small"] == [10]
    assert len({s.sql_id for d in found for s in d.sql_list}) == 2500
    plan = k.detection_docs(data)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(detected_at#" not in "".join(x for x in plan.split("\n") if "sql_id" in x and "_bucket" not in x and "part#" not in x)
