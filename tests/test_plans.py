"""Shape of the physical plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from slowlens.operators import detect as d, execreport as e, execrules as r, opttrace as o, snapshots
from slowlens.plans import q_snapshots
from slowlens.plans.views import view
from slowlens.sources.texts import read_exec_reports, read_traces
from slowlens.streaming import jobs

QUERIES = entry_module.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["top_sql", "exec_issues", "access_methods", "tuning_guide", "literalise", "trace_rule_clustering_factor"])
def test_no_python_in_plans(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "EvalPython" not in text and "InPandas" not in text and "MapPartitions" not in text


@pytest.fixture
def text_dir(tmp_path):
    (tmp_path / "a.prf").write_text("x")
    (tmp_path / "10053_a_1.trc").write_text("x")
    return str(tmp_path)


def test_reports_are_parsed_without_a_shuffle(spark, text_dir):
    issues = r.exec_issues(e.exec_statements(e.exec_blocks(read_exec_reports(spark, text_dir))))
    assert "Exchange" not in plan(issues)


def test_trace_states_take_one_shuffle(spark, text_dir):
    methods = o.access_methods(o.trace_facts(read_traces(spark, text_dir)))
    assert plan(methods).count("Exchange hashpartitioning") == 1


def test_top_k_without_full_sort(spark, sf_dir):
    text = plan(d.detect_slow_sql(view(spark, sf_dir, "stmt_stats")))
    assert "TakeOrderedAndProject" in text


def test_detection_limits_reach_the_scan(spark, tmp_path):
    stats = spark.createDataFrame(
        [("a", "t", 1, 1, 1, 1, 1, "x", "unused")],
        "sql_id string, sql_text string, elapsed_time bigint, cpu_time bigint, executions bigint, buffer_gets bigint,"
        "parse_calls bigint, first_load_time string, wide string",
    )
    stats.write.parquet(str(tmp_path / "s"))
    text = plan(d.detect_slow_sql(spark.read.parquet(str(tmp_path / "s"))))
    assert "GreaterThan(elapsed_time,5000000)" in text and "GreaterThan(executions,10)" in text
    assert "wide" not in text


def test_counters_are_scanned_once_for_the_top_statements(spark, tmp_path, sf_dir):
    for name in ("sqlstat", "snapshot", "sqltext"):
        view(spark, sf_dir, name).write.parquet(str(tmp_path / name))
    frames = [spark.read.parquet(str(tmp_path / n)) for n in ("sqlstat", "snapshot", "sqltext")]
    text = plan(snapshots.top_sql(*frames, q_snapshots.START, q_snapshots.END))
    assert text.count("TakeOrderedAndProject") == 1
    assert text.count("elapsed_time_delta") > 0 and text.count("FileScan") == 4  # sqlstat, snapshot, 2 x sqltext
    assert "CartesianProduct" not in text
    assert "GreaterThanOrEqual(begin_interval_time" in text


def test_period_ranks_are_limited_before_the_shuffle(spark):
    rollup = spark.range(100).selectExpr("id % 3 period_start", "string(id) sql_id", "id buffer_gets")
    assert plan(jobs.period_top(rollup, 5)).count("WindowGroupLimit") == 2


def test_whole_traces_are_shuffled_as_texts_not_as_candidates(spark, text_dir):
    """Candidates come with two lines each, so that a shuffle of them moves the texts several times."""
    found = plan(o.trace_facts(read_traces(spark, text_dir)))
    assert found.count("Exchange hashpartitioning") == 1
    below = found.split("Exchange hashpartitioning", 1)[1]
    assert "Generate" not in below and "Generate" in found
