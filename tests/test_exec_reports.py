"""Execution reports on hand-written blocks, and rule limits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from slowlens.operators import execreport as e, execrules as r
from slowlens.sinks.documents import tkprof_docs
from slowlens.sources.texts import texts_of

HEAD = "call     count       cpu    elapsed       disk      query    current        rows"


def report(spark, text):
    return texts_of(spark.createDataFrame([("a_x.prf", text)], "file string, text string"))


def statements(spark, text):
    return e.exec_statements(e.exec_blocks(report(spark, text)))


def block(sql="select 1 from a_table", fetch="Fetch 1 0.01 0.02 1 2 3 4", total="total 3 0.01 0.02 1 2 3 4", tail=""):
    return f"{sql}\n\n{HEAD}\n------- ------\nParse 1 0.00 0.00 0 0 0 0\nExecute 1 0.00 0.00 0 0 0 0\n{fetch}\n{total}\n{tail}"


def test_blocks_are_cut_at_ten_stars(spark):
    long = "x" * 50
    text = f"{long}\n{'*' * 9}\n{'*' * 10}\n  {long}  \n{'*' * 85}short{'*' * 20}{long}"
    got = [(b.block_no, b.block) for b in e.exec_blocks(report(spark, text)).orderBy("block_no").collect()]
    assert got == [(0, f"{long}\n{'*' * 9}"), (1, long), (3, long)]


@pytest.mark.parametrize(
    "text, kept",
    [
        (block(), 1),
        (block(total="total 3 0.00 0.00 1 2 3 4"), 0),
        (block(total="no total row here"), 0),
        (block(sql="sql_id='abc'"), 0),
        (block().replace(HEAD, "CALL COUNT x"), 1),
        ("select without any table of calls, but long enough to stay a block", 0),
    ],
)
def test_what_a_statement_is(spark, text, kept):
    assert statements(spark, text).count() == kept


def test_last_id_and_last_phase_row_win(spark):
    text = block(sql="sql_id='a1'\nselect 1\nx sql_id='b2' y\nfrom t", fetch="Fetch 1 0.1 0.1 1 1 1 1\nfetch 9 0.2 0.30 2 3 4 5 rest")
    row = statements(spark, text).first()
    assert (row.sql_id, row.sql_text) == ("b2", "select 1\nfrom t")
    assert (row.fetch_count, float(row.fetch_elapsed), row.fetch_rows) == (9, 0.3, 5)


def test_phase_rows_count_only_near_the_header(spark):
    far = block(total="\n" * 12 + "total 3 0.01 0.02 1 2 3 4")
    assert statements(spark, far).count() == 0


def test_sql_text_holds_all_lines_before_the_header(spark):
    text = block(sql="select :b\nBINDS #1:\n bind 0: \n  value=1\nWAIT #1: end")
    row = statements(spark, text).first()
    assert row.sql_text == "select :b\nBINDS #1:\n bind 0: \n  value=1\nWAIT #1: end"
    assert [(b.position, b.value) for b in row.bind_variables] == [(1, "1")]


def test_plan_and_waits_stop_at_blank_lines(spark):
    tail = (
        "\nRows     Execution Plan\n   5  SORT   \n  6   TABLE ACCESS FULL T1\nElapsed time\n"
        "\nEvent waited on   Times\n------\nlog file sync  3  0.5\n  db file x  4  1.25 2.0\nno numbers\n\nlater 1 1"
    )
    row = statements(spark, block(tail=tail)).first()
    assert row.execution_plan == ["   5  SORT", "  6   TABLE ACCESS FULL T1"]
    assert [tuple(w) for w in row.wait_events] == [("log file sync", 3, 0.5), ("db file x", 4, 1.25)]


def test_binds(spark):
    tail = (
        "\nBINDS #1:\n bind 0: \n  dty=1\n  value=a\n  value=  b \n BIND 2: value=inline\n  DTY=999\n"
        "EXEC #1:\n  value=closed\nBINDS #2:\n  dty=2\n bind 0:\n"
        "BINDS #3:\n bind 4:\n  value=5"
    )
    row = statements(spark, block(tail=tail)).first()
    assert [tuple(b) for b in row.bind_variables] == [
        (1, "VARCHAR2", "b"),
        (3, "TYPE(999)", None),
        (None, "NUMBER", None),
        (1, None, None),
        (5, None, "5"),
    ]


@pytest.mark.parametrize(
    "plan_rows, found", [(9999, None), (10000, "MEDIUM"), (100000, "MEDIUM"), (100001, "HIGH")]
)
def test_full_scan_limits(spark, plan_rows, found):
    tail = f"\nRows     Row Source Operation\n  {plan_rows}   TABLE ACCESS (cr=1) FULL EMP (x)\n"
    got = r.exec_issues(statements(spark, block(tail=tail))).filter("rule_no = 1").collect()
    assert [(i.severity, i.subject) for i in got] == ([(found, "EMP")] if found else [])


@pytest.mark.parametrize("rows, found", [(99999, 0), (100000, 1)])
def test_nested_loop_limit(spark, rows, found):
    tail = f"\nRows     Row Source Operation\n  {rows}   NESTED LOOPS OUTER\n"
    assert r.exec_issues(statements(spark, block(tail=tail))).filter("rule_no = 2").count() == found


@pytest.mark.parametrize(
    "total, rule_no, found",
    [
        ("total 3 0.01 0.02 0 390 10 4", 3, []),
        ("total 3 0.01 0.02 0 391 10 4", 3, ["MEDIUM"]),
        ("total 3 0.01 0.02 30 90 10 4", 5, []),
        ("total 3 0.01 0.02 31 90 10 4", 5, ["LOW"]),
        ("total 3 0.01 0.02 50 90 10 4", 5, ["MEDIUM"]),
    ],
)
def test_ratio_limits(spark, total, rule_no, found):
    issues = r.exec_issues(statements(spark, block(total=total))).filter(F.col("rule_no") == rule_no)
    assert [i.severity for i in issues.collect()] == found


@pytest.mark.parametrize(
    "event, times, found",
    [
        ("db file sequential read", 1000, []),
        ("DB File Sequential Read", 1001, [6]),
        ("db file scattered read", 100, []),
        ("db file scattered read", 101, [7]),
    ],
)
def test_wait_limits(spark, event, times, found):
    tail = f"\nEvent waited on   Times\n------\n{event}  {times}  0.5\n"
    issues = r.exec_issues(statements(spark, block(tail=tail))).filter("rule_no >= 6")
    assert [i.rule_no for i in issues.collect()] == found


def test_documents_are_counted_without_issues(spark):
    """Statements whose issues were not looked for give the same documents, without them."""
    found = statements(spark, block() + "*" * 80 + "\n" + block())
    plain, full = tkprof_docs(found), tkprof_docs(r.with_issues(found))
    assert plain.schema.simpleString() == full.schema.simpleString()
    [doc] = plain.collect()
    assert [s["issues"] for s in doc.tkprof_statements] == [None, None]
    assert [d.tkprof_file for d in full.collect()] == [doc.tkprof_file]
