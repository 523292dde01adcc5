"""Text sources: line ends, undecodable bytes, large files, names."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from slowlens.config import DEFAULTS
from slowlens.operators import execlines as x, execreport as e, opttrace as o
from slowlens.operators.execrules import with_issues
from slowlens.plans import render
from slowlens.sinks.documents import write_texts
from slowlens.sources import texts as t

SMALL = replace(DEFAULTS, whole_file_bytes=500, slice_lines=7)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def trace_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("traces") / "out")
    write_texts(render.trace_texts(spark, sf_dir).orderBy("file").limit(12), path)
    return path


@pytest.fixture(scope="module")
def report_dir(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("reports") / "out")
    write_texts(render.exec_report_texts(spark, sf_dir).orderBy("file").limit(4), path)
    return path


@pytest.fixture
def tiny_splits(spark):
    """Files are cut into splits far smaller than they are."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_keep_their_names(spark, trace_dir):
    names = [r.file for r in t.text_files(t.read_traces(spark, trace_dir, "*.txt", file=t.folder_value())).collect()]
    assert len(set(names)) == 12 and all(n.startswith("10053_q") and n.endswith(".trc") for n in names)


def test_large_traces_equal_whole_traces(spark, trace_dir, tiny_splits):
    whole = t.read_traces(spark, trace_dir, "*.txt")
    split = t.read_traces(spark, trace_dir, "*.txt", SMALL)
    assert whole.long_lines is None
    assert split.texts.count() == 0
    assert rows(t.trace_lines(split)) == rows(t.trace_lines(whole))
    assert rows(o.trace_facts(split, SMALL)) == rows(o.trace_facts(whole))
    for extract in (o.trace_params, o.trace_index_stats, o.trace_column_stats, o.access_methods, o.best_access):
        assert rows(extract(o.trace_facts(split, SMALL))) == rows(extract(o.trace_facts(whole)))
    assert rows(o.trace_sql(split)) == rows(o.trace_sql(whole))
    assert rows(t.trace_content_check(split)) == rows(t.trace_content_check(whole))
    assert rows(t.text_files(split)) == rows(t.text_files(whole))


def test_large_reports_equal_whole_reports(spark, report_dir, tiny_splits):
    whole = e.exec_blocks(t.read_exec_reports(spark, report_dir, "*.txt"))
    split = e.exec_blocks(t.read_exec_reports(spark, report_dir, "*.txt", SMALL), SMALL)
    assert whole.count() == 400
    assert rows(split) == rows(whole)
    parts = e.exec_text_report(t.read_exec_reports(spark, report_dir, "*.txt", SMALL), SMALL)
    assert parts.filter("full_text is null").count() == 0
    assert parts.filter("parts > 1").select("file").distinct().count() == 4

    def texts(df):
        ordered = F.array_sort(F.collect_list(F.struct("part", "full_text")))
        return rows(df.groupBy("file", "line_count").agg(F.array_join(ordered["full_text"], "\n").alias("text")))

    assert texts(parts) == texts(e.exec_text_report(t.read_exec_reports(spark, report_dir, "*.txt")))


@pytest.mark.parametrize("slice_lines", [3, 7, 10**6])
def test_statements_of_large_reports_equal_whole_reports(spark, report_dir, tiny_splits, slice_lines):
    small = replace(SMALL, slice_lines=slice_lines)
    whole = x.report_statements(t.read_exec_reports(spark, report_dir, "*.txt"))
    split = x.report_statements(t.read_exec_reports(spark, report_dir, "*.txt", small), small)
    assert whole.count() > 300
    assert split.columns == whole.columns
    assert rows(split) == rows(whole)


def test_odd_blocks_by_lines_equal_whole_blocks(spark, tmp_path, tiny_splits):
    """One report without a star rule, and many with odd ones, by lines of a few to a slice."""
    head = "call     count       cpu    elapsed       disk      query    current        rows"
    total = "total 3 0.01 0.02 1 2 3 4"
    pool = [
        "select 1 from t", "  from u where a = :b  ", "", " \t ", "sql_id='a1b2'", "x sql_id='c3' y", head, "  " + head, "CALL count", "call",
        "Parse 1 0.00 0.00 0 0 0 0", "  Fetch 1 0.1 0.2 1 2 3 4", "fetch 9 0.2 0.30 2 3 4 5 rest", total, total, "total 1 0.00 0.00 1 1 1 1",
        "Rows     Row Source Operation", "Rows     Execution Plan", "  9  TABLE ACCESS FULL T1  ", "Elapsed time", "----",
        "Elapsed times include waiting on following events:", "Event waited on  Times", "  db file x  4  1.25 2.0", "log file sync  3  0.5",
        "BINDS #1:", "  BINDS#2:", " bind 0: ", " BIND 12: value=inline", "  dty=1", "  DTY=999", "  value=a ", "value=", "EXEC #1:", "WAIT  #2: x", "****",
        "*" * 12, "end of it " + "*" * 20 + "select 5 from dual " + "z" * 40,
    ]
    r = random.Random(5)
    for i in range(40):
        calls = ["select z from zebras", head, "------", "Fetch 1 0.1 0.2 1 2 3 4", total, ""]
        body = [line for _ in range(r.choice([1, 6, 25])) for line in [*r.choice([calls, calls, []]), *[r.choice(pool) for _ in range(r.randint(0, 14))]]]
        text = "\n".join([r.choice(["", " ", "select 7 from seven_tables where no_rule = 1"]), *body, r.choice(["", "last  ", total])])
        (tmp_path / f"odd{i}_x.prf").write_text(text)
    regular = ["select a from one_long_block", "sql_id='long1'", head, "----", "Fetch 1 0.1 0.2 1 2 3 4", total]
    (tmp_path / "long_x.prf").write_text("\n".join(regular + [r.choice([p for p in pool if "*" * 10 not in p]) for _ in range(400)]))
    whole = x.report_statements(t.read_exec_reports(spark, str(tmp_path)))
    limit = replace(SMALL, whole_file_bytes=3, slice_lines=4)
    texts = t.read_exec_reports(spark, str(tmp_path), settings=limit)
    split = x.report_statements(texts, limit)
    assert whole.count() > 10 and whole.filter("size(bind_variables) > 1 and size(execution_plan) > 0").count() > 2
    assert rows(split) == rows(whole)
    sizes = x.block_lines(texts.long_lines, limit).groupBy("file", "block_no").count()
    assert sizes.agg({"count": "max"}).first()[0] > 400


def test_short_blocks_of_large_reports_are_parsed_whole(spark, report_dir, tiny_splits, monkeypatch):
    """No line goes the way of long blocks where no block is longer than a slice; the bytes of a block count, too."""
    whole, by_lines, real = rows(x.report_statements(t.read_exec_reports(spark, report_dir, "*.txt"))), [], x.statements_of_lines
    monkeypatch.setattr(x, "statements_of_lines", lambda lines, *a: by_lines.append(lines) or real(lines, *a))
    wide = replace(SMALL, slice_lines=60)
    assert rows(x.report_statements(t.read_exec_reports(spark, report_dir, "*.txt", wide), wide)) == whole and not by_lines
    monkeypatch.setattr(x, "DEFAULTS", replace(DEFAULTS, whole_file_bytes=900))
    assert rows(x.report_statements(t.read_exec_reports(spark, report_dir, "*.txt", wide), wide)) == whole
    taken = by_lines[0].groupBy("file", "block_no").agg(F.sum(F.octet_length("line") + 1).alias("n"))
    assert len(by_lines) == 1 and taken.agg({"n": "min"}).first()[0] > 900


def test_no_block_is_collected(spark, report_dir, tiny_splits):
    texts = t.read_exec_reports(spark, report_dir, "*.txt", SMALL)
    plan = x.statements_of_lines(x.block_lines(texts.long_lines, SMALL), SMALL)._jdf.queryExecution().optimizedPlan().toString()
    whole = re.findall(r"collect_list\((?:struct|named_struct)\((?:line_no, )?line_no", plan)
    chosen = re.findall(r"collect_list\(CASE WHEN", plan)
    assert chosen and not whole


def test_line_ends_and_bad_bytes(spark, tmp_path):
    (tmp_path / "10053_a_1.trc").write_bytes(b"one\r\ntwo\rthr\xffee\nfour")
    (tmp_path / "other.log").write_bytes(b"not a trace")
    for settings in (DEFAULTS, replace(DEFAULTS, whole_file_bytes=3)):
        found = t.trace_lines(t.read_traces(spark, str(tmp_path), settings=settings))
        assert [(r.line_no, r.line) for r in found.orderBy("line_no").collect()] == [
            (1, "one"),
            (2, "two"),
            (3, "three"),
            (4, "four"),
        ]


def test_bad_bytes_of_reports_are_replaced(spark, tmp_path):
    (tmp_path / "a.prf").write_bytes(b"x\xffy")
    assert t.read_exec_reports(spark, str(tmp_path)).texts.first().text == "x�y"


def test_rejects(spark, tmp_path):
    (tmp_path / "10053_good_1.trc").write_text("PARAMETERS USED BY THE OPTIMIZER\n")
    (tmp_path / "10053_empty_1.trc").write_text("nothing here\n")
    traces = t.read_traces(spark, str(tmp_path))
    assert [r.file.rsplit("/", 1)[1] for r in t.rejected_traces(traces).collect()] == ["10053_empty_1.trc"]


def test_final_line_ends_and_headers(spark, tmp_path, tiny_splits):
    head = "----- Current SQL Statement for this session (sql_id={0}) -----{1}\nselect {2}\n----- \n"
    text = head.format("aaa", " and more", 1) + head.format("bbb", "", 2)
    for name, end in (("none", "last"), ("one", "last\n"), ("more", "last\n\n \n"), ("dos", "last\r\n"), ("old", "x\ry\r")):
        (tmp_path / f"10053_{name}_1.trc").write_bytes((text + end).encode())
    (tmp_path / "10053_long_1.trc").write_bytes((text + "é\n" * 300).encode())
    whole, split = (t.read_traces(spark, str(tmp_path), settings=s) for s in (DEFAULTS, replace(SMALL, whole_file_bytes=3)))
    assert rows(t.trace_lines(split)) == rows(t.trace_lines(whole))
    assert rows(e.exec_text_report(split).select("file", "line_count").distinct()) == rows(
        e.exec_text_report(whole).select("file", "line_count")
    )
    assert rows(o.trace_sql(split)) == rows(o.trace_sql(whole))
    assert {(r.sql_id, r.sql_text) for r in o.trace_sql(whole).collect()} == {("bbb", "select 2")}


def test_equal_names_in_two_folders(spark, tmp_path):
    rule = "\n" + "*" * 80 + "\n"
    block = (
        "select 1 from t\nsql_id='{0}'\n\ncall count cpu elapsed disk query current rows\n------- ------\n"
        "Fetch 1 0.01 0.02 1 2 3 4\ntotal 1 0.01 0.02 1 2 3 4\n"
    )
    for i, folder in enumerate(("d1", "d2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "10053_s_1.trc").write_text(
            f"Access path analysis for T{i}\n  Access Path: A\n    Cost:  {i}.5  Resp: 1.0  Degree: 1\n"
        )
        (tmp_path / folder / "s_1.prf").write_text(rule.join(block.format(f"{folder}{j}") for j in range(i + 1)))
    methods = o.access_methods(o.trace_facts(t.read_traces(spark, f"{tmp_path}/*")))
    assert {(m.file.split("/")[-2], m.table_name, m.cost) for m in methods.collect()} == {("d1", "T0", 0.5), ("d2", "T1", 1.5)}
    totals = e.exec_report_totals(with_issues(e.exec_statements(e.exec_blocks(t.read_exec_reports(spark, f"{tmp_path}/*")))))
    assert {(r.file.split("/")[-2], r.statements) for r in totals.collect()} == {("d1", 1), ("d2", 2)}
