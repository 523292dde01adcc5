"""Large sets on disk: what is shuffled, and what is written."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from slowlens.config import DEFAULTS
from slowlens.operators import execlines
from slowlens.operators.execlines import report_statements
from slowlens.operators.execrules import with_issues
from slowlens.plans import catalog, q_reports, q_sources, q_streaming, render
from slowlens.sinks.documents import NO_NAME, pack_records, write_packs, write_tkprof_docs
from slowlens.sources import texts as t
from slowlens.sources.documents import read_tkprof_docs
from slowlens.streaming import jobs

LARGE = replace(DEFAULTS, whole_file_bytes=10, slice_lines=7)
TEXTS = {f"t{i}": "\n".join(f"line {k} of {i} é" for k in range(i % 9)) + "\n" * (i % 3) for i in range(60)}
TEXTS |= {"crlf": "a\r\nb\r\n", "cr": "a\rb", "blank": "", "lines": "\n\n", "long": "\n".join(f"{k}: " + "x" * k for k in range(300))}


def unix(text):
    return text.replace("\r\n", "\n").replace("\r", "\n")


def files_of(path):
    return sorted(f for f in path.rglob("*") if f.is_file() and not f.name.startswith((".", "_")))


@pytest.fixture
def scratch(tmp_path, monkeypatch):
    """The queries write below ``tmp_path``."""
    catalog.load()
    for module in (q_sources, q_streaming, q_reports):
        monkeypatch.setattr(module, "scratch_path", lambda _, label: str(tmp_path / label))
    return tmp_path


def test_reports_are_shuffled_as_rows_not_as_texts(spark, sf_dir):
    """Neither the making of texts nor that of packs moves texts."""
    found = pack_records(render.exec_report_texts(spark, sf_dir, named=True))._jdf.queryExecution().executedPlan().toString()
    above, _, below = found.partition("Exchange ")
    assert "concat_ws(" in above and "Exchange " in below
    assert "concat_ws(" not in below and "collect_list" not in below


def test_names_that_are_null_keep_their_text(spark, tmp_path):
    rows = spark.createDataFrame([(None, "x"), ("a", "y"), (None, "w"), ("b", None), (NO_NAME, "z")], "file string, text string")
    write_packs(rows, str(tmp_path / "packs"))
    found = t.read_traces(spark, str(tmp_path / "packs"), "*.txt", file=t.folder_value(path=F.col("path")), packed=True)
    assert {tuple(r) for r in found.texts.collect()} == {(NO_NAME, "w\nx\nz"), ("a", "y"), ("b", "")}


def test_compressed_packs_hold_the_same_texts_and_lines(spark, tmp_path):
    path, name = str(tmp_path / "packs"), t.folder_value(path=F.col("path"))
    write_packs(spark.createDataFrame(list(TEXTS.items()), "file string, text string"), path, per_pack=4, compression="gzip")
    assert {f.suffix for f in files_of(tmp_path / "packs")} == {".gz"}
    whole = t.read_exec_reports(spark, path, "*.txt*", file=name, packed=True)
    assert whole.long_lines is None and {r.file: r.text for r in whole.texts.collect()} == {k: unix(v) for k, v in TEXTS.items()}
    lines = t.read_exec_reports(spark, path, "*.txt*", LARGE, name, packed=True)
    wanted = [(k, i, l) for k, v in TEXTS.items() for i, l in enumerate(unix(v).split("\n"), 1)]
    assert lines.texts.isEmpty() and sorted(map(tuple, lines.long_lines.collect())) == sorted(wanted)
    stream = jobs.stream_texts(spark, path, "*.txt*", file=name, packed=True).texts
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TEXTS)


@pytest.mark.parametrize("query", ["read_exec_reports", "stream_new_reports", "exec_statements_of_large_reports"])
def test_packs_of_large_report_sets_are_compressed(spark, sf_dir, scratch, monkeypatch, query):
    monkeypatch.setattr(render, "PLAIN_BLOCKS", 10)
    assert not compare(spark, connect(sf_dir), catalog.QUERIES[query], catalog.ORACLES[query], sf_dir)[2]
    text_bytes = render.exec_report_texts(spark, sf_dir).agg(F.sum(F.length("text"))).first()[0]
    packs = files_of(scratch / "reports")
    assert {f.suffix for f in packs} == {".gz"} and sum(f.stat().st_size for f in packs) < text_bytes / 8


@pytest.mark.parametrize("query", ["write_and_read_tkprof_docs", "tkprof_docs_with_texts"])
def test_report_documents_are_written_compressed(spark, sf_dir, scratch, query):
    assert not compare(spark, connect(sf_dir), catalog.QUERIES[query], catalog.ORACLES[query], sf_dir)[2]
    docs = files_of(scratch / "tkprof")
    text_bytes = render.exec_report_texts(spark, sf_dir).agg(F.sum(F.length("text"))).first()[0]
    assert docs and all(f.name.endswith(".json.gz") for f in docs)
    assert sum(f.stat().st_size for f in docs) < text_bytes / 4


def test_compressed_documents_are_cut_into_files_and_plain_ones_are_as_before(spark, tmp_path):
    texts = t.texts_of(spark.createDataFrame([(f"r{i}_x.prf", f"text {i}") for i in range(1005)], "file string, text string").coalesce(1))
    none = with_issues(report_statements(texts))
    plain, small = str(tmp_path / "plain"), str(tmp_path / "small")
    write_tkprof_docs(none, plain, reports=texts)
    write_tkprof_docs(none, small, reports=texts, compression="gzip")
    assert all(f.name.endswith(".json") for f in files_of(tmp_path / "plain"))
    assert len(files_of(tmp_path / "small")) >= 2
    found = [read_tkprof_docs(spark, p, glob="*.json*", multi_line=False) for p in (plain, small)]
    assert all(f.rejects.isEmpty() for f in found)
    a, b = [sorted((r.tkprof_file, r.tkprof_full_text) for r in f.docs.collect()) for f in found]
    assert a == b and len(a) == 1005


def block(k, filler=0, call=True):
    """A block of a report, with as many lines of plan as asked for."""
    head = [f"select {k} from t where x = 1", f"sql_id='q{k}'", ""]
    calls = ["call     count       cpu    elapsed       disk      query    current        rows"] if call else ["no table " + "-" * 60]
    rows = [f"{p} {k} 0.01 0.0{k % 9 + 1} 1 2 3 4" for p in ("Parse", "Execute", "Fetch", "total")]
    plan = ["", "Rows     Row Source Operation", "-------  ----"] + [f"{i}  STEP {i}" for i in range(filler)] + [""]
    binds = ["BINDS #1:", " bind 0: ", "  dty=1", f'  value="{k}"', "EXEC #1:c=0"] if k % 3 == 0 else []
    return "\n".join([*head, *calls, *rows, *plan, *binds])


STARS = "*" * 40
REPORTS = {f"r{i}.prf": f"\n{STARS}\n".join(block(k, k * (i + 1) % 23, k % 5 != 4) for k in range(1, i + 2)) for i in range(9)}
REPORTS |= {
    "crlf.prf": f"\r\n{STARS}\r\n".join(block(k).replace("\n", "\r\n") for k in range(4)) + "\r\n",
    "inside.prf": f"{STARS}{block(1)}{STARS}{block(2)} {STARS} {STARS}\n\n{block(3)}\n{STARS}",
    "long.prf": f"\n{STARS}\n".join([block(7), block(8, 160), block(9)]),
    "stars.prf": f"{STARS}\n" * 30 + block(5),
    "empty.prf": "",
    "blank.prf": "\n \n",
}


@pytest.mark.parametrize("split, compression", [(300, None), (1 << 20, None), (1 << 20, "gzip")])
def test_statements_of_large_packs_are_those_of_whole_texts(spark, tmp_path, split, compression):
    """Blocks inside splits, over two and over many, short ones and some with more lines than a slice."""
    texts = spark.createDataFrame(list(REPORTS.items()), "file string, text string")
    write_packs(texts, str(tmp_path / "packs"), per_pack=7, compression=compression)
    settings = replace(LARGE, slice_lines=40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        name = t.folder_value(path=F.col("path"))
        found = t.read_exec_reports(spark, str(tmp_path / "packs"), "*.txt*", settings, name, packed=True)
        wanted = report_statements(t.texts_of(texts))
        statements = report_statements(found, settings).select(*wanted.columns)
        left, right = (sorted(map(repr, map(tuple, df.collect()))) for df in (statements, wanted))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(right) > 40 and left == right


def test_lines_of_large_packs_are_dealt_once_in_compressed_files(spark, tmp_path, monkeypatch):
    """Only blocks that may go on in another split are shuffled as lines."""
    plans, written = [], execlines._written
    monkeypatch.setattr(
        execlines, "_written", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or written(df, label)
    )
    texts = spark.createDataFrame(list(REPORTS.items()), "file string, text string")
    write_packs(texts, str(tmp_path / "packs"), per_pack=7)
    settings = replace(LARGE, slice_lines=400)
    tables = spark.catalog.listTables()
    found = t.read_exec_reports(spark, str(tmp_path / "packs"), "*.txt", settings, packed=True)
    pieces = execlines.block_pieces(found.packs, settings)
    (label, plan), = plans
    assert label == "block-pieces" and "Exchange" not in plan and "Window" in plan
    assert spark.catalog.listTables() == tables
    inside, all_of = pieces.filter("inside").count(), pieces.count()
    assert inside >= all_of - 2 * len(files_of(tmp_path / "packs")) > 0
