"""Packs: many texts in a file, read whole or by lines, at once or as a stream."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from slowlens.config import DEFAULTS
from slowlens.plans import catalog, q_sources, q_streaming
from slowlens.sinks.documents import write_packs
from slowlens.sources import texts as t
from slowlens.streaming import jobs

LARGE = replace(DEFAULTS, whole_file_bytes=10, slice_lines=7)
TEXTS = {f"t{i}": "\n".join(f"line {k} of {i} é" for k in range(i % 9)) + "\n" * (i % 3) for i in range(60)}
TEXTS |= {"crlf": "a\r\nb\r\n", "cr": "a\rb", "blank": "", "lines": "\n\n", "long": "\n".join(f"{k}: " + "x" * k for k in range(300))}


def name():
    return t.folder_value(path=F.col("path"))


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def unix(text):
    return text.replace("\r\n", "\n").replace("\r", "\n")


@pytest.fixture(scope="module")
def packs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packs") / "out")
    write_packs(spark.createDataFrame(list(TEXTS.items()), "file string, text string"), path, per_pack=20)
    return path


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_few_files_hold_all_texts(spark, packs):
    assert len(spark.read.text(packs).inputFiles()) < len(TEXTS) / 3


def test_texts_come_back(spark, packs, tiny_splits):
    found = t.read_traces(spark, packs, "*.txt", file=name(), packed=True)
    assert found.long_lines is None
    assert {r.file: r.text for r in found.texts.collect()} == {k: unix(v) for k, v in TEXTS.items()}


def test_lines_read_split_by_split_are_those_of_the_texts(spark, packs, tiny_splits):
    found = t.read_exec_reports(spark, packs, "*.txt", LARGE, name(), packed=True)
    lines = spark.read.text(packs)
    assert found.texts.isEmpty() and lines.rdd.getNumPartitions() > 2 * len(lines.inputFiles())
    wanted = [(k, i, l) for k, v in TEXTS.items() for i, l in enumerate(unix(v).split("\n"), 1)]
    assert rows(found.long_lines) == sorted(map(repr, wanted))


def test_texts_of_one_name_are_one_and_others_have_keys_of_their_own(spark, tmp_path):
    twice = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "file string, text string")
    write_packs(twice, str(tmp_path / "named"))
    write_packs(twice, str(tmp_path / "plain"), named=False)
    named = t.read_traces(spark, str(tmp_path / "named"), "*.txt", file=name(), packed=True).texts
    assert rows(named) == [repr(("a", "x\nx")), repr(("b", "y"))]
    plain = t.read_traces(spark, str(tmp_path / "plain"), "*.txt", packed=True).texts
    assert plain.select("file").distinct().count() == 3 and rows(plain.select("text")) == [repr(("x",)), repr(("x",)), repr(("y",))]


def test_a_text_with_the_mark_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no text with its mark"):
        write_packs(spark.createDataFrame([("a", "x\x1ey")], "file string, text string"), str(tmp_path / "out"))


def test_a_stream_gives_the_texts(spark, packs, tmp_path):
    stream = jobs.stream_texts(spark, packs, "*.txt", file=name(), packed=True).texts
    jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert {r.file: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {k: unix(v) for k, v in TEXTS.items()}


@pytest.mark.parametrize(
    "query",
    ["access_methods_of_equal_names", "lines_of_large_traces", "read_trace_lines", "stream_new_traces", "stream_new_reports", "read_exec_reports"],
)
def test_queries_write_packs_not_a_file_per_text(spark, sf_dir, tmp_path, monkeypatch, query):
    """A file per text makes the work grow with files, not with bytes."""
    catalog.load()
    for module in (q_sources, q_streaming):
        monkeypatch.setattr(module, "scratch_path", lambda _, label: str(tmp_path / label))
    catalog.QUERIES[query](spark, sf_dir)
    written = [f for label in ("traces", "folders", "reports") for f in tmp_path.glob(f"{label}/**/*.txt")]
    assert 0 < len(written) <= 8


@pytest.mark.parametrize("per_pack", [1, 20])
def test_followers_of_packed_lines_are_those_of_whole_texts(spark, tmp_path, tiny_splits, per_pack):
    """Texts over many splits, with blank lines and short last texts; the lines are sorted once, not once more to find followers."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")
    texts = TEXTS | {f"gaps{i}": "\n" * i + "a\n \t\n\nb" + "\n" * 90 + "c\r\n\r\nd\n" + "e" * (60 * i) for i in range(4)} | {"one": "x", "late": "\n" * 120 + "y"}
    write_packs(spark.createDataFrame(list(texts.items()), "file string, text string"), str(tmp_path / "packs"), per_pack=per_pack)
    found = t.read_traces(spark, str(tmp_path / "packs"), "*.txt", LARGE, name(), packed=True)
    whole = t.texts_of(spark.createDataFrame(list(texts.items()), "file string, text string"))
    none, lines = t.lines_with_followers(found, LARGE)
    assert none.isEmpty() and rows(lines) == rows(t.lines_with_followers(whole)[0])
    assert rows(found.long_lines) == rows(t.trace_lines(whole))
    plan = lines._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "_slice" not in plan
