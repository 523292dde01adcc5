"""Statements by patterns on whole blocks against those put together from lines; one generator for a parse."""

from __future__ import annotations

import random
from dataclasses import replace

from slowlens.config import DEFAULTS
from slowlens.operators import execlines as x, execreport as e
from slowlens.sources import texts as t

LINES = (
    "select 1", "  from t  ", "sql_id='a1'", "-- sql_id='b2' and sql_id='c3'", "", " \t", "call     count  cpu", "CALL count", " call count",
    "Parse  1  0.01 0.02 3 4 5 6", "  execute 2 0.5 1..2 3 4 5 6x", "Fetch 99999999999999999999 1 2 3 4 5 6", "total  3  0.1  2.5  1  2  3  4 tail",
    "total 1 0 0 0 0 0 0", "Rows     Row Source Operation", "rows  execution plan", " Rows  Execution Plan", "x Row Source Operation y", "10  NESTED LOOPS  ",
    "Elapsed times include waiting on following events:", "elapsed TIMES include waiting", "Event waited on   Times", "  db file scattered read  7  0.5",
    "  log file sync  2  .5.", "  Elapsed", "****", "  **** x", "BINDS #1:", " bind 0: ", "  dty=1", '  value="v"', "EXEC #1:c=0", "Rows", "é   z",
)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_patterns_find_what_lines_give(spark):
    r = random.Random(11)
    usual = ["select 1", "call count", "total 3 0.1 2.5 1 2 3 4"]
    blocks = []
    for _ in range(400):
        lines = [r.choice(LINES) for _ in range(r.randrange(30))]
        for at, line in zip(sorted(r.sample(range(len(lines) + 3), 3)), usual):
            lines.insert(at, line)
        blocks.append("\n".join(lines) + "\n" + "z" * 50)
    files = [(f"f{i}", ("\n" + "*" * 12 + "\n").join(blocks[i * 50 : i * 50 + 50])) for i in range(8)]
    whole = t.texts_of(spark.createDataFrame(files, "file string, text string"))
    settings = replace(DEFAULTS, slice_lines=7)
    found = e.exec_statements(e.exec_blocks(whole))
    by_lines = x.statements_of_lines(x.block_lines(t.trace_lines(whole), settings), settings)
    assert found.count() > 150
    assert rows(found) == rows(by_lines.select(*found.columns))


def test_a_parse_passes_one_generator(spark):
    """Each generator copies rows and evaluates its input outside generated code: seven of them were most of the time."""
    blocks = spark.createDataFrame([("f", 0, "x")], "file string, block_no bigint, block string")
    plan = e.exec_statements(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
