"""Optimizer traces on hand-written text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from slowlens.config import Settings
from slowlens.operators import optreports as v, optrules as r, opttrace as o
from slowlens.sources.texts import TextSet, texts_of, trace_lines


def traces(spark, *texts):
    data = [(f"10053_t{i}_1.trc", text) for i, text in enumerate(texts)]
    return texts_of(spark.createDataFrame(data, "file string, text string"))


def facts(spark, *texts):
    return o.trace_facts(traces(spark, *texts))


def methods(spark, body):
    found = o.access_methods(facts(spark, "Access path analysis for T1\n" + body))
    return [
        (m.method, m.index_name, m.cost, m.cost_io, m.cost_cpu, m.ix_sel, m.join_type)
        for m in found.orderBy("block_at", "entry_no").collect()
    ]


def cost(value):
    return f"    Cost:  {value}  Resp: {value}  Degree: 1\n"


def test_same_method_again_continues(spark):
    body = (
        "  Access Path: index (FFS)\n    Index: IX1\n    resc_io: 2.5  resc_cpu: 7\n"
        "    ix_sel: 0.5  ix_sel_with_filters: 1e-2 \n  Access Path: index (FFS)\n" + cost("3.0")
    )
    assert methods(spark, body) == [("index (FFS)", "IX1", 3.0, 2.5, 7, 0.5, None)]


def test_other_method_starts_anew(spark):
    body = "  Access Path: A\n    Index: IX1\n  Access Path: B\n" + cost("3.0")
    assert methods(spark, body) == [("B", None, 3.0, None, None, None, None)]


def test_cost_closes_a_method(spark):
    body = "  Access Path: A\n" + cost("3.0") + "    Index: IX9\n" + cost("4.0") + "  Access Path: A\n" + cost("5.0")
    assert [(m[0], m[1], m[2]) for m in methods(spark, body)] == [("A", None, 3.0), ("A", None, 5.0)]


def test_cost_without_method_is_nothing(spark):
    assert methods(spark, cost("3.0") + "      Cost_io: 1.0  Cost_cpu: 5\n") == []


def test_nested_loop_cost_keeps_the_method_open(spark):
    body = "  Access Path: A\n  NL Join : Cost: 9.5  Resp: 1.0  Degree: 2\n    Index: IX1\n" + cost("3.0")
    assert methods(spark, body) == [
        ("A", None, 9.5, None, None, None, "NL"),
        ("A", "IX1", 3.0, None, None, None, None),
    ]


def test_late_breakdown_overwrites_the_latest_entry(spark):
    body = (
        "  Access Path: A\n    resc_io: 1.0  resc_cpu: 1\n" + cost("3.0") + "  something else\n"
        "      Cost_io: 7.5  Cost_cpu: 8\n  Access Path: B\n      Cost_io: 8.5  Cost_cpu: 9\n" + cost("4.0")
    )
    got = [(m[0], m[3], m[4]) for m in methods(spark, body)]
    assert got == [("A", 8.5, 9), ("B", None, None)]


def test_blocks_end_at_the_next_table_or_at_the_statistics(spark):
    text = (
        "Access path analysis for T1\n  Access Path: A\nAccess path analysis for T2\n" + cost("1.0")
        + "  Access Path: B\n" + cost("2.0") + "OPTIMIZER STATISTICS AND COMPUTATIONS\n  Access Path: C\n" + cost("3.0")
    )
    found = o.access_methods(facts(spark, text)).collect()
    assert [(m.table_name, m.method) for m in found] == [("T2", "B")]


def test_best_path_needs_its_cost_line(spark):
    text = (
        "Access path analysis for T1\n  Best:: AccessPath: X\n  nothing\n  Best:: AccessPath: IndexRange\n  Index: IX\n"
        "     Cost: 1.5  Degree: 1  Resp: 1.5  Card: 2.0  Bytes: 0\n"
        "Access path analysis for T2\n  Best:: AccessPath: TableScan\n     Cost: 9.0  Degree: 1  Resp: 9.0  Card: 2.0\n"
        "Access path analysis for T3\n"
    )
    f = facts(spark, text)
    best = [(b.table_name, b.method, b.index_name, b.cost) for b in o.best_access(f).orderBy("block_at").collect()]
    assert best == [("T1", "IndexRange", "IX", 1.5), ("T2", "TableScan", None, 9.0)]
    assert [b.table_name for b in o.access_blocks(f).orderBy("block_at").collect()] == ["T1", "T2", "T3"]


def test_summary_of_a_trace_without_best_path_has_nulls(spark):
    t = traces(spark, "Access path analysis for T1\n", "nothing at all\n")
    f = o.trace_facts(t)
    summary = v.trace_summary(
        t.texts.select("file"), o.trace_sql(t), o.trace_table_stats(f), o.access_blocks(f), o.best_access(f),
        o.best_join(f), r.trace_issues(f), o.trace_db_info(f),
    ).orderBy("file").collect()
    assert [(s.best_method, s.best_cost, s.issue_count, s.band) for s in summary] == [(None, None, 0, "none")] * 2


def test_tags_are_whole_words(spark):
    text = (
        "CBQT - cost-based query transformation\nORE - CBQT OR-Expansion\nOJE: Begin\nPJE:  Bypassed\nLORE: Trying\n"
        "JE:   Considering\nCBQT: Validity checks failed\nCBQT: Considering\nSU: Unnested it\n"
    )
    got = [(t.type, t.status) for t in o.transformations(facts(spark, text)).orderBy("at").collect()]
    assert got == [("JE", "considered"), ("CBQT", "bypassed"), ("CBQT", "applied"), ("SU", "applied")]


def test_only_the_first_sections_count(spark):
    dump = "  ****\nCompilation Environment Dump\n"
    text = (
        f"  PARAMETERS WITH ALTERED VALUES\n{dump}a = 1\nBug Fix Control Environment\nb = 2\n"
        f"  PARAMETERS WITH DEFAULT VALUES\n{dump}c = 3\nd e = 4\nc = 5 \n  Table: T\nf = 6\n"
        f"  PARAMETERS WITH ALTERED VALUES\n{dump}g = 7\nBug Fix Control Environment\n"
    )
    got = {(p.section, p.name, p.value) for p in o.trace_params(facts(spark, text)).collect()}
    assert got == {("altered", "a", "1"), ("default", "c", "5")}


def test_first_table_and_last_column_win(spark):
    stats = "  Table: {0}  Alias: A\n  #Rows: {1}  #Blks:  1  AvgRowLen:  1.00\n"
    column = "  Column (#1): C(NUMBER)\n    AvgLen: 1 NDV: {0} Nulls: 0 Density: 0.5\n{1}"
    text = stats.format("T", 1) + stats.format("T", 2) + column.format(3, "") + column.format(4, "    Histogram: Freq  #Bkts: 9\n")
    f = facts(spark, text)
    assert [(t.table_name, t.rows) for t in o.trace_table_stats(f).collect()] == [("T", 1)]
    assert [(c.ndv, c.histogram, c.buckets) for c in o.trace_column_stats(f).collect()] == [(4, "Freq", 9)]
    assert o.trace_column_rows(f).count() == 2


def test_cost_analysis_takes_the_last_block_of_a_table(spark):
    def block(a, b):
        return f"Access path analysis for T1\n  Access Path: A\n{cost(a)}  Access Path: B\n{cost(b)}"

    found = o.access_cost_analysis(o.access_methods(facts(spark, block("9.0", "8.0") + block("2.0", "2.0")))).first()
    assert (found.best_method, found.best_cost, found.worst_cost, found.cost_ratio) == ("A", 2.0, 2.0, 1.0)


def test_issue_limits(spark):
    index = "  Index: {0}  Col#: 1\n  LVLS: 1  #LB: 1  #DK: 1  LB/K: 1.00  DB/K: 1.00  CLUF: {1}.00  NRW: {2}.00\n"
    text = index.format("I1", 30, 100) + index.format("I2", 31, 100) + index.format("I3", 50, 100) + index.format("I4", 51, 100) + index.format("I5", 5, 0)
    found = r.clustering_issues(o.trace_index_stats(facts(spark, text))).orderBy("at").collect()
    assert [i.severity for i in found] == ["INFO", "INFO", "WARNING"]


def test_objects_without_statistics_are_listed_in_file_order(spark):
    index = "  Index: {0}  Col#:    (NOT ANALYZED)\n  LVLS: 1  #LB: 1  #DK: 1  LB/K: 1.00  DB/K: 1.00  CLUF: 1.00  NRW: 1.00\n"
    found = r.not_analyzed_issues(o.trace_index_stats(facts(spark, index.format("Z") + index.format("A"))), "index_name", 8, "Index NOT ANALYZED")
    assert [(i.message, i.measure) for i in found.collect()] == [("Z, A", 2.0)]


def test_system_statistics_first_section(spark):
    text = (
        "SYSTEM STATISTICS INFORMATION\n------\n  Using WORKLOAD Stats\n  MBRC: NO VALUE blocks (default is 8)\n*****\n"
        "  OTHER: 1 x (default is 1)\nSYSTEM STATISTICS INFORMATION\n------\n  LATE: 1 x (default is 1)\n"
    )
    got = {(s.item, s.value, s.is_default) for s in o.trace_system_stats(facts(spark, text)).collect()}
    assert got == {("stats_type", "WORKLOAD", None), ("MBRC", "NO", True)}


def test_sampling_messages_once_in_first_seen_order(spark):
    text = "** DYNAMIC sampling used for table b\nDynamic sampling on index a\n** DYNAMIC sampling used for table b\ndynamic sampling level 2\n"
    found = o.dynamic_sampling(facts(spark, text)).orderBy("at").select(F.col("message"))
    assert [m.message for m in found.collect()] == ["DYNAMIC sampling used for table b", "Dynamic sampling on index a"]


def test_blank_lines_between_name_and_figures(spark):
    text = (
        "  Table: T  Alias: A\n\n  #Rows: 5  #Blks:  1  AvgRowLen:  1.00\n"
        "  Index: I  Col#: 1\n \n\n\n  LVLS: 1  #LB: 1  #DK: 1  LB/K: 1.00  DB/K: 1.00  CLUF: 1.00  NRW: 1.00\n"
        "  Column (#1): C(NUMBER)\n\n    AvgLen: 1 NDV: 7 Nulls: 0 Density: 0.5\n\t\n    Histogram: Freq  #Bkts: 9\n"
        "Access path analysis for T\n  Best:: AccessPath: X\n\n  Index: I\n\n\n     Cost: 1.5  Degree: 1  Resp: 1.5  Card: 2.0\n"
    )
    f = facts(spark, text)
    assert [t.rows for t in o.trace_table_stats(f).collect()] == [5]
    assert [i.index_name for i in o.trace_index_stats(f).collect()] == ["I"]
    assert [(c.ndv, c.buckets) for c in o.trace_column_stats(f).collect()] == [(7, 9)]
    assert [(b.method, b.index_name, b.cost) for b in o.best_access(f).collect()] == [("X", "I", 1.5)]


def line_machine(body):
    """The access methods of one block, line by line."""
    out, method, kept = [], None, {}
    for text in body:
        if "Access Path:" in text:
            name = text.split("Access Path:")[1].strip()
            if name != method:
                kept = {}
            method = name
        elif text.strip().startswith("Cost_io:"):
            if out:
                out[-1]["io"], out[-1]["cpu"] = float(text.split()[1]), int(text.split()[3])
        elif "Cost:" in text:
            if method:
                cost = float(text.split("Cost:")[1].split()[0])
                nl = "NL Join" in text
                out.append({"method": method, "index": kept.get("index"), "cost": cost, "io": kept.get("io"), "cpu": kept.get("cpu"), "sel": kept.get("sel"), "nl": nl})
                method = method if nl else None
        elif method and "Index:" in text:
            kept["index"] = text.split()[1]
        elif method and "resc_io:" in text:
            kept["io"], kept["cpu"] = float(text.split()[1]), int(text.split()[3])
        elif method and "ix_sel:" in text:
            kept["sel"] = float(text.split()[1])
    return [(e["method"], e["index"], e["cost"], e["io"], e["cpu"], e["sel"], "NL" if e["nl"] else None) for e in out]


@pytest.mark.parametrize("slice_lines", [1, 2, 7, 10**6])
def test_slices_of_a_block_equal_the_line_machine(spark, slice_lines):
    r = random.Random(8)

    def some_line():
        n = r.randint(1, 9)
        return r.choice(
            [
                f"  Access Path: {r.choice('AB')}",
                f"  Access Path: {r.choice('AB')}",
                f"    Index: IX{n}",
                f"    resc_io: {n}.5  resc_cpu: {n}",
                f"    ix_sel: 0.{n}  ix_sel_with_filters: 0.1 ",
                f"    Cost:  {n}.0  Resp: 1.0  Degree: 1",
                f"  NL Join : Cost: {n}.25  Resp: 1.0  Degree: 2",
                f"      Cost_io: {n}.75  Cost_cpu: {n}",
                "  something else",
                "  something else",
            ]
        )

    blocks = [[some_line() for _ in range(r.choice([3, 12, 40, 90]))] for _ in range(60)]
    found = o.access_methods(
        facts(spark, *["Access path analysis for T1\n" + "\n".join(b) + "\n" for b in blocks]), Settings(slice_lines=slice_lines)
    )
    got = {}
    for m in found.orderBy("file", "entry_no").collect():
        row = (m.method, m.index_name, m.cost, m.cost_io, m.cost_cpu, m.ix_sel, m.join_type)
        got.setdefault(m.file, []).append(row)
        assert m.entry_no == len(got[m.file])
    assert got == {f"10053_t{i}_1.trc": line_machine(b) for i, b in enumerate(blocks) if line_machine(b)}


def test_no_task_holds_the_lines_of_a_block(spark):
    plan = o.access_methods(facts(spark, "Access path analysis for T1\n"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if " Window [" in line or line.strip().startswith("Window [")]
    over_lines = [w for w in windows if "last(mark" in w or "own_" in w or "costs" in w]
    assert over_lines and all("slice" in w for w in over_lines)


KINDS_TEXT = (
    "Oracle Database 19c\n  PARAMETERS WITH DEFAULT VALUES\n  ****\nCompilation Environment Dump\na = 1\n"
    "*****\nSYSTEM STATISTICS INFORMATION\n-----\n  Using WORKLOAD Stats\n*****\n  Using NOWORKLOAD Stats\nb = 2\n"
    "  Table: T  Alias: A\n  #Rows: 1  #Blks:  1  AvgRowLen:  1.00\n  Access Path: A\n"
    "Access path analysis for T\n  Access Path: A\n    Cost:  1.0  Resp: 1.0  Degree: 0\nOPTIMIZER STATISTICS\n  Access Path: B\n"
    "Number of join permutations tried: 2\nSU: Unnested it\n"
)


def test_facts_of_some_kinds_are_those_of_all(spark):
    """Each kind alone gives the facts that it has among all, in files read whole and by lines."""
    whole = traces(spark, KINDS_TEXT, "none at all\n")
    lines = TextSet(whole.texts.filter("false"), trace_lines(whole))
    every = o.trace_facts(whole)
    columns = {"access": ["block_at", "block_table"], "parameter": ["section"]}
    for kind in ("db", "access", "table", "system", "parameter", "join", "transformation"):
        def rows(found):
            shown = found.filter(F.col("kind") == kind).select("file", "line_no", "line", "next1", *columns.get(kind, ()))
            return sorted(map(tuple, shown.collect()))

        for texts in (whole, lines):
            some = o.trace_facts(texts, Settings(slice_lines=3), kinds=(kind,))
            assert rows(some) == rows(every) != []
            assert some.filter(F.col("kind") != kind).isEmpty()


def test_kinds_without_a_place_are_not_shuffled(spark):
    found = o.trace_facts(traces(spark, KINDS_TEXT), kinds=("join", "table"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_join_search_reads_facts_once(spark):
    """Traces with any fact are known from the same pass; rows without a name have no counts."""
    texts = [("a", KINDS_TEXT), ("b", "Database name: X\n"), ("c", "none\n"), (None, KINDS_TEXT)]
    found = o.join_search(o.trace_facts(texts_of(spark.createDataFrame(texts, "file string, text string"))))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("a", 2, 1, False), ("b", 0, 0, False), (None, 0, 0, False)], key=str
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" not in plan
