"""Rules as data: sets, order, rules of one's own, and what plans evaluate."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from slowlens.operators import execreport as e, execrules as r, optrules, opttrace as o, planrules
from slowlens.operators.rules import Findings, Rule
from slowlens.sources import documents as docs
from slowlens.sources.texts import texts_of

HEAD = "call     count       cpu    elapsed       disk      query    current        rows"


def statements(spark, tail="", total="total 3 0.01 0.02 1 2 3 4"):
    text = f"select 1 from t\n\n{HEAD}\n------- ------\nParse 4 0.00 0.00 0 0 0 0\nExecute 2 0.00 0.00 0 0 0 0\nFetch 1 0.01 0.02 1 2 3 4\n{total}\n{tail}"
    return e.exec_statements(e.exec_blocks(texts_of(spark.createDataFrame([("a_x.prf", text)], "file string, text string"))))


TAIL = (
    "\nRows     Row Source Operation\n  200000   TABLE ACCESS (cr=1) FULL EMP (x)\n 300000  nested loops outer\n 5 SORT\n 20000 table access full DEPT\n"
    "\nEvent waited on   Times\n------\ndb file scattered read  500  0.5\ndb file sequential read  5000  0.5\nDB file scattered read  101  0.5\n"
)


def test_rules_keep_their_order(spark):
    got = r.exec_issues(statements(spark, TAIL, "total 7 0.01 0.02 31 90 10 4")).orderBy("issue_no").collect()
    assert [(i.rule_no, i.severity, i.subject, i.measure) for i in got] == [
        (1, "HIGH", "EMP", 200000.0),
        (1, "MEDIUM", "DEPT", 20000.0),
        (2, "HIGH", None, 300000.0),
        (4, "MEDIUM", None, 2.0),
        (5, "LOW", None, 0.31),
        (7, "HIGH", "db file scattered read", 500.0),
        (6, "MEDIUM", "db file sequential read", 5000.0),
        (7, "HIGH", "DB file scattered read", 101.0),
    ]


def test_own_rules_on_statements(spark):
    sorts = Rule(
        100, "SORT", lambda l: l["line"].contains("SORT"), "LOW", {"message": lambda l: F.trim(l["line"]), "subject": "plan"}, each="plan"
    )
    slow = Rule(101, "ANY_WAIT", lambda x: F.size(x["waits"]) > 2, "LOW", {"measure": lambda x: F.size(x["waits"])})
    rules = [*r.exec_rules(), sorts, slow]
    found = r.exec_issues(statements(spark, TAIL), rules=rules)
    got = found.filter("rule_no >= 100").orderBy("issue_no").collect()
    assert [(i.rule_no, i.type, i.message, i.subject, i.measure) for i in got] == [(100, "SORT", "5 SORT", "plan", None), (101, "ANY_WAIT", None, None, 3.0)]
    assert r.exec_issues(statements(spark, TAIL), rules=[]).count() == 0
    with pytest.raises(ValueError, match="fields"):
        r.exec_issues(statements(spark), rules=[Rule(1, "X", lambda x: F.lit(True), "LOW", {"unknown": 1})])


def test_own_rules_on_documents_and_traces(spark):
    data = [("a", ["x", "| 1 | VIEW |"], [{"avg_elapsed_sec": 1.0}]), ("b", [], None)]
    frame = spark.createDataFrame(data, "sql_id string, plan array<string>, stats array<struct<avg_elapsed_sec:double,avg_buffer_gets:string,avg_disk_reads:string,avg_rows:string>>")
    view = Rule(50, "view", lambda x: x["text"].contains("VIEW"), "LOW", {"symptom": "A view", "advice": "Merge it", "measure": lambda x: x["elapsed"]})
    got = planrules.tuning_guide(frame, [*planrules.tuning_rules(), view]).orderBy("sql_id").collect()
    assert [(p.sql_id, p.rule_no, p.symptom, p.measure) for p in got] == [("a", 50, "A view", 1.0), ("b", 11, "No rule applies", None)]

    text = "Access path analysis for T1\n  Best:: AccessPath: TableScan\n     Cost: 9.0  Degree: 1  Resp: 9.0  Card: 2.0\nJoin order[1]:  T1[A]#0\n"
    facts = o.trace_facts(texts_of(spark.createDataFrame([("t.trc", text)], "file string, text string")))
    dear = Rule(60, "Dear Path", lambda x: x["cost"] > 5, "INFO", {"at": lambda x: x["block_at"], "message": "dear", "measure": lambda x: x["cost"]})
    orders = Rule(61, "Join Orders", lambda x: F.lit(True), "INFO", {"at": lambda x: x["at"], "message": lambda x: x["raw"]})
    relations = {"paths": lambda: o.best_access(facts), "orders": lambda: o.join_orders(facts)}
    found = optrules.trace_issues(facts, [*optrules.TRACE_RULES, ("paths", dear), ("orders", orders)], relations).orderBy("rule_no").collect()
    assert [(i.rule_no, i.at, i.message, i.measure) for i in found] == [(60, 1, "dear", 9.0), (61, 4, "T1[A]#0", None)]


def test_an_empty_set_finds_nothing(spark):
    shape = Findings({"n": "int"})
    row = spark.range(1).select(shape.findings([], F.struct("id")).alias("f")).first()
    assert row.f == []


def test_patterns_are_matched_once_for_each_line(spark):
    found = r.exec_issues(statements(spark))
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("TABLE ACCESS.*FULL") == 1 and plan.count("NESTED LOOPS.*$") == 1
    assert plan.count("db file sequential read") == 1


def test_rules_on_one_relation_share_a_pass(spark, tmp_path):
    facts = o.trace_facts(texts_of(spark.createDataFrame([("t.trc", "x")], "file string, text string")))
    facts.write.parquet(str(tmp_path / "facts"))
    written = spark.read.parquet(str(tmp_path / "facts"))
    one = optrules.trace_issues(written, [x for x in optrules.TRACE_RULES if x[0] == "system"])
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.mark.parametrize("read, document, column", [
    (docs.read_awr_docs, {"sql_id": "a", "plan": ["x"]}, "sql_id"),
    (docs.read_tkprof_docs, {"sql_id": "a", "tkprof_statements": []}, "tkprof_file"),
    (docs.read_detections, {"detected_at": "t", "sql_list": [{"sql_id": "a"}]}, "sql_id"),
])
def test_a_document_is_parsed_once(spark, tmp_path, read, document, column):
    (tmp_path / "d.json").write_text(json.dumps(document))
    (tmp_path / "bad.json").write_text('{"sql_id": ')
    found = read(spark, str(tmp_path), glob="*.json")
    assert found.docs.select(column)._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert found.docs.select(column).count() == 1
    assert [x.file for x in found.rejects.collect()] == ["bad.json"]
