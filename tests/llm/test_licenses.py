"""License scan against a plain Python scan that merges first."""

from __future__ import annotations

import random
import re

from slowlens.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, phrases, notices):
    """Places of base phrases, labels and score of one text, by the definition."""
    words = WORD.findall(lower(text))
    places, base, labels, score = [], set(), set(), 0.0
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        if at:
            places += at
            base.add(label)
    for phrase, label in notices.items():
        p = phrase.split()
        votes = {(i - j, j) for i in range(len(words) - 1) for j in range(len(p) - 1) if words[i : i + 2] == p[j : j + 2]}
        for anchor in {d for d, _ in votes}:
            at = {j for d, j in votes if anchor <= d <= anchor + max(3, len(p) // 4)}
            covered = len(at | {j + 1 for j in at})
            if len(at) >= 3 and covered >= 0.8 * len(p):
                labels.add(label)
                score = max(score, covered / len(p))
    if places:
        score = 1.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def texts():
    r = random.Random(6)
    notices = list(licenses.NOTICES)
    fill = "the software of the license is a work that any person may use under the terms of it".split()
    out = [
        "released under the terms of the MIT License",
        "Licensed under the terms of the Apache License, Version 2.0",
        "Released, under the mit LICENSE; released under the mit license",
        "Code: MIT License. Docs: CC-BY",
        None,
        "",
        "license",
        "mit " * 400 + "license " * 400,
        "apache license " * 300,
    ]
    for _ in range(60):
        words = r.choice(notices).split()
        for _ in range(r.randint(0, 8)):
            i = r.randrange(len(words))
            words[i : i + r.randint(0, 2)] = [r.choice(fill) for _ in range(r.randint(0, 3))]
        around = [" ".join(r.choice(fill) for _ in range(r.randint(0, 40))) for _ in range(2)]
        out.append(f"{around[0]} {' '.join(words)} {around[1]}")
    return out


def test_equals_plain_scan(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "k", 3, "mine") for i, t in enumerate(rows)], "doc_id long, text string, _k1 string, hits int, licenses string")
    found = licenses.scan_licenses(docs)
    assert found.columns == ["doc_id", "_k1", "hits", "licenses", "licenses_"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert all((r["_k1"], r["hits"], r["licenses"]) == ("k", 3, "mine") for r in got.values())
    for i, t in enumerate(rows):
        assert tuple(got[i]["licenses_"]) == brute(t, licenses.PHRASES, licenses.NOTICES), t
    assert got[0]["licenses_"]["labels"] == "mit,mit-statement" and got[1]["licenses_"]["labels"] == "apache,apache-statement"


def test_templates_as_a_table(spark):
    own = {"you may share this text with anyone you like as long as you name its author": "share", "keep it": "short"}
    notices = spark.createDataFrame([(t.upper() + ".", lb) for t, lb in own.items()] + [("", "none"), (None, "null")], "text string, label string")
    rows = ["You may share this text, with anyone you like, as long as you name the author! GNU general public license", "keep it", "mit-license", "You may."]
    found = licenses.scan_licenses(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string"), notices).collect()
    for r in found:
        assert tuple(r["licenses"]) == brute(rows[r["doc_id"]], licenses.PHRASES, own)
    assert next(r for r in found if r["doc_id"] == 0)["licenses"]["labels"] == "gpl,share"


def test_texts_are_read_once(spark, sf_dir, monkeypatch):
    plans = []
    real = licenses.saved
    monkeypatch.setattr(licenses, "saved", lambda df, label: plans.append(df) or real(df, label))
    out = licenses.op7_license_diagonals(spark, sf_dir)
    scans = [p._jdf.queryExecution().executedPlan().toString().count("documents.parquet") for p in [*plans, out]]
    assert sum(1 for n in scans if n) == 1 and "text" not in out.columns
