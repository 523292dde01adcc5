"""Ranked search against plain Python and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from compare import compare, connect
from slowlens.llm import ranked_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, top=20):
    """{item row: [(doc_id, score)]} by the definition."""
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, total = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = {}
    for k, (_, text) in enumerate(items):
        scores = []
        for i, c in terms:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in TERM.findall(lower(text))
                if t in c
            )
            scores.append((-score, i is None, i or 0, i))
        out[k] = [(i, -s) for s, _, _, i in sorted(scores) if s < 0][:top]
    return {k: v for k, v in out.items() if v}


def corpus(seed=1, n=400):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "漢字", "É", "x9"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 3, 8, 8, 8, 40])))) for i in range(n)]
    docs += [(n + i, "w1 w2 w3 w50") for i in range(60)] + [(None, "w1 w2 w3 w50"), (5, "W1-w2 w3,w50"), (3, None), (4, ""), (6, " .,- ")]
    docs += [(10_000, " ".join(r.choices(words, k=30_000)))]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(40)]
    items += [(1, "w1 W1 w1"), (None, "w50 nowhere"), (7, None), (8, ""), (9, "nowhere")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"entries": 60}, {"top": 3}])
def test_equals_brute_force(spark, options, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "FIRST_DOCUMENTS", 20)
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, item int, score string").coalesce(1)
    got = search.ranked_search(d, q, **options).collect()
    order = {r["item"]: k for k, r in zip([k for k, (_, t) in enumerate(items) if TERM.search(t or "")], search.item_terms(q).orderBy("item").collect())}
    by = {}
    for r in sorted(got, key=lambda r: (r["item"], r["rank"])):
        by.setdefault(order[r["item"]], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(by[order[r["item"]]]) and items[order[r["item"]]][0] == r["item_id"]
    assert by == brute(docs, items, options.get("top", 20))


def test_scores_beyond_doubles_are_exact(spark, monkeypatch):
    docs, items = corpus(n=60)
    monkeypatch.setattr(search, "EXACT", 1)
    found = search.ranked_search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["score"], r["doc_id"] or 0) for r in found.collect()) == sorted((s, i or 0) for v in brute(docs, items).values() for i, s in v)


def test_empty_sides(spark):
    docs, items = corpus(n=5)
    d, q = (lambda rows: spark.createDataFrame(rows, "doc_id long, text string")), (lambda rows: spark.createDataFrame(rows, "item_id long, text string"))
    assert search.ranked_search(d([]), q(items)).collect() == []
    assert search.ranked_search(d(docs), q([])).collect() == []
    assert search.ranked_search(d([(1, None)]), q([(1, "!")])).collect() == []


def test_query_equals_sql(spark):
    tables = "/root/testdata/sf0.01"
    left, _, differences = compare(spark, connect(tables), search.op12_stratified_search, search.SQL, tables)
    assert not differences and len(left) == 40 * 20
