"""NN-descent against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from compare import connect, rows_of
from slowlens.llm import near_vectors as near

SCHEMA = "vec_id long, embedding array<float>, label int, node long, k1 string"


def vectors(seed=2, noise=1500, dims=32):
    """Noise, groups of near copies, a chain, copies, multiples and rows that link with nothing."""
    r = np.random.default_rng(seed)
    out = list(r.normal(size=(noise, dims)))
    for size, spread in ((2, 0.2), (2, 0.4), (5, 0.25), (40, 0.3), (300, 0.2), (200, 0.38)):
        base = r.normal(size=dims)
        out += [base + spread * r.normal(size=dims) * np.linalg.norm(base) / math.sqrt(dims) for _ in range(size)]
    a, b = np.linalg.qr(r.normal(size=(dims, 2)))[0].T
    out += [math.cos(t) * a + math.sin(t) * b for t in np.arange(0, 3, 0.2)]  # neighbours and next but one are linked
    out += [out[3]] * 4 + [out[5] * 7.5, out[6] * -1.0]
    out = [v.astype(np.float32).tolist() for v in out]
    return out + [[0.0] * dims, [], None, [float("nan")] + out[7][1:], [None] + out[8][1:], out[9][: dims // 2], out[9][: dims // 2] + [0.0] * (dims // 2)]


def brute(rows, threshold=0.9):
    """{row: (links, component)} by all pairs."""
    ok = [i for i, v in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    linked = {i: set() for i in range(len(rows))}
    for size in {len(rows[i]) for i in ok}:
        ids = np.array([i for i in ok if len(rows[i]) == size])
        unit = np.array([rows[i] for i in ids], float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for i, line in zip(ids, unit @ unit.T >= threshold):
            linked[int(i)] |= set(ids[line].tolist()) - {int(i)}
    root = {}
    for i in range(len(rows)):
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += linked[j] - root.keys()
    return {i: (len(linked[i]), root[i]) for i in range(len(rows))}


@pytest.mark.parametrize("block", [near.BLOCK, 32])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near.count_links, "__defaults__", (block,))
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 5, "x") for i, v in enumerate(rows)], SCHEMA).repartition(7)
    got = {r["vec_id"]: r for r in near.near_vectors(df).collect()}
    wanted = brute(rows)
    assert len(got) == len(rows)
    found = {i: (r["n_links"], r["component_id"]) for i, r in got.items()}
    wrong = {i for i in wanted if found[i] != wanted[i]}
    assert sum(n for n, _ in found.values()) >= 0.98 * sum(n for n, _ in wanted.values())
    assert all(found[i][0] <= wanted[i][0] for i in wanted)
    assert len(wrong) <= 0.01 * len(rows)
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert got[0]["recall"] >= near.RECALL


def test_counts_need_no_list_of_pairs(spark):
    rows = vectors(noise=0)
    ids = [i for i, (_, root) in brute(rows).items() if rows[i] and len(rows[i]) == 32 and all(rows[i])]
    by = brute([rows[i] for i in ids])
    members = spark.createDataFrame([(by[k][1], k, 1 + k % 3, rows[i]) for k, i in enumerate(ids)], "root long, node long, copies long, vector array<double>")
    unit = np.array([rows[i] for i in ids], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    expected = dict(enumerate((linked @ np.array([1 + k % 3 for k in range(len(ids))])).tolist()))
    for block in (16, 100, 10_000):
        assert {r["node"]: r["links"] for r in near.count_links(members, 0.9, block).collect()} == expected


def test_null_and_equal_ids(spark):
    a, b = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    rows = [(None, a), (None, a), (4, a), (2, [2.0, 0.0, 0.4]), (7, b), (7, [0.0, 3.0, 0.0]), (None, None), (9, [0.0] * 3)]
    got = near.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).drop("recall").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(None, 3, 2, False)] * 2 + [(4, 3, 2, False), (2, 3, 2, True), (7, 1, 7, True), (7, 1, 7, True), (None, 0, None, True), (9, 0, 9, True)], key=str
    )


def test_empty(spark):
    assert near.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_query_equals_sql(spark, sf_dir):
    df = near.op11_nn_descent(spark, sf_dir)
    cur = connect(sf_dir).execute(near.SQL)
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())
