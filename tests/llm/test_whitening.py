"""Whitening against plain Python whole numbers."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from slowlens.llm import whitening
from slowlens.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<double>, label int, key string, n int, deviation double"


def plain(vectors: list[list[float]]):
    """x, deviations and the exact covariance, by whole numbers of any size."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x)]
    d = [[n * a - s for a, s in zip(row, sums)] for row in x]
    pairs = range(len(sums))
    cov = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in pairs] for i in pairs]
    return x, sums, [sum(a * a for a in r) for r in d], np.array([[float(c) for c in row] for row in cov])


def check(spark, vectors, extra=(), components=32):
    rows = [(i, v, 0, "clash", 1, 0.5) for i, v in enumerate(vectors)] + list(extra)
    got = whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), components=components).orderBy("vec_id").collect()
    x, sums, deviations, cov = plain(vectors)
    e, q = np.linalg.eigh(cov)
    k = len(got[0]["whitened"])
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    assert [int(r["deviation"]) for r in got] == deviations
    assert all(r["n"] == len(vectors) for r in got)
    assert np.allclose(got[0]["explained"], e / np.trace(cov), rtol=1e-9)
    assert got[0]["identity_error"] < 1e-4
    w = np.array([r["whitened"] for r in got])
    expected = np.array([[float(Fraction(a) - Fraction(s, len(x))) for a, s in zip(row, sums)] for row in x]) @ q / np.sqrt(e)
    signs = np.sign((w * expected).sum(axis=0))
    assert np.allclose(w, expected * signs, atol=1e-8)
    assert np.abs(w.T @ w / len(w) - np.eye(k)).max() < 1e-6
    return got


def test_equals_plain_numbers(spark):
    r = np.random.default_rng(3)
    vectors = (r.normal(size=(300, 12)) * r.uniform(0.05, 2, 12)).tolist()
    nan, inf = float("nan"), float("inf")
    bad = [(900, None, 0, "", 1, 0.0), (901, [nan] * 12, 0, "", 1, 0.0), (902, [inf] + [0.0] * 11, 0, "", 1, 0.0), (903, [None] + [0.0] * 11, 0, "", 1, 0.0)]
    got = check(spark, vectors + vectors[:3], bad)
    assert len(got) == 303 and len(got[0]["whitened"]) == 12
    assert len(check(spark, vectors, components=5)[0]["whitened"]) == 5


@pytest.mark.parametrize("scale", [1e4, 1e9])
def test_large_values_stay_exact(spark, scale):
    vectors = (np.random.default_rng(4).normal(size=(200, 4)) * scale).tolist()
    check(spark, vectors)


def test_unequal_lengths_end_in_zeros(spark):
    r = np.random.default_rng(5)
    vectors = r.normal(size=(60, 5)).tolist()
    short = [v[: 2 + i % 4] for i, v in enumerate(vectors)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(short + [[]])], "vec_id long, embedding array<double>")
    full = spark.createDataFrame([(i, v + [0.0] * (5 - len(v))) for i, v in enumerate(short + [[]])], "vec_id long, embedding array<double>")
    assert sorted(map(str, whiten(rows).coalesce(1).collect())) == sorted(map(str, whiten(full).coalesce(1).collect()))


def test_without_variance_there_are_no_components(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[]]):
        rows = spark.createDataFrame([(None, v) for v in vectors], "vec_id long, embedding array<float>")
        assert whiten(rows).collect() == []


def test_query(spark, sf_dir):
    got = whitening.op13_polarised_whitening(spark, sf_dir).toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(table.embedding).astype(float)).astype(np.int64) + 1_000_000
    assert len(got) == 32 * len(x) and got.duplicated(["vec_id", "component"]).sum() == 0
    d = len(x) * x - x.sum(axis=0)
    first = got[got.component == 1].set_index("vec_id").loc[table.vec_id]
    assert (first.deviation.to_numpy() == (d * d).sum(axis=1)).all()
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, e[:32] / e.sum(), rtol=1e-6)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-4
