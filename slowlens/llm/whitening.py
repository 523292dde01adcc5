"""Whitening of embeddings by polarisation.

Entries become whole numbers ``x = floor(64 c) + 1000000``.  With ``n`` vectors and sums
``S`` the values ``d = n x - S`` are whole, centred and exact.  One pass sums the squares
of every ``d_i`` and of every ``d_i + d_j``; since ``(d_i + d_j)^2 - d_i^2 - d_j^2`` is
``2 d_i d_j``, differences of these variances are the cross-covariances, still as whole
numbers.  Only then the matrix is rounded once and given to ``eigh``.

Tasks add squares up in 64-bit pieces of 21 bits (in whole numbers of any size where those
do not suffice) and send one row per pair of dimensions; what reaches the driver is
bounded by the square of the dimension and does not grow with the rows.  There are four
scans of two columns and no shuffle of vectors; every pass can be recomputed.

Vectors that are null or hold null, NaN or infinite entries are dropped.  A vector shorter
than the longest ends in zeros, an empty one is all zeros; entries beyond 2^39 count as 2^39.
Rows with equal or null ids, and equal vectors, count and are returned each.  Components
whose share of the variance is under 1e-10 cannot be scaled to one and are left out, so a
single vector, equal vectors and an empty table give no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import table
from slowlens.llm.vectors import finite, matrix

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = float(1 << 45)
LEAST_SHARE = 1e-10
ROWS = 1 << 12
PIECE = 21
SPLIT = 10**18


def _whole(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    values, lengths = matrix(column, width)
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + SHIFT, lengths


def _sums(batches):
    """Per batch and dimension: how many rows have it, their sum, least and greatest; dimension -1 counts rows."""
    for batch in batches:
        x, lengths = _whole(batch.column(0))
        for at in range(0, len(x), ROWS):
            part, has = x[at : at + ROWS], np.arange(x.shape[1]) < lengths[at : at + ROWS, None]
            n = has.sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(-1, len(n)), pa.int32()),
                    pa.array(np.append(len(part), n), pa.int64()),
                    pa.array(np.append(0, np.where(has, part, 0).sum(axis=0)), pa.int64()),
                    pa.array(np.append(SHIFT, part.min(axis=0)), pa.int64()),
                    pa.array(np.append(SHIFT, part.max(axis=0)), pa.int64()),
                ],
                names=["dimension", "n", "total", "least", "greatest"],
            )


class Centre:
    """``n``, the sums ``S`` and, for any rows, the exact ``d = n x - S``."""

    def __init__(self, rows: list):
        by = {r["dimension"]: r for r in rows}
        self.n = by[-1]["n"] if by else 0
        self.width = max(by, default=-1) + 1
        sums = [int(by[i]["total"]) + (self.n - by[i]["n"]) * SHIFT for i in range(self.width)]
        self.near = [round(s / self.n) for s in sums]
        self.rest = [s - self.n * r for s, r in zip(sums, self.near)]
        far = [max(by[i]["greatest"] - r, r - by[i]["least"], abs(SHIFT - r)) for i, r in enumerate(self.near)]
        self.most = max((self.n * f + abs(s) for f, s in zip(far, self.rest)), default=0)

    def deviations(self, column: pa.Array) -> np.ndarray:
        x, _ = _whole(column, self.width)
        y = x - np.array(self.near, np.int64).reshape(1, -1)
        if 2 * self.most >= 1 << 61:
            return y.astype(object) * self.n - np.array(self.rest, object).reshape(1, -1)
        return y * self.n - np.array(self.rest, np.int64).reshape(1, -1)

    def square_total(self, e: np.ndarray) -> list[int]:
        """Sums of squares of each column of at most ``ROWS`` rows, exact."""
        if e.dtype == object:
            return [int(v) for v in (e * e).sum(axis=0)]
        if 2 * self.most < 1 << 25:
            return [int(v) for v in (e * e).sum(axis=0)]
        mask = (1 << PIECE) - 1
        a, b, c = e >> (2 * PIECE), (e >> PIECE) & mask, e & mask
        parts = [(x * y).sum(axis=0) for x, y in ((a, a), (a, b), (a, c), (b, b), (b, c), (c, c))]
        return [
            (int(aa) << (4 * PIECE)) + (int(ab) << (3 * PIECE + 1)) + (int(ac) << (2 * PIECE + 1)) + (int(bb) << (2 * PIECE))
            + (int(bc) << (PIECE + 1)) + int(cc)
            for aa, ab, ac, bb, bc, cc in zip(*parts)
        ]

    def squares(self, batches):
        """Per task and pair of dimensions ``i <= j``: the sum of ``(d_i + d_j)^2``, for ``i = j`` of ``d_i^2``."""
        total = [[0] * (self.width - i) for i in range(self.width)]
        for batch in batches:
            d = self.deviations(batch.column(0))
            for at in range(0, len(d), ROWS):
                part = d[at : at + ROWS]
                for i, sums in enumerate(total):
                    e = part[:, i:] + part[:, i : i + 1]
                    e[:, 0] = part[:, i]
                    total[i] = [x + y for x, y in zip(sums, self.square_total(e))]
        for i, sums in enumerate(total):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i] * len(sums), pa.int32()),
                    pa.array(range(i, self.width), pa.int32()),
                    pa.array([str(v // SPLIT) for v in sums], pa.string()),
                    pa.array([v % SPLIT for v in sums], pa.int64()),
                ],
                names=["i", "j", "high", "low"],
            )

    def covariance(self, rows: list) -> np.ndarray:
        """From the sums of squares, exact up to one rounding per entry."""
        square = {(r["i"], r["j"]): int(r["high"]) * SPLIT + int(r["low"]) for r in rows}
        out = np.zeros((self.width, self.width))
        for (i, j), s in square.items():
            both = 2 * s if i == j else s - square[i, i] - square[j, j]
            out[i, j] = out[j, i] = both / (2 * self.n**3)
        return out


def _components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each positive."""
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > LEAST_SHARE * max(np.trace(v), 0.0)]
    e, q = e[order], q[:, order]
    top = q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] if q.size else np.ones(0)
    return e, q * np.sign(top)


def _spread(batches):
    """Per task: rows, means and sums of centred products of ``whitened``, merged batch by batch."""
    n, mean, m2 = 0, 0.0, 0.0
    for batch in batches:
        w, _ = matrix(batch.column("whitened"))
        if not len(w):
            continue
        own = w.mean(axis=0)
        step, more = own - mean, n + len(w)
        m2 = m2 + (w - own).T @ (w - own) + np.outer(step, step) * (n * len(w) / more)
        mean, n = mean + step * (len(w) / more), more
    if n:
        i, j = np.indices(m2.shape)
        columns = [[n] * m2.size, i.ravel(), j.ravel(), mean[i].ravel(), mean[j].ravel(), m2.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["n", "i", "j", "mi", "mj", "m2"])


def _identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest entry of the covariance of the whitened rows less the identity, measured on those rows."""
    parts = whitened.select("whitened").mapInArrow(_spread, "n long, i long, j long, mi double, mj double, m2 double")
    sums = parts.groupBy("i", "j").agg(
        F.sum("m2").alias("m2"),
        F.sum(F.col("n") * F.col("mi") * F.col("mj")).alias("mm"),
        F.sum(F.col("n") * F.col("mi")).alias("si"),
        F.sum(F.col("n") * F.col("mj")).alias("sj"),
    )
    out = np.zeros((k, k))
    for r in sums.collect():  # k^2 rows
        out[r["i"], r["j"]] = (r["m2"] + r["mm"] - r["si"] * r["sj"] / n) / n
    return float(np.abs(out - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """``(key, n, deviation, whitened array, explained array, identity_error)`` for every usable vector."""
    used = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(finite(F.col("vector")))
    sums = used.select("vector").mapInArrow(_sums, "dimension int, n long, total long, least long, greatest long")
    centre = Centre(
        sums.groupBy("dimension")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("total").cast("decimal(38,0)")).alias("total"),
            F.min("least").alias("least"),
            F.max("greatest").alias("greatest"),
        )
        .collect()  # a row per dimension
    )
    squares = used.select("vector").mapInArrow(centre.squares, "i int, j int, high string, low long")
    v = centre.covariance(
        squares.groupBy("i", "j")
        .agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
        .collect()  # a row per pair of dimensions
    )
    e, q = _components(v, components)
    scaled = q / np.sqrt(e)

    def projected(batches):
        for batch in batches:
            d = centre.deviations(batch.column("vector"))
            small = centre.most**2 * max(1, centre.width) < 1 << 63
            deviation = (d * d if small else d.astype(object) ** 2).sum(axis=1)
            w = (d / centre.n).astype(np.float64) @ scaled
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([str(x) for x in deviation], pa.string()),
                    pa.ListArray.from_arrays(np.arange(0, w.size + 1, max(1, len(e)))[: len(w) + 1].astype(np.int32), w.ravel()),
                ],
                names=["key", "deviation", "whitened"],
            )

    kind = used.schema["key"].dataType.simpleString()
    none = len(e) == 0
    out = (used.limit(0) if none else used).mapInArrow(projected, f"key {kind}, deviation string, whitened array<double>")
    error = 0.0 if none else _identity_error(out, centre.n, len(e))
    shares = e / np.trace(v) if len(e) else e
    return out.select(
        F.col("key").alias(key),
        F.lit(centre.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        F.array(*[F.lit(float(s)) for s in shares]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


@query("op13_polarised_whitening")
def op13_polarised_whitening(spark, sf_dir):
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        F.col("deviation").cast("long").alias("deviation"),
        F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"),
        "identity_error",
    )
