"""Vectors in Arrow batches: which rows count, and their matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def finite(vector: Column) -> Column:
    """True for arrays that hold neither null nor a value that is not finite (NaN sorts above infinity)."""
    entry = lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, entry), F.lit(False))


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Doubles of a list column, a row each, and the lengths; rows shorter than ``width`` (or the longest) end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths
