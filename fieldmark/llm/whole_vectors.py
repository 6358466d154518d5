"""Vectors of whole numbers: components scaled and rounded down, and products that stay exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest whole number that doubles hold with all its neighbours, and the largest taken for 64-bit sums.
DOUBLE, LONG = 1 << 53, 1 << 62


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null for a null vector or one that holds null or
    non-finite components."""
    x = vector.cast("array<double>")
    broken = x.isNull() | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~broken, F.transform(x, lambda v: F.floor(v * scale)))


def matrix(rows: pd.Series) -> np.ndarray:
    """One row per vector of a column; all of one length."""
    return np.stack(rows.to_numpy()).astype(np.int64) if len(rows) else np.zeros((0, 0), np.int64)


def exact(limit: int, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in a type in which results up to ``limit`` are exact: doubles, whose products are
    fast, while they reach, else 64-bit integers."""
    if limit >= LONG:
        raise ValueError("components are too large for exact 64-bit results")
    return [a.astype(np.float64 if limit < DOUBLE else np.int64) for a in arrays]


def largest(*arrays: np.ndarray) -> int:
    return max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
