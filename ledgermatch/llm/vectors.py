"""Vectors in columns of lists: which rows are usable, and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(column: str) -> Column:
    """Holds for vectors that are not null or empty and whose components are all finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.coalesce((F.size(column) > 0) & ~F.exists(column, bad), F.lit(False))


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length as a matrix."""
    n = len(column)
    return np.asarray(column.flatten(), kind).reshape(n, -1) if n else np.zeros((0, 0), kind)
