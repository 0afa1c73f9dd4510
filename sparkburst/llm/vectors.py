"""Vector columns: rows that can take part, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` without those whose vector is null or holds null or non-finite components."""
    odd = F.exists(F.col(vector).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & ~odd)


def greatest_width(rows: DataFrame, vector: str) -> int:
    """The length of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size(vector))).first()[0] or 0


def padded_matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of numbers as a matrix of doubles; shorter rows end with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(column.offsets.to_numpy())
    if len(length) and (length == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(length), width))
    out[np.arange(width)[None, :] < length[:, None]] = values
    return out
