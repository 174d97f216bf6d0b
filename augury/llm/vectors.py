"""Vectors between Spark and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from augury.llm.common import spread, starts_of


def dimension(df: DataFrame, vector: str) -> int:
    """The most common length; vectors of another length count as unusable. 0 if there are none."""
    size = F.size(vector).alias("d")
    row = df.where(F.size(vector) > 0).groupBy(size).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors as float64 rows, and which rows of the column they are: all of d finite numbers, not all zero."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(sizes == d) if d else np.zeros(0, np.int64)
    out = values[spread(starts_of(sizes)[:-1][rows], sizes[rows])].reshape(len(rows), d)
    good = np.isfinite(out).all(axis=1) & (out != 0).any(axis=1)
    return out[good], rows[good]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added in order of the components, so that equal rows give equal sums."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
