"""Vectors out of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_of(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``dims`` components, none null, NaN or infinite: their positions and their float64 matrix."""
    lengths = np.asarray(column.value_lengths().fill_null(-1), dtype=np.int64)
    values = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    broken = np.bincount(row, weights=~np.isfinite(values), minlength=len(lengths)) > 0
    good = (lengths == dims) & ~broken & (lengths > 0)
    return np.flatnonzero(good), values[good[row]].reshape(-1, max(dims, 1))


def common_size(df: DataFrame, vector: str) -> int:
    """The most frequent length of a vector, the longer one on a tie; 0 without any."""
    sizes = df.select(F.size(vector).alias("s")).where("s > 0").groupBy("s").count()
    found = sizes.orderBy(F.desc("count"), F.desc("s")).first()
    return int(found["s"]) if found else 0
