"""What the operators on vectors share: rows with whole, finite vectors, and their components as bounded integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(vector: str | Column) -> Column:
    """Whether a vector is there and each of its components is a finite number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def integers(vector: str | Column, scale: int, limit: int) -> Column:
    """⌊scale · x⌋ of each component, x as a double; what lies beyond ±`limit` counts as ±`limit`."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(float(-limit))), F.lit(float(limit)))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix; shorter ones are filled up with zeros."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out
