"""Arrow columns of vectors as numpy matrices, shared by the operators on vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors without null or non-finite components, for each dimension."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for dimension in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == dimension)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        matrix = flat.reshape(len(rows), dimension)  # null components are NaN
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            yield rows[good], matrix[good]


def is_finite(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def floors(matrix: np.ndarray, bound: int) -> np.ndarray:
    """``floor(1024 * x)`` of every component, cut to ``-bound .. bound``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(matrix * 1024), -bound, bound).astype(np.int64)
