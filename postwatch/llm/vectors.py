"""What the operators on embeddings share: usable rows, padded matrices, whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 256
#: Bytes of a matrix that one step works on.
SLICE_BYTES = 4 << 20


def usable(column: str = "embedding") -> Column:
    """Neither null nor with null or non-finite components."""
    return F.coalesce(F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) < F.lit(float("inf")))), F.lit(False))


def extent(rows: DataFrame, column: str = "embedding") -> tuple[int, float]:
    """Widest vector and largest absolute component of usable rows; zeros for an empty table."""
    width, most = rows.agg(F.max(F.size(column)), F.max(F.greatest(
        F.array_max(column), -F.array_min(column)))).first()
    return int(width or 0), float(most or 0)


def slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts whose vectors take at most SLICE_BYTES as doubles."""
    step = max(1, SLICE_BYTES // (8 * max(1, width)))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors continue with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as 64-bit integers; what is beyond them becomes the nearest that fits."""
    edge = float(2 ** 63 - 1024)
    return np.clip(np.floor(SCALE * values), -edge, edge).astype(np.int64)
