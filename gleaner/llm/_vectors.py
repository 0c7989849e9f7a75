"""Vectors in Arrow batches as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def valid(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None where it is null, empty, or has null or non-finite components."""
    out: list[np.ndarray | None] = []
    values, offsets = column.values, column.offsets.to_numpy()
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.isfinite(flat)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out.append(flat[a:b] if present[i] and b > a and good[a:b].all() else None)
    return out


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """Binary vectors of equal length as rows of a matrix."""
    return np.stack([np.frombuffer(x, kind) for x in column.to_pylist()])
