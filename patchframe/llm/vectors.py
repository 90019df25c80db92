"""Vectors of patches as packed blocks of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix_groups(column: pa.Array):
    """For each length among the lists of ``column``: row numbers and their matrix in double precision.

    Rows that are null, empty, or hold null or non-finite components are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    ok = np.asarray(column.is_valid())
    off = np.asarray(column.offsets)
    flat = column.values
    start, size = off[:-1].astype(np.int64), np.diff(off).astype(np.int64)
    value = np.asarray(flat.fill_null(np.nan) if flat.null_count else flat, dtype=np.float64)
    for d in np.unique(size[ok & (size > 0)]):
        rows = np.flatnonzero(ok & (size == d))
        M = value[start[rows][:, None] + np.arange(d)]
        fine = np.isfinite(M).all(axis=1)
        if fine.any():
            yield int(d), rows[fine], M[fine]


def unpack(data: bytes, kind, d: int = 0) -> np.ndarray:
    a = np.frombuffer(data, kind)
    return a.reshape(-1, d) if d else a
