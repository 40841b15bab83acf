"""Windows of an Arrow batch as one NumPy array."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def regular_windows(windows: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the regular windows, and their values by window, row and feature.

    Regular ones have ``length`` rows (as many as the batch's first window by default) of as many
    floating-point numbers as its first row, and no null; the others are left to the caller.
    """
    sizes, rows = _sizes(windows), windows.flatten()
    widths, values = _sizes(rows), rows.flatten()
    if not len(values) or not pa.types.is_floating(values.type):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0, 0))
    shape = (length or int(sizes[sizes > 0][0]), int(widths[widths > 0][0]))
    odd = widths != shape[1]
    if values.null_count:
        row_of = np.repeat(np.arange(len(rows)), np.maximum(widths, 0))
        odd[row_of[values.is_null().to_numpy(zero_copy_only=False)]] = True
    good = sizes == shape[0]
    good[np.repeat(np.arange(len(windows)), np.maximum(sizes, 0))[odd]] = False
    if not good.all():
        values = windows.filter(pa.array(good)).flatten().flatten()
    return np.flatnonzero(good), values.to_numpy(zero_copy_only=False).reshape(-1, *shape)


def array_column(n: int, at: np.ndarray, rows: np.ndarray) -> pa.Array:
    """``n`` arrays of doubles: ``rows`` at the places ``at``, null elsewhere."""
    lengths = np.zeros(n + 1, dtype=np.int32)
    lengths[at + 1] = rows.shape[1]
    missing = np.ones(n, dtype=bool)
    missing[at] = False
    values = pa.array(np.ascontiguousarray(rows, dtype=np.float64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), values, mask=pa.array(missing))
