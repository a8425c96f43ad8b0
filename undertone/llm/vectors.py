"""Vector columns in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def usable(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, vectors as doubles) of the vectors that are not null or empty and hold only finite numbers."""
    if len(column) == 0:
        return np.zeros(0, np.int64), []
    lists = column.cast(pa.list_(pa.float64()))
    offsets = lists.offsets.to_numpy()
    valid = np.ones(len(lists), bool) if not lists.null_count else lists.is_valid().to_numpy(zero_copy_only=False)
    flat = lists.values.to_numpy(zero_copy_only=False)  # a null component becomes NaN
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    good = valid & (np.diff(offsets) > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(good)
    return rows, [flat[offsets[r] : offsets[r + 1]] for r in rows]


def matrix(packed: list[bytes], kind: str = "<f8") -> np.ndarray:
    """One row for each packed vector; all have the same length."""
    return np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1)
