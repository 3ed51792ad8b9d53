"""Numpy kernels over blocks of vectors, and the Arrow plumbing around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Similarities are compared at this many digits, so that the order in which a
# product was summed cannot decide a tie or a threshold.
SIM_DIGITS = 12
# Wider than what rounding can move a similarity.
_REACH = 1e-11
# Rows of the left block multiplied at a time, and products of one slice; they bound the dense
# intermediate, also where every product is near enough to be looked at.
_SLICE = 512
_CELLS = 1 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; zero rows stay zero."""
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0.0, 1.0, norms)


def int64(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array)
                      else column.to_numpy(), dtype=np.int64)


def similarity_slices(left: np.ndarray, right: np.ndarray):
    """``(start, sims)`` for slices of the left rows against all right rows, not yet rounded."""
    step = max(1, min(_SLICE, _CELLS // max(1, len(right))))
    for start in range(0, len(left), step):
        yield start, left[start : start + step] @ right.T


def rounded(sims: np.ndarray) -> np.ndarray:
    return np.round(sims, SIM_DIGITS)


def near_pairs(sims: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(rows, columns, rounded similarity)`` of the entries that may reach ``bound``.

    Rounding is slow, so it is only done for entries within reach.
    """
    rows, cols = np.nonzero(sims >= bound - _REACH)
    return rows, cols, rounded(sims[rows, cols])


def best_of(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and rounded values of the ``k`` best by (similarity descending, id ascending)."""
    if len(sims) > k:
        # Everything that may tie with the k-th after rounding stays in the running.
        bar = np.partition(sims, len(sims) - k)[len(sims) - k]
        keep = np.flatnonzero(sims >= bar - _REACH)
    else:
        keep = np.arange(len(sims))
    values = rounded(sims[keep])
    order = np.lexsort((ids[keep], -values))[:k]
    return keep[order], values[order]
