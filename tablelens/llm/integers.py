"""Vectors of whole numbers: floors of scaled components, exact inner products."""

from __future__ import annotations

import numpy as np

SCALE = 256
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale x) as doubles, which hold it exactly; beyond the range of doubles, its end."""
    with np.errstate(over="ignore"):
        found = np.floor(vectors.astype(np.float64) * scale)
    limit = np.finfo(np.float64).max
    return np.clip(found, -limit, limit)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both, exact; those beyond a 64-bit integer become the nearest one.

    Doubles hold sums below 2^53, 64-bit integers those below 2^63; larger
    ones are computed in Python's integers.
    """
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = _integers(a) @ _integers(b).T
    return np.array([[min(max(x, _LEAST), _MOST) for x in row] for row in exact.tolist()], np.int64).reshape(len(a), len(b))


def _integers(a: np.ndarray) -> np.ndarray:
    out = np.empty(a.shape, object)
    out[...] = [[int(x) for x in row] for row in a.tolist()]
    return out
