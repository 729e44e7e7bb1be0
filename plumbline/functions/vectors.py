"""Cosine similarity, in double precision and in the order of the components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 1 << 12  # rows that are held in 64 bits at once


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns as an expression; 0 if either norm is 0."""
    zero = F.lit(0.0)
    times = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    square = lambda v: F.aggregate(v, zero, lambda s, x: s + x.cast("double") * x.cast("double"))
    dot, norms = F.aggregate(times, zero, lambda s, x: s + x), F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when(norms == 0, zero).otherwise(dot / norms)


def norms(x: np.ndarray) -> np.ndarray:
    """Norm of each row, summed in the order of components."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        own = x[:, d].astype(np.float64, copy=False)
        total += own * own
    return np.sqrt(total)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with each row of y; 0 where a norm is 0.

    Rows are vectorized and components are looped over, so that every sum has
    the same order whatever the batch, which a matrix product doesn't promise.
    """
    dot = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        dot += np.multiply.outer(x[:, d], y[:, d])
    scale = np.multiply.outer(norms(x), norms(y))
    return np.divide(dot, scale, out=np.zeros_like(dot), where=scale != 0)


def cosine_rows(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for rows i of x with rows j of y, one by one; nx and ny are their norms.  x and y may have 32 bits."""
    dot = np.zeros(len(i))
    for d in range(x.shape[1]):
        dot += x[i, d].astype(np.float64, copy=False) * y[j, d]
    scale = nx[i] * ny[j]
    return np.divide(dot, scale, out=np.zeros_like(dot), where=scale != 0)


def units(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of x by their norms n; zero rows stay zero."""
    return np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] != 0)


def short_units(x: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """units in 32 bits and, with rows of zeros at the end, of so many rows; no copy of all in 64 bits is made."""
    out = np.zeros((rows, x.shape[1]), np.float32)
    for a in range(0, len(x), PART):
        out[a : min(a + PART, len(x))] = units(x[a : a + PART].astype(np.float64, copy=False), n[a : a + PART])
    return out


def slack(dimension: int, kind: type = np.float64) -> float:
    """More than a product of units, taken in numbers of this kind, can be off from the cosine that cosines gives."""
    return 8 * (dimension + 8) * float(np.finfo(kind).eps)


def closest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The row of y of highest cosine for each row of x, the lowest number if tied.

    A matrix product decides where the best is clear, cosines where rounding could.
    """
    near = units(x, norms(x)) @ units(y, norms(y)).T
    best = near.argmax(axis=1)
    unclear = np.count_nonzero(near >= near.max(axis=1, initial=-2.0)[:, None] - slack(x.shape[1]), axis=1) > 1
    if unclear.any():
        best[unclear] = cosines(x[unclear], y).argmax(axis=1)
    return best


def matrix(column, dimension: int) -> np.ndarray:
    """Rows of doubles of an Arrow list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def rows_of(column, dimension: int) -> np.ndarray:
    """Rows of an Arrow list column without nulls, in chunks or not, in the numbers it has."""
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in getattr(column, "chunks", [column])]
    return (chunks[0] if len(chunks) == 1 else np.concatenate(chunks)).reshape(-1, dimension)
