"""Vectors packed into blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def pack(rows: list) -> tuple[bytes, bytes]:
    """Lengths and components of vectors of any lengths.

    Components take four bytes where all of them are floats and eight otherwise, so
    nothing is rounded.
    """
    sizes = np.array([len(r) for r in rows], np.int32)
    flat = np.concatenate([np.asarray(r, np.float64) for r in rows]) if len(rows) else np.zeros(0)
    with np.errstate(over="ignore"):
        short = flat.astype(np.float32)
    return sizes.tobytes(), (short if (short == flat).all() else flat).tobytes()


def precise(vector: Column, kind: str) -> Column:
    """A vector column of type ``kind`` as floats if it holds floats, else as doubles."""
    return vector.cast("array<float>" if kind == "array<float>" else "array<double>")


def unpack(sizes: bytes, flat: bytes, dims: int = 0) -> np.ndarray:
    """A table of doubles, shorter vectors filled with zeros."""
    n = np.frombuffer(sizes, np.int32)
    total = int(n.sum())
    values = np.frombuffer(flat, np.float64 if total and len(flat) == 8 * total else np.float32)
    width = max(dims, int(n.max(initial=0)))
    if len(n) and (n == width).all():
        return values.reshape(len(n), width).astype(np.float64)
    out = np.zeros((len(n), width))
    at = 0
    for i, k in enumerate(n):
        out[i, :k] = values[at : at + k]
        at += k
    return out


def width(sizes: bytes) -> int:
    return int(np.frombuffer(sizes, np.int32).max(initial=0))
