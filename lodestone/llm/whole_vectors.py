"""Vectors of embeddings as whole numbers, for operators whose results are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Float64 holds every whole number below this one, so BLAS adds products exactly in any order.
EXACT = 2**53


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose vector is there and holds neither nulls nor anything but finite numbers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("embedding").isNotNull() & fine)


def extent(rows: DataFrame, factor: int) -> tuple[int, int]:
    """The longest vector, and a bound of all whole numbers; vectors too large for exact long results are an error."""
    size = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    dim, most = rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)), F.coalesce(F.max(size), F.lit(0.0))).first()
    bound = int(most * factor) + 1
    if dim * (2 * bound) ** 2 >= 2**62:
        raise ValueError(f"components of up to {most} are too large: sums of products would not fit a long")
    return dim, bound


def whole(vectors: pa.Array, factor: int, dim: int) -> np.ndarray:
    """floor(factor * x) of each component as int64, one row a vector; short vectors end in zeros."""
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor).astype(np.int64)
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """a @ b.T in whole numbers: in float64 where that is exact, which it is for all but huge components."""
    if a.shape[1] * bound * bound < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def blob(a: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def unblob(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of width numbers each as rows of an array of its own."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()
