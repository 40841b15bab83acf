"""Vectors of a table as NumPy matrices, with the rows that take no part told apart."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

#: Vectors from which directions are learnt, at most about; taken by a hash of the vector.
SAMPLE_VECTORS = 16_000


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite numbers."""
    numbers = vector.cast("array<double>")
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(numbers, lambda x: x != 0.0), F.lit(False))


def vector_sizes(rows: DataFrame, vector: str) -> list[int]:
    """The numbers of components that occur, ascending; vectors are compared with those of their own size.

    A table of embeddings has as many sizes as models made it; each size is worked on for itself.
    """
    return sorted(row["size"] for row in rows.select(F.size(vector).alias("size")).distinct().collect())


def sampled(rows: DataFrame, vector: str, size: int, most: int = SAMPLE_VECTORS) -> np.ndarray:
    """A bounded sample of the vectors for the driver, the same on every run."""
    count = rows.count()
    if not count:
        return np.zeros((0, size))
    share = F.pmod(F.xxhash64(vector), F.lit(1 << 30)) < int(min(1.0, most / count) * (1 << 30))
    found = rows.where(share).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    if not found.num_rows:
        found = rows.limit(1).select(F.col(vector).cast("array<double>").alias("v")).toArrow()
    return matrix(found.combine_chunks()["v"].chunk(0), size)


def matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def directions(sample: np.ndarray, count: int) -> np.ndarray:
    """Principal directions of a sample as orthonormal columns, the widest first."""
    size = sample.shape[1]
    if len(sample) < 2:
        return np.eye(size)[:, :count]
    centred = sample - sample.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :count]
