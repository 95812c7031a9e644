"""Vectors as exact integers, and sums over all of them that stay small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest magnitude of an integer component: four times a squared distance then fits 64 bits,
#: for vectors of up to 256 components.
LIMIT = 1 << 25


def usable(column, scale: int, limit: int = LIMIT):
    """Column: whether a vector is given and every component is a finite number whose integer
    is within the limit."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(x.cast("double") * scale)) <= limit)
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, fits), F.lit(False))


def integers(column, scale: int):
    """Column: floor(scale * x) of each component, for usable vectors."""
    return F.transform(column, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def as_integers(column: pa.Array, dims: int, scale: int, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors of ``dims`` components, and their integers."""
    right = np.asarray(column.value_lengths().fill_null(-1)) == dims
    at = np.flatnonzero(right)
    flat = column.filter(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # NaN for null
    x = np.floor(flat.reshape(at.size, dims) * scale)
    with np.errstate(invalid="ignore"):
        good = (np.abs(x) <= limit).all(1)
    return at[good], x[good].astype(np.int64)


def floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each row of components; rows without vectors keep the old."""
    some = np.maximum(counts, 1)[..., None]
    return np.where(counts[..., None] > 0, np.floor_divide(sums, some), old)


SUMS = "k long, v long"


def sums_record(values: np.ndarray) -> pa.RecordBatch:
    """A task's sums as rows of SUMS, without the zeros."""
    flat = values.ravel()
    k = np.flatnonzero(flat)
    return pa.record_batch([pa.array(k), pa.array(flat[k])], names=["k", "v"])


def add_up(sums: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sums of all tasks: combined before and after a shuffle, so the driver gets one
    number for each cell of ``shape``."""
    out = np.zeros(int(np.prod(shape)), np.int64)
    found = sums.groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    out[found.column("k").to_numpy()] = found.column("v").to_numpy()
    return out.reshape(shape)
