"""Column functions of the engine; all but ``ordered_bits`` are built-in expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def ceil_div(a, b) -> Column:
    """Integer ceiling of a / b for whole numbers, b positive."""
    return F.expr(f"({a} + {b} - 1) div {b}")


def to_half(x: Column) -> Column:
    """The nearest half-precision number, ties to even, as a double: subnormals are kept and
    magnitudes of 65520 or more become infinite."""
    x = x.cast("double")
    size = F.abs(x)
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    near = F.rint(x / step) * step
    return (
        F.when(x.isNull() | F.isnan(x) | (x == 0), x)
        .when(size >= 65520, F.signum(x) * F.lit(float("inf")))
        .otherwise(near)
    )


@F.pandas_udf(LongType())
def _ordered_bits(x: pd.Series) -> pd.Series:
    x = x.to_numpy("f8", na_value=np.nan)
    bits = x.view("i8")
    bits = np.where(bits < 0, -(bits & np.int64(2**63 - 1)), bits)
    return pd.Series(np.where(np.isnan(x), np.int64((2047 << 52) + 1), bits))


def ordered_bits(x: Column) -> Column:
    """A double as a whole number in the same order: the bits of its size (biased exponent and
    fraction), negative for negative numbers. Both zeros are 0; NaN is above infinity. A view in NumPy
    by Arrow batches: an expression by logarithms and powers costs a hundred times as much. Workers must
    find this package (``ship``)."""
    return F.when(x.isNotNull(), _ordered_bits(x))


def upper_median(x: str) -> Column:
    """Element n // 2 of the sorted values, not a mean of two; 0 for none."""
    return F.expr(f"coalesce(CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC) AS DOUBLE), 0.0D)")


def gflops(nnz, n, ms) -> Column:
    return 2.0 * nnz * n / (ms * 1e6)


def strategy_label(name: Column) -> Column:
    """A chosen strategy is reported as hybrid[...]: one label for all."""
    return F.when(name.startswith("hybrid"), F.lit("hybrid")).otherwise(name)


def uniform_hash(*keys, salt: int = 42) -> Column:
    """A whole number in [0, 2**31) from whole-number keys by modular arithmetic that SQL
    engines share."""
    h = F.lit(salt).cast("long")
    for k in keys:
        h = ((h * 1103515245 + k * 2654435761 + 12345) % 2147483648).cast("long")
        h = ((h * 69069 + (h / 65536).cast("long")) % 2147483648).cast("long")
    return h
