"""Products over matrix patterns and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.operators import evaluate, multiply
from lacewing.sources import generate

# The parameters of each pattern in a sweep.
PATTERNS = {
    "uniform": lambda s, m: generate.uniform(s, m, m, 0.01),
    "banded": lambda s, m: generate.banded(s, m, m, 32),
    "block-diagonal": lambda s, m: generate.block_diagonal(s, m, m, 16),
    "power-law": lambda s, m: generate.power_law(s, m, m, 32, 2.5),
}


def pattern_sweep(spark: SparkSession, sizes, n: int, patterns=tuple(PATTERNS), strategy: str = "hybrid") -> DataFrame:
    """(pattern, m, nnz, cells, total): of each pattern and size the entries, and of the product
    with a generated dense matrix the cells and their sum. Unknown patterns raise."""
    rows = []
    for pattern in patterns:
        if pattern not in PATTERNS:
            raise ValueError(f"unknown pattern {pattern!r}; one of {', '.join(PATTERNS)}")
        for m in sizes:
            a = PATTERNS[pattern](spark, m)
            c = multiply.matmul(a, generate.dense(spark, m, n), strategy, dense_output=False)
            product = c.agg(F.count("*").alias("cells"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("total"))
            entries = a.entries.agg(F.count("*").alias("nnz"))
            rows.append(entries.crossJoin(product).select(F.lit(pattern).alias("pattern"), F.lit(m).alias("m"), "nnz", "cells", "total"))
    return reduce(DataFrame.union, rows)


def timed_sweep(spark: SparkSession, sizes, n: int, patterns=tuple(PATTERNS), strategies=("hybrid",), warmup: int = 1, runs: int = 3) -> DataFrame:
    """A result row for each pattern, size and strategy: pattern, kernel, m, k, n, nnz, density,
    time_ms and gflops."""
    rows = []
    for pattern in patterns:
        for m in sizes:
            a, b = PATTERNS[pattern](spark, m), generate.dense(spark, m, n)
            nnz = a.entries.count()
            for name in strategies:
                seconds, _ = evaluate.benchmark(lambda: multiply.STRATEGIES[name](a, b), warmup, runs)  # noqa: B023
                rows.append((pattern, name, m, m, n, nnz, nnz / (m * m), 1000 * seconds, 2.0 * nnz * n / max(seconds * 1e9, 1e-9)))
    return spark.createDataFrame(rows, "pattern string, kernel string, m int, k int, n int, nnz long, density double, time_ms double, gflops double")
