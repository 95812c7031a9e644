"""Matrix generators; values and patterns come from a hash of position, so that runs agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.functions.scalars import uniform_hash
from lacewing.plans.matrix import DenseMatrix, SparseMatrix

SCALE = 2147483648


def _value():
    """Thousandths in [-1000, 1000)."""
    return (uniform_hash(F.col("row"), F.col("col"), salt=7) % 2000 - 1000).cast("long")


def _matrix(cells: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
    return SparseMatrix(cells.select("row", "col", _value().alias("val")), n_rows, n_cols)


def uniform(spark: SparkSession, n_rows: int, n_cols: int, density: float, salt: int = 42) -> SparseMatrix:
    if not 0 <= density <= 1:
        raise ValueError(f"density {density} is not in [0, 1]")
    cells = spark.range(n_rows * n_cols).select(F.expr(f"id div {max(n_cols, 1)}").alias("row"), (F.col("id") % max(n_cols, 1)).alias("col"))
    return _matrix(cells.where(uniform_hash(F.col("row"), F.col("col"), salt=salt) < int(density * SCALE)), n_rows, n_cols)


def banded(spark: SparkSession, n_rows: int, n_cols: int, bandwidth: int) -> SparseMatrix:
    low, high = F.greatest(F.lit(0), F.col("id") - bandwidth), F.least(F.lit(n_cols - 1), F.col("id") + bandwidth)
    rows = spark.range(n_rows).where(low <= high)
    return _matrix(rows.select(F.col("id").alias("row"), F.explode(F.sequence(low, high)).alias("col")), n_rows, n_cols)


def block_diagonal(spark: SparkSession, n_rows: int, n_cols: int, block: int) -> SparseMatrix:
    n = min(n_rows, n_cols) // block
    if n < 1:
        raise ValueError(f"no block of {block} fits {n_rows} x {n_cols}")
    start = F.expr(f"id div {block}") * block
    cells = spark.range(n * block).select(F.col("id").alias("row"), F.explode(F.sequence(start, start + block - 1)).alias("col"))
    return _matrix(cells, n_rows, n_cols)


def power_law(spark: SparkSession, n_rows: int, n_cols: int, mean_degree: float, alpha: float = 2.5) -> SparseMatrix:
    """Degrees are 1 plus a Pareto number of shape ``alpha``, by a hash of the row, scaled to the
    mean over all rows, rounded half to even and kept in [1, n_cols]. A row's columns are the
    first distinct ones of a hashed sequence; where that is too short for a dense row, the
    columns of least hash. Work is in proportion to the entries."""
    u = (uniform_hash(F.col("id"), salt=11) + F.lit(0.5)) / SCALE
    raw = spark.range(n_rows).select(F.col("id").alias("row"), F.pow(u, F.lit(-1.0 / alpha)).alias("raw"))
    mean = F.broadcast(raw.agg((F.sum("raw") / F.count("*")).alias("mean")))  # one row
    degree = F.least(F.lit(n_cols), F.greatest(F.lit(1), F.rint(F.col("raw") * (F.lit(float(mean_degree)) / F.col("mean"))))).cast("int")
    rows = raw.crossJoin(mean).select("row", degree.alias("d"))
    tries = F.transform(F.sequence(F.lit(0), 3 * F.col("d") + 20), lambda i: uniform_hash(F.col("row"), i.cast("long"), salt=13) % n_cols)
    rows = rows.withColumn("cols", F.array_distinct(tries))
    ranked = F.transform(F.sequence(F.lit(0), F.lit(max(n_cols, 1) - 1)), lambda c: F.struct(uniform_hash(F.col("row"), c.cast("long"), salt=17).alias("h"), c.cast("long").alias("c")))
    dense = F.transform(F.array_sort(ranked), lambda x: x["c"])
    chosen = F.slice(F.when(F.size("cols") >= F.col("d"), F.col("cols")).otherwise(dense), F.lit(1), F.col("d"))
    return _matrix(rows.select("row", F.explode(chosen).alias("col")), n_rows, n_cols)


def dense(spark: SparkSession, n_rows: int, n_cols: int, salt: int = 43) -> DenseMatrix:
    j = F.sequence(F.lit(0), F.lit(n_cols - 1))
    values = F.transform(j, lambda x: (uniform_hash(F.col("id"), x.cast("long"), salt=salt) % 2000 - 1000).cast("long"))
    return DenseMatrix(spark.range(n_rows).select(F.col("id").alias("k"), values.alias("b")), n_rows, n_cols)
