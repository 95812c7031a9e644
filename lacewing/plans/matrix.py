"""Matrices as relations.

A sparse matrix is a DataFrame of (row, col, val), one record for each stored entry; stored
zeros count. Duplicates are added when a matrix is made, so that every layout and strategy
agrees on them. A dense matrix is packed: (k, b), b an array of n numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16


@dataclass
class SparseMatrix:
    entries: DataFrame
    n_rows: int
    n_cols: int

    @staticmethod
    def from_entries(df: DataFrame, n_rows: int, n_cols: int) -> SparseMatrix:
        """Adds up duplicates of (row, col, val)."""
        return SparseMatrix(df.groupBy("row", "col").agg(F.sum("val").alias("val")), n_rows, n_cols)

    def slice_rows(self, begin: int, end: int) -> SparseMatrix:
        """Rows [begin, end), counted from 0 again."""
        if not 0 <= begin <= end <= self.n_rows:
            raise ValueError(f"rows [{begin}, {end}) of {self.n_rows}")
        kept = self.entries.where((F.col("row") >= begin) & (F.col("row") < end))
        return SparseMatrix(kept.withColumn("row", F.col("row") - begin), end - begin, self.n_cols)


@dataclass
class DenseMatrix:
    rows: DataFrame
    n_rows: int
    n_cols: int

    def long(self) -> DataFrame:
        return self.rows.select("k", F.posexplode("b").alias("j", "b"))

    def bytes(self) -> int:
        return 8 * self.n_rows * self.n_cols
