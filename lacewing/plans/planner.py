"""Choice of a layout from how the stored entries cluster into 16 by 16 blocks."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matrix import BLOCK, SparseMatrix

THRESHOLD = 2.0

#: Most blocks of a grid that are counted by bits: 32 MB a task at most, a bitmap of 4 KB at a time.
MOST_BITS = 1 << 28

REASONS = {
    "unaligned": "N not a multiple of 16 -> row-wise",
    "dense": "fill-in within threshold -> blocked",
    "sparse": "fill-in above threshold -> row-wise",
}


class Backend(Enum):
    CSR = "csr"
    BLOCK = "wmma"


@dataclass
class Plan:
    backend: Backend
    fill_in_ratio: float
    block_density: float
    threshold: float
    n_aligned: bool
    reason: str


def block_stats(m: SparseMatrix, bits: bool | None = None) -> DataFrame:
    """One row: n_blocks, stored_elements, original_nnz, fill_in_ratio, block_density. Blocks
    are counted, never built. An empty matrix has ratio 0.

    With ``bits`` a block is a bit at its number in the grid, and tasks shuffle bitmaps, whose size
    is that of the grid; otherwise they shuffle a row for each block that they saw, which is less
    for a large grid with few entries. Left out, the grid's size decides. Both count exactly."""
    across = -(-m.n_cols // BLOCK)
    grid = -(-m.n_rows // BLOCK) * across
    n = F.count("*").alias("n")
    if grid <= MOST_BITS if bits is None else bits:
        number = F.expr(f"(row div {BLOCK}) * {across}L + col div {BLOCK} + 1")
        seen = F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("seen")
        found = m.entries.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(seen, n)
        n_blocks = F.coalesce(F.sum(F.bitmap_count("seen")), F.lit(0).cast("long"))
    else:
        found = m.entries.groupBy(F.expr(f"row div {BLOCK}").alias("br"), F.expr(f"col div {BLOCK}").alias("bc")).agg(n)
        n_blocks = F.count("*")
    total = found.agg(n_blocks.alias("n_blocks"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("original_nnz"))
    stored = F.col("n_blocks") * BLOCK * BLOCK
    return total.select(
        "n_blocks",
        stored.alias("stored_elements"),
        "original_nnz",
        F.when(F.col("original_nnz") > 0, stored / F.col("original_nnz")).otherwise(0.0).alias("fill_in_ratio"),
        (F.col("n_blocks") / F.lit(float(grid)) if grid else F.lit(0.0)).alias("block_density"),
    )


def plan_row(stats: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """The choice as one row; a width off 16 is reported before high fill-in."""
    aligned = n > 0 and n % BLOCK == 0
    low = F.col("fill_in_ratio") <= threshold
    return stats.select(
        F.when(F.lit(aligned) & low, F.lit("wmma")).otherwise(F.lit("csr")).alias("backend"),
        "fill_in_ratio",
        "block_density",
        F.lit(float(threshold)).alias("threshold"),
        F.lit(aligned).alias("n_aligned"),
        F.when(F.lit(not aligned), F.lit(REASONS["unaligned"]))
        .when(low, F.lit(REASONS["dense"]))
        .otherwise(F.lit(REASONS["sparse"]))
        .alias("reason"),
    )


def choose(m: SparseMatrix, n: int, threshold: float = THRESHOLD) -> Plan:
    row = plan_row(block_stats(m), n, threshold).first()
    return Plan(Backend(row["backend"]), row["fill_in_ratio"], row["block_density"], row["threshold"], row["n_aligned"], row["reason"])
