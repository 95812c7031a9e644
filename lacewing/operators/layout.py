"""Layouts of a sparse matrix and the nonzero-balanced row split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lacewing.functions.scalars import to_half
from lacewing.plans.matrix import BLOCK, SparseMatrix


def all_rows(m: SparseMatrix) -> DataFrame:
    return m.entries.sparkSession.range(m.n_rows).select(F.col("id").alias("row"))


def csr_rows(m: SparseMatrix) -> DataFrame:
    """(row, cols, vals): each row's entries by ascending column."""
    packed = m.entries.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "val"))).alias("e"))
    return packed.select("row", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))


def row_counts(m: SparseMatrix) -> DataFrame:
    counts = m.entries.groupBy("row").agg(F.count("*").alias("n"))
    return all_rows(m).join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))


def row_ptr(m: SparseMatrix, rows_per_slice: int = 65_536) -> DataFrame:
    """(row, n, ptr): entries before each row. Sums run within slices of rows; only the
    slices' totals are summed in one task."""
    sliced = row_counts(m).withColumn("slice", F.expr(f"row div {rows_per_slice}"))
    before = W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    totals = sliced.groupBy("slice").agg(F.sum("n").alias("t"))
    totals = totals.select("slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("slice").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    inside = sliced.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return inside.join(totals, "slice").select("row", "n", (F.col("base") + F.col("inside")).alias("ptr"))


def bsr_blocks(m: SparseMatrix, half: bool = False) -> DataFrame:
    """(br, bc, block): an array of 256 values, row by row, zero where nothing is stored. A block is put
    together from its cells in order and the runs of zeros between them; two entries of a cell are an error."""
    value = to_half(F.col("val")) if half else F.col("val")
    kind = F.lit(0).cast("double" if half else m.entries.schema["val"].dataType)
    placed = m.entries.select(
        F.expr(f"row div {BLOCK}").alias("br"), F.expr(f"col div {BLOCK}").alias("bc"),
        F.expr(f"CAST((row % {BLOCK}) * {BLOCK} + col % {BLOCK} AS INT)").alias("at"), F.coalesce(value, kind).alias("v"),
    )
    # A given number of parts: a block is much larger than its entries.
    placed = placed.repartition(int(m.entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "br", "bc")
    found = placed.groupBy("br", "bc").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("cells"))
    size = BLOCK * BLOCK

    def filled(cells: Column) -> Column:
        end = F.array(F.struct(F.lit(size).alias("at"), kind.alias("v")))
        before = F.concat(F.array(F.lit(-1)), cells["at"])
        gaps = F.zip_with(F.concat(cells, end), before, lambda x, p: F.concat(F.array_repeat(kind, x["at"] - p - 1), F.when(x["at"] < size, F.array(x["v"])).otherwise(F.slice(F.array(kind), 1, 0))))
        return F.flatten(gaps)

    # The cells are bound once by the lambda: named twice they would be sorted twice.
    block = F.get(F.transform(F.array("cells"), filled), F.lit(0))
    return found.select("br", "bc", block.alias("block"))


def bsr_row_ptr(m: SparseMatrix) -> DataFrame:
    """(row, n, ptr) over block rows."""
    blocks = m.entries.select(F.expr(f"row div {BLOCK}").alias("row"), F.expr(f"col div {BLOCK}").alias("col")).distinct()
    grid = SparseMatrix(blocks.withColumn("val", F.lit(1)), -(-m.n_rows // BLOCK), -(-m.n_cols // BLOCK))
    return row_ptr(grid)


def unpack_blocks(blocks: DataFrame) -> DataFrame:
    """Entries of blocks, padding left out."""
    cells = blocks.select("br", "bc", F.posexplode("block").alias("at", "val")).where("val <> 0")
    return cells.select(
        F.expr(f"br * {BLOCK} + at div {BLOCK}").alias("row"), F.expr(f"bc * {BLOCK} + at % {BLOCK}").alias("col"), "val"
    )


def nnz_shards(m: SparseMatrix, n_shards: int) -> DataFrame:
    """(row, n, ptr, shard): rows split so that shards hold about as many entries: row r is in
    the shard whose number is how many bounds (total * g) div n_shards its ptr reaches."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    total = m.entries.agg(F.count("*").alias("total"))
    reached = [F.expr(f"CAST(ptr >= (total * {g}) div {n_shards} AS INT)") for g in range(1, n_shards)]
    shard = sum(reached[1:], reached[0]) if reached else F.lit(0)
    return row_ptr(m).crossJoin(F.broadcast(total)).select("row", "n", "ptr", shard.alias("shard"))


def shard_summary(m: SparseMatrix, n_shards: int) -> DataFrame:
    return nnz_shards(m, n_shards).groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("n").cast("long").alias("nnz"))


def entry_positions(m: SparseMatrix, columns: int = 65_536, rows_per_slice: int = 4096) -> DataFrame:
    """(row, col, val, pos): the entries' places in (row, column) order, from 0. Places are counted
    within cells of one row and a range of columns, cells within slices of rows, and slices in all:
    a row of any length is spread over its cells, and only the slices' totals meet in one task."""
    placed = m.entries.withColumn("chunk", F.expr(f"col div {columns}"))
    cells = placed.groupBy("row", "chunk").agg(F.count("*").alias("n")).withColumn("slice", F.expr(f"row div {rows_per_slice}"))
    totals = cells.groupBy("slice").agg(F.sum("n").alias("t"))
    totals = totals.select("slice", F.coalesce(F.sum("t").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = W.partitionBy("slice").orderBy("row", "chunk").rowsBetween(W.unboundedPreceding, -1)
    inside = cells.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(totals, "slice")
    start = inside.select("row", "chunk", (F.col("base") + F.col("inside")).alias("start"))
    rank = F.row_number().over(W.partitionBy("row", "chunk").orderBy("col")) - 1
    return placed.withColumn("rank", rank).join(start, ["row", "chunk"]).select("row", "col", "val", (F.col("start") + F.col("rank")).alias("pos"))


def entry_shards(m: SparseMatrix, n_shards: int, columns: int = 65_536) -> DataFrame:
    """(row, col, val, pos, shard): entries in (row, column) order cut into shards whose sizes differ
    by one entry at most. A row longer than a shard lies in several."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    total = m.entries.agg(F.count("*").alias("total"))
    shard = F.expr(f"CAST((pos * {n_shards}) div total AS INT)")
    return entry_positions(m, columns).crossJoin(F.broadcast(total)).select("row", "col", "val", "pos", shard.alias("shard"))
