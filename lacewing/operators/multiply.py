"""Products of a sparse and a dense matrix: one relation, several physical plans.

A product is an equi-join of entries with the dense rows and a grouped sum. The dense side
is broadcast only below ``broadcast_bytes``, by its stated dimensions; beyond it the join
shuffles both sides, and adaptive execution splits skewed keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.functions.scalars import to_half
from lacewing.plans import planner
from lacewing.plans.matrix import BLOCK, DenseMatrix, SparseMatrix
from lacewing.plans.stored import Grid, hold_grid

from .layout import all_rows, entry_shards, nnz_shards, unpack_blocks

BROADCAST_BYTES = 64 << 20

#: Most memory for the dense rows of a tile of ``block``, and for its sums.
TILE_BYTES = 32 << 20

#: Most tasks of ``block``; a task takes several tiles if there are more.
MOST_TASKS = 20_000


def _small(df: DataFrame, b: DenseMatrix, limit: int = BROADCAST_BYTES) -> DataFrame:
    return F.broadcast(df) if b.bytes() <= limit else df


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys to as many tasks as there are shuffle partitions. The number is given, so
    that adaptive execution doesn't merge small parts that a product makes large."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _by_row(a: SparseMatrix, b: DenseMatrix) -> DataFrame:
    """Entries dealt by row if the dense side is broadcast: a task then holds the sums of its own rows
    alone and no sum is shuffled. A row has at most K entries, so none is more than a task's work."""
    return _dealt(a.entries, "row") if b.bytes() <= BROADCAST_BYTES else a.entries


def _sums(joined: DataFrame, n: int, keys=("row",), tile: int = 64) -> DataFrame:
    """(keys, j, c) of (keys, val, b): one sum for each column of a tile, so that an entry makes one
    aggregation row for each tile and no element is ever a row before the sums are done. A cell is
    there if some dense row of its keys reaches that far."""
    if not n:
        return joined.select(*keys, "val", F.posexplode("b").alias("j", "x")).groupBy(*keys, "j").agg(F.sum(F.col("val") * F.col("x")).alias("c"))
    starts = range(0, n, tile)
    # One scan and join for all tiles: an entry makes a row for each tile, with its part of b.
    tiles = joined.select(*keys, "val", F.posexplode(F.array(*(F.slice("b", at + 1, tile) for at in starts))).alias("t", "b")) if len(starts) > 1 else joined.select(*keys, "val", F.lit(0).alias("t"), "b")
    columns = range(min(tile, n))
    reach = F.coalesce(F.greatest(F.max(F.size("b")), F.lit(0)), F.lit(0)).alias("reach")
    sums = tiles.groupBy(*keys, "t").agg(reach, *(F.sum(F.col("val") * F.get("b", F.lit(j))).alias(f"c{j}") for j in columns))
    out = sums.select(*keys, "t", F.posexplode(F.slice(F.array(*(f"c{j}" for j in columns)), F.lit(1), F.col("reach"))).alias("p", "c"))
    return out.select(*keys, (F.col("t") * tile + F.col("p")).alias("j"), "c")


def long(a: SparseMatrix, b: DenseMatrix) -> DataFrame:
    """Makes a row of each element of a joined dense row while the dense side is broadcast: the plainest plan.
    Dense rows are broadcast whole, since a row for each element takes several times the stated size.
    Beyond that size an element would be shuffled with both its keys, so it is as ``packed``."""
    if b.n_cols and b.bytes() > BROADCAST_BYTES:
        return packed(a, b)
    joined = _by_row(a, b).join(_small(b.rows.withColumnRenamed("k", "col"), b), "col")
    elements = joined.select("row", "val", F.posexplode("b").alias("j", "x"))
    return elements.groupBy("row", "j").agg(F.sum(F.col("val") * F.col("x")).alias("c"))


def packed(a: SparseMatrix, b: DenseMatrix) -> DataFrame:
    """Joins whole dense rows and takes them apart after the sums."""
    return wide(a, b)


def wide(a: SparseMatrix, b: DenseMatrix, tile: int = 64) -> DataFrame:
    """One sum for each column of a tile."""
    if tile < 1:
        raise ValueError("tile must be positive")
    if not b.n_cols:
        return long(a, b)
    joined = _by_row(a, b).join(_small(b.rows.withColumnRenamed("k", "col"), b), "col")
    return _sums(joined, b.n_cols, tile=tile)


def aligned_wide(a: SparseMatrix, b: DenseMatrix, tile: int = 128) -> DataFrame:
    """As ``wide``, only for widths that are whole tiles."""
    if b.n_cols % tile:
        raise ValueError(f"N = {b.n_cols} is not a multiple of {tile}")
    return wide(a, b, tile)


def _tiling(a: SparseMatrix, b: DenseMatrix, tasks: int) -> tuple[int, int]:
    """Bands of rows and chunks of columns: tiles enough for ``tasks``, so that copies of the dense
    side (one a band) and partial sums (one a chunk) are about as many, and so that the sums
    of a band and the dense rows of a chunk take TILE_BYTES at most."""
    width = 8 * max(1, b.n_cols)
    m, k = max(1, -(-a.n_rows // BLOCK)), max(1, -(-a.n_cols // BLOCK))
    bands = min(m, max(-(-m * BLOCK * width // TILE_BYTES), round((tasks * m / k) ** 0.5), 1))
    chunks = min(k, max(-(-k * BLOCK * width // TILE_BYTES), -(-tasks // bands), 1))
    return bands, chunks + (bands == chunks and chunks < k)  # blocks of a diagonal meet more tiles


def block(a: SparseMatrix, b: DenseMatrix, half: bool = False) -> DataFrame:
    """16 by 16 blocks times 16 dense rows in NumPy, an Arrow batch at a time. Blocks are dealt to tiles,
    by bands of block rows and chunks of block columns, and a chunk's dense rows go once to each of its tiles:
    they don't travel with every block. A task takes a tile's dense rows, then its blocks column
    by column, each as its stored cells, and gives a row of sums for each row of the tile that has
    entries; chunks' sums are added in Spark. Entries without a dense row make no cell."""
    spark, n = a.entries.sparkSession, b.n_cols
    value = "double" if half else a.entries.schema["val"].dataType.simpleString()
    kind = np.dtype({"double": "f8", "float": "f4", "int": "i4"}.get(value, "i8"))
    bands, chunks = _tiling(a, b, int(spark.conf.get("spark.sql.shuffle.partitions")))
    high, wide_ = BLOCK * -(-a.n_rows // (BLOCK * bands)), BLOCK * -(-a.n_cols // (BLOCK * chunks))
    at = lambda x, parts: F.expr(f"({x} div {BLOCK}) div {parts} * {BLOCK} + {x} % {BLOCK}").cast("int")
    part = lambda x, parts: F.expr(f"({x} div {BLOCK}) % {parts}")
    number = to_half(F.col("val")) if half else F.col("val")
    # An empty array: nulls of a list column cost Arrow several times as much as all else.
    empty = F.slice(F.array(F.lit(0).cast(value)), 1, 0)
    # Places in a tile: ``r`` its row, -1 for a dense row; ``k`` its inner position.
    left = a.entries.select(part("row", bands).alias("band"), part("col", chunks).alias("chunk"), at("row", bands).alias("r"), at("col", chunks).alias("k"), number.cast(value).alias("v"), empty.alias("b"))
    each = F.explode(F.expr(f"sequence(0L, {bands - 1}L)")).alias("band")
    right = b.rows.select(each, part("k", chunks).alias("chunk"), F.lit(-1).alias("r"), at("k", chunks).alias("k"), F.lit(0).cast(value).alias("v"), F.col("b").cast(f"array<{value}>").alias("b"))
    tile = F.col("band") * chunks + F.col("chunk")
    tasks = min(bands * chunks, MOST_TASKS)
    dealt = left.union(right.where(F.col("k") < wide_)).select(tile.alias("tile"), "r", "k", "v", "b")
    dealt = dealt.repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int"))
    # Dense rows first, then blocks column by column.
    dealt = dealt.sortWithinPartitions("tile", F.col("r") >= 0, F.expr(f"k div {BLOCK}"), "r")

    def multiply(batches):
        now, dense, reach, total, held = None, None, None, None, None

        def sums():
            rows = np.flatnonzero(held)
            band = now // chunks
            number = (rows // BLOCK * bands + band) * BLOCK + rows % BLOCK
            for i in range(0, rows.size, 4096):
                some = rows[i : i + 4096]
                cells = total[some][np.arange(n) < held[some, None] - 1]
                offsets = np.concatenate([[0], np.cumsum(held[some] - 1)]).astype(np.int32)
                yield pa.record_batch([pa.array(number[i : i + 4096]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells))], names=["row", "b"])

        for batch in batches:
            tiles = batch.column("tile").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), tiles.size]
            for start, stop in zip(edges, edges[1:]):
                if stop == start:
                    continue
                if tiles[start] != now:
                    if now is not None:
                        yield from sums()
                    now = int(tiles[start])
                    dense, reach = np.zeros((wide_, n), kind), np.zeros(wide_, np.int32)
                    total, held = np.zeros((high, n), kind), np.zeros(high, np.int32)  # held: 1 + how far a row's sums reach
                run = batch.slice(start, stop - start)
                r, k = run.column("r").to_numpy(), run.column("k").to_numpy()
                n_dense = int(np.searchsorted(r >= 0, True))
                if n_dense:
                    lists = run.column("b").slice(0, n_dense)
                    size = lists.value_lengths().fill_null(0).to_numpy()
                    cell = np.repeat(k[:n_dense], size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                    dense[cell] = lists.flatten().fill_null(0).to_numpy(zero_copy_only=False)
                    reach[k[:n_dense]] = size + 1
                r, k, v = r[n_dense:], k[n_dense:], run.column("v").slice(n_dense).fill_null(0).to_numpy(zero_copy_only=False)
                known = reach[k] > 0
                r, k, v = r[known], k[known], v[known]
                if not r.size:
                    continue
                np.maximum.at(held, r, reach[k])
                # Rows of blocks: entries of one row and one block column lie side by side.
                column = k // BLOCK
                first = np.flatnonzero(np.concatenate([[True], (np.diff(column) != 0) | (np.diff(r) != 0)]))
                rows = np.zeros((first.size, BLOCK), kind)
                rows[np.repeat(np.arange(first.size), np.diff(np.append(first, r.size))), k % BLOCK] = v
                strip = column[first]
                bounds = np.flatnonzero(np.concatenate([[True], np.diff(strip) != 0, [True]]))
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    c = int(strip[i]) * BLOCK
                    total[r[first[i:j]]] += rows[i:j] @ dense[c : c + BLOCK]
        if now is not None:
            yield from sums()

    from lacewing.ship import ship

    ship(spark)
    parts = dealt.mapInArrow(multiply, f"row long, b array<{value}>")
    return _sums(parts.withColumn("val", F.lit(1).cast(value)), n) if n else long(a, b)


def device_count(spark) -> int:
    return spark.sparkContext.defaultParallelism


def clamp_devices(spark, wanted: int) -> int:
    """As many devices as wanted, within 1 and those there are."""
    return max(1, min(wanted, device_count(spark)))


def sharded(a: SparseMatrix, b: DenseMatrix, n_shards: int) -> DataFrame:
    """Rows dealt to shards of about as many entries; no sum crosses a shard, which stays in the key. A
    shard is work of many tasks, dealt by row: few shards don't mean few tasks."""
    shards = nnz_shards(a, n_shards).select("row", "shard")
    dealt = _dealt(a.entries.join(shards, "row"), "shard", "row")
    joined = dealt.join(_small(b.rows.withColumnRenamed("k", "col"), b), "col")
    return _sums(joined, b.n_cols, ("shard", "row")).select("row", "j", "c")


def entry_sharded(a: SparseMatrix, b: DenseMatrix, n_shards: int) -> DataFrame:
    """Entries dealt to shards of equal size, whatever the rows' lengths: shard g is task g. A row
    that is cut has a partial sum in each of its shards, added up after; there are at most
    n_shards - 1 cuts, so hardly more is shuffled than the result. Store ``a`` first (``hold``),
    so that it is built once for the counts and the deal."""
    dealt = entry_shards(a, n_shards).repartitionById(n_shards, "shard")
    joined = dealt.join(_small(b.rows.withColumnRenamed("k", "col"), b), "col")
    return _sums(joined, b.n_cols)


def heavy_columns(a: SparseMatrix, share: int, most: int | None = None) -> DataFrame:
    """(col): the columns that hold more than a ``share``-th of the entries, the ``most`` largest of
    them at most. One pass with a sketch of frequent items, which tasks merge; its size depends on
    ``share`` alone. The sketch may rate a column too high, so one near the limit may come or
    stay away; products are right with any columns."""
    sketch = a.entries.where("col IS NOT NULL").agg(F.expr(f"approx_top_k(col, {min(share, most or share)}, {16 * share})").alias("top"), F.count("*").alias("n"))
    return sketch.select("n", F.inline("top")).where(F.col("count") * share > F.col("n")).select(F.col("item").alias("col"))


def skewed(a: SparseMatrix, b: DenseMatrix, limit: int = BROADCAST_BYTES, share: int | None = None) -> DataFrame:
    """For a dense side over the broadcast limit and columns that hold much of the entries: entries stay where
    they are dealt by row. The dense rows of heavy columns are broadcast to them; any other goes once
    to each part that has entries of its column, so neither it nor a sum travels with every entry.
    A column counts as heavy above a quarter of a mean shuffle partition; there are as many at most
    as fit the limit."""
    spark = a.entries.sparkSession
    row_bytes = 8 * max(1, b.n_cols)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(share or 4 * parts, 60_000)
    # The limit bounds how many columns are near, not how much a heavy one has to hold.
    if limit < row_bytes:
        return shuffled(a, b)
    heavy = heavy_columns(a, share, limit // row_bytes)
    rows = b.rows.withColumnRenamed("k", "col")
    there = rows.join(F.broadcast(heavy), "col", "left_semi").withColumnRenamed("b", "near")
    # A heavy column without a dense row stays near too: it adds nothing.
    marked = heavy.withColumn("heavy", F.lit(True))
    near = marked.join(F.broadcast(there), "col", "left")
    placed = a.entries.withColumn("part", F.coalesce(F.pmod(F.hash("row"), F.lit(parts)), F.lit(0)))
    # No anti-join: it would be pushed below the sum of duplicates, which the sketch reads too.
    others = placed.join(F.broadcast(marked), "col", "left").where("heavy IS NULL")
    wanted = _dealt(others.select("part", "col"), "col").distinct()
    sent = wanted.join(_dealt(rows, "col").hint("merge"), "col").select("part", F.col("col").alias("far"), "b")
    split = placed.repartitionById(parts, "part").join(F.broadcast(near), "col", "left")
    split = split.select("part", "row", "val", "near", F.when(F.col("heavy").isNull(), F.col("col")).alias("far"))
    both = split.join(sent.repartitionById(parts, "part").hint("merge"), ["part", "far"], "left")
    return _sums(both.select("part", "row", "val", F.coalesce("near", "b").alias("b")), b.n_cols, ("part", "row")).drop("part")


def shuffled(a: SparseMatrix, b: DenseMatrix) -> DataFrame:
    """Never broadcasts: for dense sides larger than memory."""
    joined = a.entries.join(b.rows.withColumnRenamed("k", "col").hint("merge"), "col")
    return _sums(joined, b.n_cols)


def gridded(grid: Grid) -> DataFrame:
    """The product of two sides written by ``hold_grid``. Buckets of equal number meet in a task as they
    lie, merged in order of the inner position, so that a task holds one dense row at a time; only
    partial sums are shuffled, once."""
    joined = grid.left.join(grid.right.hint("merge"), ["rb", "k"])
    return _sums(joined, grid.n_cols)


def batched(entries: DataFrame, b: DenseMatrix, keys: list[str]) -> DataFrame:
    """Products of many sparse matrices, told apart by ``keys``, with one dense matrix: (keys, row,
    j, c). All are one join and one sum, whatever their number and sizes."""
    summed = entries.groupBy(*keys, "row", "col").agg(F.sum("val").alias("val"))
    dealt = _dealt(summed, *keys, "row") if b.bytes() <= BROADCAST_BYTES else summed
    joined = dealt.join(_small(b.rows.withColumnRenamed("k", "col"), b), "col")
    return _sums(joined, b.n_cols, (*keys, "row"))


def hybrid(a: SparseMatrix, b: DenseMatrix, threshold: float = planner.THRESHOLD) -> DataFrame:
    """The plan that the planner chooses from the entries' clustering."""
    return BACKENDS[planner.choose(a, b.n_cols, threshold).backend](a, b)


BACKENDS = {planner.Backend.BLOCK: block, planner.Backend.CSR: wide}


STRATEGIES = {
    "baseline": long, "memopt": packed, "memopt_v2": packed, "tiled": wide, "tiled_v2": aligned_wide,
    "tiled_v3": lambda a, b: wide(a, b, 128), "tiled_v4": lambda a, b: wide(a, b, 256), "wmma": block,
    "hybrid": hybrid, "multigpu": lambda a, b: sharded(a, b, device_count(a.entries.sparkSession)), "unified": shuffled,
    "grid": lambda a, b: gridded(hold_grid(a, b)), "skewed": skewed, "balanced": lambda a, b: entry_sharded(a, b, device_count(a.entries.sparkSession)),
}


def complete(c: DataFrame, a: SparseMatrix, n: int) -> DataFrame:
    """Every cell of the result: rows without entries are zeros."""
    kind = c.schema["c"].dataType
    grid = all_rows(a).select("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")) if n else c.select("row", "j").limit(0)
    return grid.join(c, ["row", "j"], "left").select("row", "j", F.coalesce("c", F.lit(0).cast(kind)).alias("c"))


def matmul(a: SparseMatrix, b: DenseMatrix, strategy: str = "hybrid", dense_output: bool = True) -> DataFrame:
    """(row, j, c) of the product."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    c = STRATEGIES[strategy](a, b)
    return complete(c, a, b.n_cols) if dense_output else c


__all__ = ["STRATEGIES", "complete", "matmul", "unpack_blocks"]
