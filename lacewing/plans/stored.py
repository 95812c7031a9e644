"""Matrices held by storage level, for several uses of one build.

``hold`` stores what a matrix's plan gives, once; every strategy then reads the stored blocks,
so a choice of layout and the product after it scan the source once, and a timed loop times the
product alone. Blocks lie in memory or on executors' disks and are rebuilt from the plan if an
executor is lost. They stay until ``free``, which leaving a ``with`` block does too.

``hold_grid`` writes both sides of a product as bucketed tables, for sides that outgrow memory and
the executors' disks.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import BLOCK, DenseMatrix, SparseMatrix

_HELD: list[Held] = []


class Held:
    """What is held: ``matrix`` for the strategies, ``frames`` as they are stored."""

    def __init__(self, matrix: SparseMatrix | DenseMatrix | DataFrame, frames: list[DataFrame], n: int):
        self.matrix, self.frames, self.n = matrix, frames, n
        _HELD.append(self)

    def free(self) -> None:
        for frame in self.frames:
            frame.unpersist(blocking=True)
        if self in _HELD:
            _HELD.remove(self)

    def __enter__(self) -> SparseMatrix | DenseMatrix | DataFrame:
        return self.matrix

    def __exit__(self, *error) -> None:
        self.free()


def hold(m: SparseMatrix | DenseMatrix, level: StorageLevel = StorageLevel.MEMORY_AND_DISK, order: bool = True) -> Held:
    """Stores a matrix and counts its rows or entries, which fills the store. A sparse matrix is
    dealt by row and put in order of (row, column) within each part first, unless ``order`` is
    false: packing, blocks and row sums then find their rows together."""
    if isinstance(m, DenseMatrix):
        rows = m.rows.persist(level)
        return Held(DenseMatrix(rows, m.n_rows, m.n_cols), [rows], rows.count())
    entries = m.entries.repartition(F.expr(f"row div {BLOCK}")).sortWithinPartitions("row", "col") if order else m.entries
    entries = entries.persist(level)
    return Held(SparseMatrix(entries, m.n_rows, m.n_cols), [entries], entries.count())


def hold_frame(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Held:
    """Stores any result."""
    df = df.persist(level)
    return Held(df, [df], df.count())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a folder of this machine only if the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="lacewing-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Grid(Held):
    """Two tables bucketed and sorted by (rb, k): ``left`` (rb, k, row, val), the entries, and
    ``right`` (rb, k, b), the dense rows once for each of the row blocks."""

    def __init__(self, spark: SparkSession, path: str, n_cols: int):
        self.spark, self.path, self.n_cols, self.tables = spark, path, n_cols, []
        super().__init__(self, [], 0)

    def write(self, df: DataFrame, buckets: int) -> DataFrame:
        name = f"lacewing_grid_{uuid.uuid4().hex}"
        self.tables.append(name)
        # Dealt as the buckets are, so that a bucket is one file.
        parts = df.repartition(buckets, "rb", "k").write.format("parquet").option("path", f"{self.path}/{name}")
        parts.bucketBy(buckets, "rb", "k").sortBy("rb", "k").saveAsTable(name)
        return self.spark.table(name)

    def free(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        super().free()


def hold_grid(a: SparseMatrix, b: DenseMatrix, row_blocks: int = 8, buckets: int | None = None, path: str | None = None) -> Grid:
    """Writes both sides once, cut by blocks of rows and by inner positions: products then shuffle
    neither. Rows are dealt to ``row_blocks``, 16 at a time, so a column that many rows have lies in as
    many cells, and the dense side is written as often. Choose ``buckets`` so that one of them
    holds what a task should read; they are the shuffle partitions if left out."""
    if row_blocks < 1:
        raise ValueError("row_blocks must be positive")
    spark = a.entries.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    grid = Grid(spark, path or scratch(spark, "grid"), b.n_cols)
    rb = F.expr(f"CAST(pmod(row div {BLOCK}, {row_blocks}) AS INT)").alias("rb")
    each = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb")
    try:
        grid.left = grid.write(a.entries.select(rb, F.col("col").cast("long").alias("k"), "row", "val"), buckets)
        grid.right = grid.write(b.rows.select(each, F.col("k").cast("long").alias("k"), "b"), buckets)
    except BaseException:
        grid.free()
        raise
    return grid


def held() -> int:
    """How many matrices are held."""
    return len(_HELD)


def free_all(since: int = 0) -> None:
    for h in list(_HELD[since:]):
        h.free()
