"""The binary compressed-row format: little-endian int32 rows, cols, nnz; int32 row_ptr;
int32 col_idx; float32 values.

It is read and written by a Spark data source. A read is dealt by ranges of rows, each by a task
that seeks to its own bytes; with the options ``begin`` and ``end`` rows outside them are never
read. (Bounds are options and not pushed filters: this Spark's Python sources keep the filters
of a relation's latest scan for all its scans, so two filters on one relation gave wrong rows.) A write knows the place of every entry beforehand (an exact
prefix sum of counts), so tasks write their own bytes of one file, sized first, at the same
time; a task that runs twice writes the same bytes again. The file gets its name at the
commit. Writing needs a folder that all executors see and that can be written at any place (a
``file:`` path); reading takes any file system that Arrow opens.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import IntegerType

from lacewing.operators.layout import entry_positions, row_ptr
from lacewing.plans.matrix import SparseMatrix
from lacewing.ship import ship

FORMAT = "lacewing-csr"
BATCH = 1 << 16  # entries to a batch that is read
WORDS = 1 << 20  # words of the file to a task that writes


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _take(f, at: int, kind: str, n: int) -> np.ndarray:
    f.seek(at)
    raw = f.read(n * 4)
    if len(raw) < n * 4:
        raise OSError(f"short read: {len(raw)} of {n * 4} bytes at {at}")
    return np.frombuffer(raw, kind)


def shape(path: str) -> tuple[int, int, int]:
    """Rows, columns and entries of a file."""
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        return tuple(_take(f, 0, "<i4", 3).tolist())


class RowRange(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__((begin, end))
        self.begin, self.end = begin, end


class Reader(DataSourceReader):
    def __init__(self, path: str, rows_per_task: int, begin: int, end: int | None):
        self.path, self.rows_per_task = path, rows_per_task
        self.n_rows, _, self.nnz = shape(path)
        self.low, self.high = max(0, begin), self.n_rows if end is None else min(end, self.n_rows)

    def partitions(self) -> list[InputPartition]:
        step = self.rows_per_task
        found = [RowRange(i, min(i + step, self.high)) for i in range(self.low, self.high, step)]
        return found or [RowRange(0, 0)]

    def read(self, partition: RowRange):
        begin, end = partition.begin, partition.end
        if begin >= end:
            return
        system, inner = _open(self.path)
        with system.open_input_file(inner) as f:
            ptr = _take(f, 12 + 4 * begin, "<i4", end - begin + 1).astype(np.int64)
            base = 12 + 4 * (self.n_rows + 1)
            for at in range(int(ptr[0]), int(ptr[-1]), BATCH):
                upto = min(at + BATCH, int(ptr[-1]))
                col = _take(f, base + 4 * at, "<i4", upto - at)
                val = _take(f, base + 4 * (self.nnz + at), "<f4", upto - at)
                row = begin + np.searchsorted(ptr, np.arange(at, upto), side="right") - 1
                yield pa.record_batch([pa.array(row, pa.int64()), pa.array(col.astype(np.int64)), pa.array(val)], names=["row", "col", "val"])


class Writer(DataSourceArrowWriter):
    """Takes (at, word): 32-bit words and their places in the file, in words."""

    def __init__(self, path: str, n_rows: int, n_cols: int, nnz: int):
        self.path, self.part = path, f"{path}.{uuid.uuid4().hex}.part"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(self.part, "wb") as f:
            f.write(np.array([n_rows, n_cols, nnz], "<i4").tobytes())
            f.truncate(4 * (3 + n_rows + 1 + 2 * nnz))

    def write(self, batches) -> WriterCommitMessage:
        with open(self.part, "r+b") as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                at, word = batch.column("at").to_numpy(), batch.column("word").to_numpy().astype("<i4")
                for k in np.split(np.arange(at.size), np.flatnonzero(np.diff(at) != 1) + 1):  # runs of neighbours
                    f.seek(4 * int(at[k[0]]))
                    f.write(word[k].tobytes())
            f.flush()
            os.fsync(f.fileno())
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        os.replace(self.part, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


def _local(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: the one file of this format is written at many places at once, which needs a file: path that all executors see")
    return path.removeprefix("file://")


class CsrSource(DataSource):
    """``spark.read.format("lacewing-csr").load(path)``: (row, col, val)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "row long, col long, val float"

    def reader(self, schema) -> Reader:
        end = self.options.get("end")
        return Reader(self.options["path"], int(self.options.get("rows_per_task", 65_536)), int(self.options.get("begin", 0)), None if end is None else int(end))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(_local(self.options["path"]), *(int(self.options[k]) for k in ("rows", "cols", "entries")))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    ship(spark)
    spark.dataSource.register(CsrSource)


def read(spark: SparkSession, path: str, rows_per_task: int = 65_536, begin: int = 0, end: int | None = None) -> SparseMatrix:
    """The matrix of a file, with the entries of rows [begin, end) alone; rows keep their numbers."""
    n_rows, n_cols, _ = shape(path)
    register(spark)
    rows = spark.read.format(FORMAT).option("rows_per_task", rows_per_task).option("begin", begin)
    return SparseMatrix((rows if end is None else rows.option("end", end)).load(path), n_rows, n_cols)


@F.pandas_udf(IntegerType())
def _bits(x: pd.Series) -> pd.Series:
    """A float's bits as an integer, in Arrow batches."""
    return pd.Series(x.to_numpy("<f4").view("<i4"))


def words(m: SparseMatrix, nnz: int) -> DataFrame:
    """(at, word) of every word of the file after the header and the first pointer (0)."""
    first = 3 + m.n_rows + 1
    ends = row_ptr(m).select((F.col("row") + 4).alias("at"), (F.col("ptr") + F.col("n")).cast("int").alias("word"))
    placed = entry_positions(m).select("pos", F.col("col").cast("int").alias("col"), _bits(F.col("val").cast("float")).alias("bits"))
    at = F.col("pos") + first
    both = F.array(F.struct(at.alias("at"), F.col("col").alias("word")), F.struct((at + nnz).alias("at"), F.col("bits").alias("word")))
    return ends.union(placed.select(F.inline(both)))


def write(m: SparseMatrix, path: str) -> None:
    """Dimensions and nnz must fit 32 bits. Entries of one cell must have been added up; a matrix
    that is dear to build should be held (``plans.stored``): it is read for the counts, the
    pointers and the entries."""
    _local(path)
    nnz = m.entries.count()
    if max(m.n_rows, m.n_cols, nnz) >= 2**31:
        raise ValueError("the format holds 32-bit dimensions only")
    register(m.entries.sparkSession)
    n_words = 3 + m.n_rows + 1 + 2 * nnz
    dealt = words(m, nnz).repartitionById(-(-n_words // WORDS), F.expr(f"CAST(at div {WORDS} AS INT)")).sortWithinPartitions("at")
    shaped = dealt.write.format(FORMAT).option("rows", m.n_rows).option("cols", m.n_cols).option("entries", nnz)
    shaped.mode("append").save(path)
