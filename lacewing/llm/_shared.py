"""Helpers shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which every
executor sees; only where that setting is absent and the master is local (tests on one
machine) is a folder made for it. A written table cuts lineage and survives the loss of
executors. Results may read such tables when they are themselves read, so the tables stay
until :func:`release` or :func:`release_since`.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacewing.ship import ship

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: list[str] = []
_WRITTEN: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; made and set only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="lacewing-"))
        named = _OWN[0]
    return qualified(spark, named).rstrip("/")


def qualified(spark: SparkSession, name: str) -> str:
    """A folder's name with its scheme: Spark takes one without for the default file system's."""
    if "://" not in name:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        name = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", name)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lacewing/{name}-{uuid.uuid4().hex}"


def shared_files(spark: SparkSession, name: str) -> str:
    """A path for a folder of files that tasks write themselves, deleted as the tables of
    :func:`materialize` are. A folder that Arrow can't open is an error here, before any task."""
    path = shared_path(spark, name)
    filesystem(path)
    _WRITTEN.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it reread."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lacewing_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialize` that no later step reads."""
    _delete(df.sparkSession, df._lacewing_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def written() -> int:
    """A mark for :func:`release_since`."""
    return len(_WRITTEN)


def release_since(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables of :func:`materialize` since the mark, but ``keep``: for callers that
    have read or written what they need of the results."""
    for path in _WRITTEN[mark:]:
        if keep is None or path != keep._lacewing_path:
            _delete(spark, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so once
    the driver's handles on them are collected as garbage."""
    gc.collect()
    spark._jvm.System.gc()


def filesystem(uri: str):
    """The Arrow file system of a folder and the folder's path there. Spark's other names of
    the S3 scheme are taken as such."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))
    except (pa.ArrowInvalid, ValueError) as e:
        raise ValueError(f"tasks write files under {uri}, which Arrow can't open: name a folder by file, hdfs, s3 or gs in spark.checkpoint.dir") from e


def words(text):
    """Column: the words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text):
    """Column: the number of words of a text as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_remainder(doc_id, n: int = 5):
    """Column: crc32 of the id as text, modulo ``n``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, empty for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def parts(batches, rows: int = 256):
    """Arrow batches in parts of a few rows, so that few texts are Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Hand this worker's free memory back: workers are kept from stage to stage."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if give_back is not None:
        give_back(0)


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` with this package importable in the workers."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
