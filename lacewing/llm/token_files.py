"""Token-ID output: Arrow IPC files of fixed-size-list batches.

Each file holds equal-length sequences (``ids``: FixedSizeList of unsigned integers) and
their masks (FixedSizeList of booleans, false on padding), so any sequence is a zero-copy
slice of a memory-mapped file. A second small file beside it lists its documents. The ids
run in ascending doc_id order over all files; only the last sequence of a file is padded.

Documents are dealt by ranges of doc_id, so no task or file holds more than a range, and a
writer holds one batch of sequences at a time. A retried task writes under a new name; only
the names in the manifest, a table of one row for each range, count.

Defined cases: a null text is empty (the end id alone); null ids come first; repeated ids
are ordered by a hash of the text; an empty table gives a manifest without rows; other columns are
ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, documents, filesystem, map_arrow, materialize, partitions, parts, shared_path
from .encoding import encoder, slices

MANIFEST = "part int, file string, docs_file string, n_docs long, n_tokens long"


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them a batch at a time."""

    def __init__(self, sink, length: int, per_batch: int, kind: pa.DataType):
        self.length, self.size = length, length * per_batch
        self.kind, self.dtype = kind, kind.to_pandas_dtype()
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = ipc.new_file(sink, self.schema)
        self.held, self.n = [], 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(ids.size) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.dtype))
        self.n += ids.size
        if self.n >= self.size:
            flat = np.concatenate(self.held)
            whole = flat.size // self.size * self.size
            for at in range(0, whole, self.size):
                self._put(flat[at : at + self.size], self.size)
            self.held, self.n = [flat[whole:]], flat.size - whole

    def close(self) -> None:
        flat = np.concatenate(self.held) if self.n else np.zeros(0, self.dtype)
        if flat.size:
            padded = np.zeros(-(-flat.size // self.length) * self.length, self.dtype)
            padded[: flat.size] = flat
            self._put(padded, flat.size)
        self.writer.close()


def write_token_files(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int = 1,
    sequence_length: int = 2048,
    sequences_per_batch: int = 256,
    id_bits: int = 16,
    lower: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id``, and write the ids
    under the folder ``out``. ``lower`` may be set for a vocabulary that lower-cases A-Z
    itself: it changes no id. An id that ``id_bits`` can't hold raises. Returns the
    manifest, already written."""
    kind = {8: pa.uint8(), 16: pa.uint16(), 32: pa.uint32()}[id_bits]

    def write(batches):
        code = encoder(tokenizer, lower)
        system, folder = filesystem(out)
        system.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        sink = writer = None
        doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        doc_sink = doc_writer = None
        n_docs = at = 0
        for batch in parts(batches, 1200):
            if writer is None and batch.num_rows:
                sink = system.open_output_stream(f"{name}.arrow")
                writer = SequenceWriter(sink, sequence_length, sequences_per_batch, kind)
                doc_sink = system.open_output_stream(f"{name}.docs.arrow")
                doc_writer = ipc.new_file(doc_sink, doc_schema)
            texts = as_bytes(batch.column("text"))
            lengths = [np.zeros(0, np.int64)]
            for a, b in slices(texts):
                ids, edges = code.encode(texts[a:b])
                if ids.size and int(ids.max()) >= 1 << id_bits:
                    raise ValueError(f"an id of {int(ids.max())} doesn't fit in {id_bits} bits")
                lengths.append(np.diff(edges) + 1)
                writer.add(np.insert(ids, edges[1:], end_id))
            n = np.concatenate(lengths)
            if n.size:
                ends = at + np.cumsum(n)
                doc_writer.write_batch(
                    pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(ends - n), pa.array(n)], schema=doc_schema)
                )
                at, n_docs = int(ends[-1]), n_docs + n.size
        if writer is not None:
            for x in (writer, sink, doc_writer, doc_sink):
                x.close()
            row = [[part], [f"{name}.arrow"], [f"{name}.docs.arrow"], [n_docs], [at]]
            types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch(
                [pa.array(v, t) for v, t in zip(row, types)], names=["part", "file", "docs_file", "n_docs", "n_tokens"]
            )

    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(ranges or partitions(docs.sparkSession), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    return materialize(map_arrow(dealt, write, MANIFEST), "token-manifest")


def open_sequences(path: str, system=None):
    """The Arrow file reader; memory-mapped, hence zero-copy, where the file is local."""
    from pyarrow import fs

    if system is None or isinstance(system, fs.LocalFileSystem):
        return ipc.open_file(pa.memory_map(path))
    return ipc.open_file(system.open_input_file(path))


def sequence(reader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the i-th sequence of a file; the ids are a view of the file."""
    per = reader.get_batch(0).num_rows
    batch = reader.get_batch(i // per)
    ids, mask = (batch.column(k).slice(i % per, 1).flatten() for k in (0, 1))
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_token_files(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """One row for each document, from the files alone: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32, file, file_start.

    The manifest's rows that are collected number one for each range, a set parameter."""
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    at, listed = 0, []
    for r in rows:
        listed.append((r["file"], r["docs_file"], at))
        at += r["n_tokens"]

    def read(batches):
        system, _ = filesystem(out)
        for batch in batches:
            for row in batch.to_pylist():
                reader = open_sequences(row["file"], system)
                loaded, values = -1, None
                first = reader.get_batch(0)
                span = first.num_rows * first.schema.field("ids").type.list_size
                with system.open_input_file(row["docs_file"]) as source:
                    for listing in ipc.open_file(source).read_all().to_batches():
                        starts, sizes = (listing.column(k).to_numpy() for k in (1, 2))
                        sums = np.zeros(starts.size, np.int64)
                        for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
                            crc, end = 0, a + n
                            while a < end:
                                if a // span != loaded:
                                    loaded = a // span
                                    values = reader.get_batch(loaded).column(0).flatten().to_numpy()
                                stop = min(end, (loaded + 1) * span)
                                piece = values[a - loaded * span : stop - loaded * span]
                                crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                                a = stop
                            sums[i] = crc
                        yield pa.record_batch(
                            [
                                listing.column(0), pa.array(starts + row["before"]), listing.column(2), pa.array(sums),
                                pa.array([row["file"]] * starts.size, pa.string()), listing.column(1),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "file_start"],
                        )

    files = spark.createDataFrame(listed, "file string, docs_file string, before long")
    files = files.repartition(max(1, len(listed)))
    return map_arrow(files, read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, file_start long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_path(spark, "token-files")
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_token_files(documents(spark, sf_dir), out, path, end_id=1, lower=True)
    return read_token_files(spark, manifest, out).select("doc_id", "start", "n_tokens", "ids_crc32")
