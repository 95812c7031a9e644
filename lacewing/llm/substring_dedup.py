"""Exact removal of repeated word windows behind a count-min prefilter.

Texts are first written in chunks, to files of which a small table is kept, so that all passes
see the same chunks and no text is ever shuffled.

First pass: each chunk hashes its windows into the cells of ``ROWS`` count-min rows and hands
on, for each slice of cells, the cells that it saw and which of them it saw twice. A task
merges a slice and answers each chunk with one bit for each of its cells: whether the merged
count is two or more. The number of cells grows with the corpus and that of slices with the
cells, so a task holds one slice's entries at any size, and nothing is collected or broadcast.
Estimates of a count-min sketch are never too low, so a window with a cell that isn't hot
occurs once. About a fifth of the other windows that occur once pass too.

Second pass: windows all of whose cells are hot are grouped by 128 hash bits, made from two
independent hashes of each word that are joined pairwise; bits are stirred after every eight
bytes and at every joint, so that no pattern of bytes or words cancels out. Within a chunk, repeats are settled at once and each distinct
window is handed on once, so a common passage costs one entry for each chunk, not one for
each occurrence. The marks go back to their chunks, whose texts are then cut.

Defined cases: null text has no words; windows never cross documents; repeated rows count as
occurrences of each other's windows; null ids are kept; an empty table gives no rows; other
columns are kept, but for those named like a result.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, documents, filesystem, map_arrow, materialize, partitions, shared_files

ROWS = 2
#: Cells for each window, at 6.2 bytes a word, and most cells of a slice.
LOAD, SPAN = 1.6, 1 << 23
LEAST_SLICES, LEAST_SHARDS = 64, 64
#: Bytes of text to a shard of the second pass.
SHARD = 32_000_000
CHUNKS_EACH = 4  # chunks to a task
#: Odd multipliers of the left and the right half of a window, for each of the two hashes.
HALVES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F))
CHARS = 2_000_000  # bytes of text to a chunk, or one text if longer
BLOCK = 1 << 14  # words hashed at once


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _join(left: np.ndarray, right: np.ndarray, by: tuple[int, int], size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words from those of their halves. The bits are stirred at each
    step, so that no pattern of words cancels out."""
    out = left * np.uint64(by[0])
    out += _mix(right * np.uint64(by[1]) + np.uint64(size))
    return _mix(out)


def _windows(h: np.ndarray, width: int, by: tuple[int, int]) -> np.ndarray:
    """The hash of the ``width`` words from each word on, from runs of 1, 2, 4, ... words."""
    out, done, size = None, 0, 1
    n = max(h.size - width + 1, 0)
    while True:
        if width & size:
            part = h[done : done + n]
            out = part.copy() if out is None else _join(out, part, by, done + size)
            done += size
        if 2 * size > width or not n:
            return h[:0] if out is None else out
        h = _join(h[:-size], h[size:], by, 2 * size)
        size *= 2


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two hashes of each word, eight bytes at a time; a block of words at once."""
    out = tuple(np.empty(starts.size, np.uint64) for _ in HALVES)
    padded = np.append(raw, np.zeros(8, np.uint8))
    eights = np.ndarray(raw.size + 1, "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    for i in range(0, starts.size, BLOCK):
        at, left = starts[i : i + BLOCK], ends[i : i + BLOCK] - starts[i : i + BLOCK]
        h = [left.astype(np.uint64) * np.uint64(by[0]) for by in HALVES]
        some = slice(None)
        while at.size:
            value = eights[at]
            value &= _MASKS[np.minimum(left, 8)]
            for x, by in zip(h, HALVES):
                x[some] = _mix((x[some] ^ value) * np.uint64(by[1]) + np.uint64(by[0]))
            on = left > 8
            some = np.flatnonzero(on) if isinstance(some, slice) else some[on]
            at, left = at[on] + 8, left[on] - 8
        for o, x in zip(out, h):
            o[i : i + BLOCK] = x
    return out


def window_hashes(texts: list[bytes], width: int):
    """For the windows of all texts in order: two independent 64-bit hashes and the window's
    first word, counted through all texts; and the number of words of each text."""
    raw = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    inside = ~_SPACE[raw]
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = turn[::2], turn[1::2]
    h = _word_hashes(raw, starts, ends)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    n = np.diff(np.searchsorted(starts, edges))
    firsts = np.cumsum(n) - n
    many = np.maximum(n - width + 1, 0)
    at = np.repeat(firsts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    h1, h2 = (_windows(x, width, by)[at] for x, by in zip(h, HALVES))
    return h1, h2, at, n


def _zip(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unzip(blob: bytes, kind, n: int) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, size, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _zip_bits(x: np.ndarray) -> bytes:
    return _zip(np.packbits(x))


def _unzip_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(_unzip(blob, np.uint8, -(-n // 8)), count=n).view(bool)


def _zip_cells(x: np.ndarray) -> bytes:
    """Ascending numbers under 2**32 as planes of bytes of their gaps."""
    gaps = np.diff(x, prepend=0).astype("<u4")
    return _zip(gaps.view(np.uint8).reshape(-1, 4).T)


def _unzip_cells(blob: bytes, n: int) -> np.ndarray:
    planes = _unzip(blob, np.uint8, 4 * n).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _records(schema: str, rows: list[tuple], size: int = 2000):
    fields = [f.split() for f in schema.split(", ")]
    for i in range(0, len(rows), size):
        columns = zip(*rows[i : i + size])
        yield pa.record_batch([pa.array(c, _TYPES[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _rows(batches, schema: str):
    names = [f.split()[0] for f in schema.split(", ")]
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


# ---------------------------------------------------------------- chunks

CHUNKS = "g long, file string, place int, n_bytes long"


def write_chunks(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """Writes rows (the text is the last column) in chunks of about ``chars`` bytes of text, and
    gives a row for each. A retried task writes a file of its own; only files in the table
    count."""
    out = shared_files(docs.sparkSession, "substring-chunks")

    def gather(batches):
        task, place, held, size = TaskContext.get().partitionId(), 0, [], 0
        system, folder = filesystem(out)
        system.create_dir(folder, recursive=True)
        name = f"{task}-{uuid.uuid4().hex}.arrow"
        sink = writer = None
        rows = []

        def write():
            nonlocal sink, writer
            # Columns may share a name, so they are known by place.
            table = pa.Table.from_batches(held).combine_chunks()
            batch = pa.record_batch([c.chunk(0) for c in table.columns], names=[str(i) for i in range(table.num_columns)])
            if writer is None:
                sink = system.open_output_stream(f"{folder}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(batch)
            rows.append(((task << 24) + place, f"{out}/{name}", place, size))

        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            start = 0
            for i, n in enumerate(sizes, 1):
                size += n
                if size >= chars:
                    held.append(batch.slice(start, i - start))
                    write()
                    start, place, held, size = i, place + 1, [], 0
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            write()
        if writer is not None:
            writer.close()
            sink.close()
        yield from _records(CHUNKS, rows)

    return materialize(map_arrow(docs, gather, CHUNKS), "substring-chunks")


def _chunk(file: str, place: int) -> pa.RecordBatch:
    system, path = filesystem(file)
    with system.open_input_file(path) as source:
        return pa.ipc.open_file(source).get_batch(place)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return as_bytes(batch.column(batch.num_columns - 1))


# ---------------------------------------------------------------- first pass


class Sketch(NamedTuple):
    """A row of the sketch has ``slices`` of ``span`` cells."""

    slices: int
    span: int

    def cells(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(16)) % np.uint64(self.slices * self.span)


def sketch_for(n_bytes: int, load: float = LOAD, span: int = SPAN) -> Sketch:
    """As many cells as ``load`` asks for, whatever the size."""
    cells = max(512, int(load * n_bytes / 6.2))
    slices = min(cells, max(LEAST_SLICES, -(-cells // span)))
    return Sketch(slices, -(-cells // slices))


SEEN = "slice int, g long, n int, cells binary, twice binary"
ANSWERS = "g long, slice int, n int, hot binary, file string, place int"


def answers(chunks: DataFrame, width: int, sketch: Sketch) -> DataFrame:
    """For each chunk and each slice of each sketch row that it has cells in (numbered through
    the rows), a bit for each of its distinct cells in ascending order: merged count of two or
    more."""
    spark, span = chunks.sparkSession, sketch.span

    def see(batches):
        for g, file, place, _ in _rows(batches, CHUNKS):
            h1, h2, *_ = window_hashes(_texts(_chunk(file, place)), width)
            rows = []
            for r, h in enumerate((h1, h2)):
                cells = np.sort(sketch.cells(h)).astype(np.int64)
                starts = np.flatnonzero(np.diff(cells, prepend=-1))
                twice = np.diff(np.append(starts, cells.size)) > 1
                cells = cells[starts]
                in_slice = cells // span
                edges = np.append(np.flatnonzero(np.diff(in_slice, prepend=-1)), cells.size).tolist()
                for a, b in zip(edges[:-1], edges[1:]):
                    s = int(in_slice[a])
                    rows.append((r * sketch.slices + s, g, b - a, _zip_cells(cells[a:b] - s * span), _zip_bits(twice[a:b])))
            yield from _records(SEEN, rows)

    def merge(batches):
        held: dict[int, list] = {}
        for s, *row in _rows(batches, SEEN):
            held.setdefault(s, []).append(row)
        for s in list(held):
            rows = held.pop(s)
            counts = np.zeros(span, np.uint8)
            for _, n, blob, twice in rows:
                cells = _unzip_cells(blob, n)
                counts[cells] = np.minimum(counts[cells] + 1 + _unzip_bits(twice, n), 2)
            out = []
            for g, n, blob, _ in rows:
                out.append((g, s, n, _zip_bits(counts[_unzip_cells(blob, n)] >= 2), None, None))
                if len(out) == 2000:
                    yield from _records(ANSWERS, out)
                    out = []
            yield from _records(ANSWERS, out)

    dealt = chunks.repartition(_tasks(spark, chunks))
    return map_arrow(map_arrow(dealt, see, SEEN).repartition(ROWS * sketch.slices, "slice"), merge, ANSWERS)


def _tasks(spark: SparkSession, chunks: DataFrame) -> int:
    return max(1, partitions(spark), -(-chunks.count() // CHUNKS_EACH))


def _hot(sketch: Sketch, h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of each window of a chunk, the bit of its cell, from the bits of the distinct cells."""
    cells = sketch.cells(h)
    return bits[np.searchsorted(np.unique(cells), cells)]


# ---------------------------------------------------------------- second pass

MARKS = "shard long, kind int, g long, n int, a binary, b binary, at binary"
MARKED = "g long, n int, at binary, file string, place int"
SEVERAL = np.uint32(0xFFFFFFFF)


def repeated_windows(chunks: DataFrame, width: int, load: float = LOAD, span: int = SPAN) -> DataFrame:
    """(g, n, at): first words, as packed 32-bit numbers, of windows of a chunk whose words also
    start elsewhere."""
    spark = chunks.sparkSession
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    sketch = sketch_for(size, load, span)
    shards = max(LEAST_SHARDS, partitions(spark), size // SHARD)

    def find(batches):
        held: dict[int, list] = {}
        where = {}
        for g, s, n, hot, file, place in _rows(batches, ANSWERS):
            if file is None:
                held.setdefault(g, []).append((s, n, hot))
            else:
                where[g] = (file, place)
        for g in sorted(held):
            got = sorted(held.pop(g))
            h1, h2, at, _ = window_hashes(_texts(_chunk(*where[g])), width)
            bits = [np.concatenate([_unzip_bits(hot, n) for s, n, hot in got if s // sketch.slices == r]) for r in range(ROWS)]
            keep = np.flatnonzero(_hot(sketch, h1, bits[0]) & _hot(sketch, h2, bits[1]))
            if not keep.size:
                continue
            h1, h2, at = h1[keep], h2[keep], at[keep].astype(np.uint32)
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            many = np.diff(np.append(np.flatnonzero(new), a.size))
            again = np.sort(order[np.repeat(many > 1, many)])
            rows = []
            if again.size:
                rows.append((g % shards, 0, g, again.size, b"", b"", _zip(at[again])))
            one = order[new]
            first = np.where(many > 1, SEVERAL, at[one])
            h1, h2 = h1[one], h2[one]
            shard = (h1 % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            h1, h2, first = h1[by], h2[by], first[by]
            edges = np.searchsorted(shard[by], np.arange(shards + 1)).tolist()
            for s, (i, j) in enumerate(zip(edges[:-1], edges[1:])):
                if i < j:
                    rows.append((s, 1, g, j - i, _zip(h1[i:j]), _zip(h2[i:j]), _zip(first[i:j])))
            yield from _records(MARKS, rows)

    def settle(batches):
        held: dict[int, list] = {}
        for shard, kind, *row in _rows(batches, MARKS):
            if kind == 0:
                yield from _records(MARKED, [(row[0], row[1], row[4], None, None)])
            else:
                held.setdefault(shard, []).append(row)
        for shard in list(held):
            rows = held.pop(shard)
            chunk = np.repeat(np.arange(len(rows), dtype=np.int32), [r[1] for r in rows])
            h1 = np.concatenate([_unzip(r[2], np.uint64, r[1]) for r in rows])
            h2 = np.concatenate([_unzip(r[3], np.uint64, r[1]) for r in rows])
            at = np.concatenate([_unzip(r[4], np.uint32, r[1]) for r in rows])
            of = [r[0] for r in rows]
            del rows
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            many = np.diff(np.append(new, a.size))
            # A window that a chunk has several times is marked there by now.
            hit = np.sort(order[np.repeat(many > 1, many) & (at[order] != SEVERAL)])
            edges = np.append(np.flatnonzero(np.diff(chunk[hit], prepend=-1)), hit.size).tolist()
            out = [(of[chunk[hit[i]]], j - i, _zip(np.sort(at[hit[i:j]])), None, None) for i, j in zip(edges[:-1], edges[1:])]
            yield from _records(MARKED, out)

    candidates = map_arrow(_beside(answers(chunks, width, sketch), chunks), find, MARKS)
    return map_arrow(candidates.repartition(shards, "shard"), settle, MARKED)


def _beside(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of chunks dealt to tasks by chunk, with a row that names each chunk's file."""
    own = chunks.select(*(F.col(c) if c in chunks.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns))
    return rows.union(own).repartition(_tasks(chunks.sparkSession, chunks), "g")


def remove_repeats(
    docs: DataFrame, width: int = 35, digest: bool = False, load: float = LOAD, span: int = SPAN, chars: int = CHARS
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by one space; the text
    itself, null included, where no word goes) of every document, and its other columns
    that have other names. With ``digest``, kept_sha256 instead of kept: of the kept words
    joined by one space, whether or not any word goes."""
    added = {"n_words": "long", "n_removed": "long", "kept_sha256" if digest else "kept": "string"}
    rest = [c for c in docs.columns if c not in {*added, "text"}]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    schema = f"{kinds}, " if rest else ""
    schema += ", ".join(f"{k} {v}" for k, v in added.items())
    chunks = write_chunks(docs.select(*rest, "text"), chars)

    def cover(batches):
        held: dict[int, list] = {}
        where = {}
        for g, n, at, file, place in _rows(batches, MARKED):
            if file is None:
                held.setdefault(g, []).append((n, at))
            else:
                where[g] = (file, place)
        for g in sorted(where):
            batch = _chunk(*where[g])
            cut = [t.split() for t in _texts(batch)]
            edges = np.cumsum([0, *map(len, cut)]).tolist()
            edge = np.zeros(edges[-1] + 1, np.int64)
            for n, blob in held.pop(g, []):
                at = _unzip(blob, np.uint32, n).astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + width, -1)
            stay = np.cumsum(edge[:-1]) == 0
            n_words, n_removed, kept = [], [], []
            for i, (words, a, b) in enumerate(zip(cut, edges[:-1], edges[1:])):
                own = stay[a:b]
                gone = b - a - int(own.sum())
                n_words.append(b - a)
                n_removed.append(gone)
                left = [w for w, s in zip(words, own.tolist()) if s] if gone else words
                if digest:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    kept.append(b" ".join(left).decode() if gone else batch.column(batch.num_columns - 1)[i].as_py())
            new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.record_batch([*(batch.column(i) for i in range(len(rest))), *new], names=[*rest, *added])

    return map_arrow(_beside(repeated_windows(chunks, width, load, span), chunks), cover, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), digest=True)


#: Windows grouped as whole texts, without sketch or hash.
OP6_SQL = r"""
WITH read AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), placed AS (
  SELECT row_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n_words FROM read
), spans AS (
  SELECT row_id, i, i + 34 <= n_words AS full_width,
         string_agg(word, ' ') OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS span
  FROM placed
), windows AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY span) AS n FROM spans WHERE full_width
), marked AS (
  SELECT p.row_id, p.i, p.word, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (
           PARTITION BY p.row_id ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM placed p LEFT JOIN windows USING (row_id, i)
), folded AS (
  SELECT row_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM marked GROUP BY row_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM read LEFT JOIN folded USING (row_id)
"""
