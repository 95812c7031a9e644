"""Best-fit packing of token sequences under several capacities at once.

A sequence has room for tokens, documents and attention cost (the sum of squared piece
lengths). Pieces, longest first, go to the open sequence that every capacity admits and
that the weighted rule prefers: ``norm`` takes the least weighted residual after placing,
``dot`` the largest weighted product of residual and demand.

Encoding and packing are two steps with a written table of pieces between them, so the
texts are encoded once. Pieces are dealt to groups of about ``bins_per_group`` sequences, and
of 64 times as many pieces at most; a group wastes at most its last few sequences. The number of
groups follows the table alone. A task takes its groups one after another, in the order of a sort
that may spill, and holds one at a time.

Defined cases: a null text is empty (the end id alone); repeated rows are packed each, dealt
to groups by their places in the table of pieces, so that no id gathers in one; ids may be
null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, documents, map_arrow, materialize, parts
from .encoding import encoder, slices

#: Most tasks of the packing; a task takes several groups if there are more.
MOST_TASKS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, cache: int = 2_000_000) -> DataFrame:
    """The pieces of every document: whole if it fits, else cut from its end into pieces of
    ``capacity`` ids, so that only the first is shorter. ``cache`` bounds the encoder's
    memory and changes no result."""

    def cut(batches):
        code = encoder(tokenizer, limit=cache)
        for batch in parts(batches, 1200):
            texts = as_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for a, b in slices(texts):
                got, edges = code.encode(texts[a:b])
                for doc, start, stop in zip(ids[a:b], edges[:-1].tolist(), edges[1:].tolist()):
                    raw = np.append(got[start:stop], np.uint32(end_id)).astype("<u4").tobytes()
                    n = len(raw) // 4
                    at, size, k = 0, (n - 1) % capacity + 1, 0
                    while at < n:
                        rows.append((doc, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                        at, size, k = at + size, capacity, k + 1
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES)


def best_fit(lengths: np.ndarray, capacity, weights=(1.0, 1e-3, 1e-3), rule: str = "norm"):
    """Bin of each item and its offset there. ``lengths`` must not increase; ``capacity`` is
    (tokens, documents, attention cost); no item may exceed it alone."""
    cap = np.array(capacity, float)
    w = np.array(weights, float)
    room = np.zeros((3, 1024))  # of the open bins
    name = np.zeros(1024, np.int64)
    n_open = n_bins = 0
    bins, offsets = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64)
    used: list[int] = []
    least = float(lengths[-1]) if lengths.size else 0.0
    need_least = np.array([least, 1.0, least * least])
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        if (need > cap).any():
            raise ValueError(f"a piece of {n} tokens exceeds the capacities {capacity}")
        live = room[:, :n_open]
        left = live - need[:, None]
        fits = np.flatnonzero((left >= 0).all(0))
        if fits.size:
            if rule == "norm":
                best = fits[np.argmin(w @ (left[:, fits] / cap[:, None]) ** 2)]
            else:
                best = fits[np.argmax((w * need / cap**2) @ live[:, fits])]
        else:
            if n_open == name.size:
                room, name = np.hstack([room, np.zeros_like(room)]), np.concatenate([name, np.zeros_like(name)])
            best, n_open = n_open, n_open + 1
            room[:, best], name[best] = cap, n_bins
            used.append(0)
            n_bins += 1
        b = int(name[best])
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room[:, best] -= need
        if (room[:, best] < need_least).any():  # nothing fits there any more
            n_open -= 1
            room[:, best], name[best] = room[:, n_open], name[n_open]
    return bins, offsets


def pack(
    table: DataFrame,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights=(1.0, 1e-3, 1e-3),
    rule: str = "norm",
    bins_per_group: int = 4000,
) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces. Limits that are not given do not
    bind: as many documents as tokens, and the cost of one full-length piece."""
    caps = (capacity, max_documents or capacity, max_attention or capacity * capacity)
    size = table.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    groups = max(1, -(-size["tokens"] // (capacity * bins_per_group)), -(-size["n"] // (64 * bins_per_group)))
    tasks = min(groups, MOST_TASKS)

    def place(batches):
        held, group = [], None

        def packed():
            t = pa.Table.from_batches(held)
            bins, offsets = best_fit(t.column("length").to_numpy(), caps, weights, rule)
            out = t.drop_columns(["group"]).append_column("sequence_id", pa.array(bins + (group << 32)))
            return out.append_column("offset", pa.array(offsets)).combine_chunks().to_batches()

        for batch in batches:
            numbers = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), numbers.size]
            for start, stop in zip(edges, edges[1:]):
                if stop > start:
                    if held and int(numbers[start]) != group:
                        yield from packed()
                        held = []
                    group = int(numbers[start])
                    held.append(batch.slice(start, stop - start))
        if held:
            yield from packed()

    row = F.monotonically_increasing_id()  # tells copies apart
    dealt = table.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", row), F.lit(groups)))
    dealt = dealt.repartitionById(tasks, F.pmod(F.col("group"), F.lit(tasks)).cast("int"))
    dealt = dealt.sortWithinPartitions("group", F.desc("length"), "doc_id", "piece")
    return map_arrow(dealt, place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, cache: int = 2_000_000, **limits) -> DataFrame:
    return pack(materialize(pieces(docs, tokenizer, end_id, capacity, cache), "pieces"), capacity, **limits)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
