"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words and an end. A token is coded as a chain of binary decisions:

1. is it the word that most often followed the two tokens before it,
2. is it the word that most often followed the token before it,
3. is it a word known in this class of text (then it is coded by its share there),
4. is it a word known at all (then by its share among words that the class hasn't seen),
5. the bits of its bytes and of a terminator, under a Huffman code of the words' bytes.

Contexts are hashed. Of the contexts of two and of one token what is kept is how often their
first candidate came and how often another token did; these histories, the recent hits and
the class make the contexts of several bit predictors of decisions 1 to 4. Bits of bytes are
predicted from the one, two, three and five bytes before them and from all, most with the
class. For each decision the predictions are mixed in the logistic domain by gated weights,
and an adaptive probability map refines the mix. Weights and maps are updated decision by
decision, or block by block of them, in a fixed order of histories, words and classes, so
that results don't depend on how rows lie in partitions. A class is the group of frequent
words that holds most of the text's words so far; groups are of words that follow each other.

Every count of a training token leaves that token out, in learning and in scoring, so that
training and other texts are scored alike. The log-probabilities add up to the text's.

Steps: (1) texts are split and written in chunks, as distinct words and codes of tokens, to
files of which a table is kept; (2) the chunks' own
most frequent words bound which words can be among the most frequent of all, these are counted
exactly, and then which of them follow each other; (3) distinct (word, class) pairs of each chunk are
shuffled by word and counted; (4) tables of byte contexts are counted by slices, and spelling
weights learned; (5) distinct (context, token) entries of each chunk are shuffled by context
and their histories return; (6) each chunk's tokens become cells of a small table of outcomes;
(7) weights and maps are learned from the counts of the cells of all training tokens.

The tables of words and of contexts grow with the corpus and are never collected or broadcast.
Contexts of frequent words alone are few and hot: of one such word the candidates are sought
among frequent words, from the counts of step 2; of two such words none is sought. Entries
hold 16 bits of the token and, of the context, five more than the corpus's tokens need. To the driver come, and are broadcast: at
most FREQUENT**2 counts, the tables of byte contexts, at most 2**22 slots each, and at most
N_CELLS cells.

Defined cases: null text is empty (the end alone); repeated rows and null ids give a row
each; without training rows all decisions are even; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, documents, drop_shuffles, filesystem, id_remainder, map_arrow, materialize, parts, shared_files

END = b""
FREQUENT, GROUPS = 256, 8
CLASSES = GROUPS + 1
#: Most slots of each byte context's table, as powers of two: class and 1 byte; class and 2, 3
#: or 5 bytes; the whole prefix.
MOST_BITS = (17, 20, 22, 22, 22)
CONTEXTS = len(MOST_BITS)
SLICE = 1 << 18
SETS = 5 * 5
BINS = 33
DELTA = 0.4
#: Pairs coded at once: few enough for a processor's cache.
STEP = 4000
#: Bytes of text to a chunk and to a shard of words or contexts.
CHUNK, SHARD = 7_000_000, 24_000_000
#: Entries of a shard that are merged at once.
PART = 1_500_000
#: Words that a chunk names as its most frequent.
NAMED = 2000
W_BITS = np.uint64(16)
LOW = np.uint64((1 << 16) - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_START = np.uint64(0x8CB92BA72F3D8DD7)


# ---------------------------------------------------------------- small helpers


def _zip(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes()
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(blob: bytes, size: int, kind=None):
    """``size`` items of ``kind``, or so many bytes."""
    n = size * (np.dtype(kind).itemsize if kind else 1)
    raw = pa.decompress(blob, n, codec="zstd", asbytes=True) if n else b""
    return np.frombuffer(raw, kind) if kind else raw


def _zip_sorted(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as planes of bytes of their gaps."""
    gaps = np.diff(x, prepend=np.uint64(0))
    return _zip(gaps.view(np.uint8).reshape(-1, 8).T)


def _unzip_sorted(blob: bytes, n: int) -> np.ndarray:
    planes = _unzip(blob, 8 * n, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as planes of bytes."""
    return _zip(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _unzip_planes(blob: bytes, n: int) -> np.ndarray:
    planes = _unzip(blob, 4 * n, np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def _spans(joined: bytes) -> pa.BinaryArray:
    """Words, one at least, that are joined by spaces."""
    raw = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    offsets = np.concatenate([[0], gaps - np.arange(gaps.size), [raw.size - gaps.size]]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), offsets.size - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[raw != 32])])


def _joined(words: pa.BinaryArray) -> bytes:
    """Words joined by spaces, without a Python object for each."""
    every = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(every, pa.scalar(b" ", pa.binary()))[0].as_py()


def _order(x: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 64-bit numbers. Numbers that hold their places are sorted:
    that takes a fraction of the time of sorting places."""
    bits = np.uint64(max(1, x.size.bit_length()))
    place, low = np.arange(x.size, dtype=np.uint64), np.uint64((1 << int(bits)) - 1)
    order = (np.sort((x << bits) | place) & low).view(np.int64)
    high = x >> (np.uint64(64) - bits)
    if high.any():
        order = order[(np.sort((high[order] << bits) | place) & low).view(np.int64)]
    return order


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _record(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _squash(z):
    return 1 / (1 + np.exp(-np.clip(z, -20, 20)))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


# ---------------------------------------------------------------- chunks and tokens

CHUNKS = "g long, n_docs int, n_bytes int, file string, place int, n_named int, named binary, counts binary"
_BLOBS = ("ids", "known", "held", "sizes", "n", "words", "flat", "shape")


def _chunks(docs: DataFrame) -> DataFrame:
    """Writes texts, lower-cased, in chunks, each as its distinct words and the codes of its
    tokens, so that no later step splits it again, and gives a row for each chunk: its file,
    its place there, and its most frequent training words. A retried task writes a file of its
    own; only files in the table count."""
    out = shared_files(docs.sparkSession, "text-chunks")

    def gather(batches):
        import pyarrow.ipc as ipc

        task, part, ids, held, texts, size = TaskContext.get().partitionId(), 0, [], [], [], 0
        system, folder = filesystem(out)
        system.create_dir(folder, recursive=True)
        name = f"{task}-{uuid.uuid4().hex}.arrow"
        sink = writer = None

        def row():
            raw = b"\n".join([*texts, b""]).lower()
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            known = np.array([i is not None for i in ids])
            number = np.array([i or 0 for i in ids], np.int64)
            apart = np.array(held, bool)
            t = Tokens(apart, sizes, *split(sizes, raw))
            packed = [*(_zip(x) for x in (number, known, apart, sizes, t.n, t.joined)), _planes(t.flat), np.array([len(t.joined), t.flat.size]).tobytes()]
            writer.write_batch(pa.record_batch([pa.array([x], pa.binary()) for x in packed], names=_BLOBS))
            n = np.bincount(t.flat[t.train], minlength=t.end + 1)
            n[-1] = 0  # the end isn't a word
            top = np.argsort(-n, kind="stable")[:NAMED]
            # The last is named for its count alone, above which no word is left out.
            top = top[n[top] > 0]
            return _record(CHUNKS, [{
                "g": (task << 24) + part, "n_docs": len(ids), "n_bytes": len(raw), "file": f"{out}/{name}", "place": part, "n_named": top.size,
                "named": b" ".join([t.words[k] for k in top.tolist()]), "counts": n[top].astype(np.int64).tobytes(),
            }])

        for batch in parts(batches):
            for i, out_, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), as_bytes(batch.column("text"))):
                if writer is None:
                    sink = system.open_output_stream(f"{folder}/{name}")
                    writer = ipc.new_file(sink, pa.schema([(x, pa.binary()) for x in _BLOBS]))
                ids.append(i)
                held.append(out_)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield row()
                    part, ids, held, texts, size = part + 1, [], [], [], 0
        if ids:
            yield row()
        if writer is not None:
            writer.close()
            sink.close()

    found = materialize(map_arrow(docs.select("doc_id", "held_out", "text"), gather, CHUNKS), "chunks")
    # The table is small, its files large: a task for each chunk.
    return found.repartition(max(1, min(found.count(), 20_000)))


def _blobs(row) -> dict[str, bytes]:
    """Of a row of the table of chunks, what its file holds."""
    import pyarrow.ipc as ipc

    system, path = filesystem(row["file"])
    with system.open_input_file(path) as source:
        batch = ipc.open_file(source).get_batch(row["place"])
        return {x: batch.column(x)[0].as_py() for x in _BLOBS}


def _tokens(row) -> Tokens:
    held = _blobs(row)
    n, (n_joined, n_tokens) = row["n_docs"], np.frombuffer(held["shape"], np.int64).tolist()
    sizes, tokens = (_unzip(held[x], n, np.int64) for x in ("sizes", "n"))
    t = Tokens(_unzip(held["held"], n, np.bool_), sizes, _unzip(held["words"], n_joined), tokens, _unzip_planes(held["flat"], n_tokens).astype(np.int64))
    t.ids, t.known = _unzip(held["ids"], n, np.int64), _unzip(held["known"], n, np.bool_)
    return t


def split(sizes: np.ndarray, raw: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Of texts of so many bytes, one after another: their distinct words and the end, joined
    by spaces; the number of tokens of each text; the tokens' codes."""
    raw = np.frombuffer(raw, np.uint8)
    inside = (raw > 32) | (raw < 9) | ((raw > 13) & (raw < 32))
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    turn = np.concatenate([np.flatnonzero(inside[:1]), turn])
    starts, ends = turn[::2], turn[1::2]  # a text ends with a line feed
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    spans = pa.BinaryArray.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = spans.dictionary_encode()
    words = _joined(coded.dictionary) + b" " * (len(coded.dictionary) > 0) + END
    n = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))) + 1
    flat = np.full(starts.size + n.size, len(coded.dictionary), np.int64)
    spot = np.ones(flat.size, bool)
    spot[np.cumsum(n) - 1] = False
    flat[spot] = coded.indices.to_numpy()
    return words, n, flat


class Tokens:
    """The tokens of a chunk: ``flat`` codes, text by text, of the words that are ``joined``
    (the end is the last of these); ``n`` tokens and ``held`` of each text; ``train``, whether
    a token is learned from."""

    def __init__(self, held: np.ndarray, sizes: np.ndarray, joined: bytes, n: np.ndarray, flat: np.ndarray):
        self.held, self.bytes, self.joined, self.n, self.flat = held, sizes, joined, n, flat
        self.first = np.cumsum(n) - n
        self.text = np.repeat(np.arange(n.size), n)
        self.train = np.repeat(~held, n)
        self.end = joined.count(b" ")

    @functools.cached_property
    def words(self) -> list[bytes]:
        return self.joined.split(b" ")

    def hashes(self) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh64_intdigest, self.words, itertools.repeat(1)), np.uint64, len(self.words))

    def frequent(self, place: dict[bytes, int]) -> np.ndarray:
        """Of each token its number among frequent words, or -1."""
        return self.codes(list(place), np.array([*place.values(), -1], np.int64))[self.flat]

    def codes(self, words: list[bytes], numbers: np.ndarray) -> np.ndarray:
        """Of each distinct word the number of the same one in ``words``, or the last number."""
        at = pc.index_in(_spans(self.joined), value_set=pa.array(words, pa.binary()))
        return numbers[pc.fill_null(at, len(words)).to_numpy()]

    def before(self, x: np.ndarray, start, by: int = 1) -> np.ndarray:
        """``x`` of the token before, ``start`` before a text's first."""
        out = np.empty_like(x)
        out[by:] = x[:-by]
        out[:by] = start
        for k in range(by):
            at = self.first + k
            out[at[k < self.n]] = start
        return out

    def classes(self, group: np.ndarray) -> np.ndarray:
        """Of each token the group with most of the text's frequent words before it."""
        # It changes only after a frequent word. The greatest count is sought together with
        # its group, the first of equals.
        at = np.flatnonzero(group >= 0)
        some, here = group[at], self.text[at]
        edges = np.searchsorted(at, self.first)
        most = np.zeros(at.size, np.int64)
        for k in range(GROUPS):
            held = np.concatenate([[0], np.cumsum(some == k, dtype=np.int64)])
            n = held[1:] - held[edges][here]
            np.maximum(most, n * GROUPS + (GROUPS - 1 - k), out=most)
        # Each holds up to the next frequent word or the text's end, inclusive.
        until = np.minimum(np.append(at[1:] + 1, self.flat.size), (self.first + self.n)[here])
        spans = until - at - 1
        out = np.full(self.flat.size, GROUPS, np.int64)
        out[np.repeat(at + 1 - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())] = np.repeat(GROUPS - 1 - most % GROUPS, spans)
        return out


def _frequent(chunks: DataFrame) -> list[bytes]:
    """The most frequent words of training texts, by exact counts, then by bytes.

    A word that a chunk doesn't name occurs there no more often than the last that it names. So
    a word's count lies between the sum of what is named and that plus the last counts of the
    other chunks; only words whose upper bound reaches the FREQUENT-th lower bound are counted."""

    def read(batches):
        for row in _rows(batches):
            words = row["named"].split(b" ") if row["n_named"] else []
            counts = np.frombuffer(row["counts"], np.int64)
            last = int(counts[-1]) if counts.size == NAMED else 0
            if words:
                columns = [pa.array(words, pa.binary()), pa.array(counts), pa.array(np.full(len(words), last))]
                yield pa.record_batch(columns, names=["w", "n", "last"])

    sums = chunks.select("n_named", F.col("counts"))

    def lasts(batches):
        for row in _rows(batches):
            counts = np.frombuffer(row["counts"], np.int64)
            yield pa.record_batch([pa.array([int(counts[-1]) if counts.size == NAMED else 0])], names=["last"])

    every = map_arrow(sums, lasts, "last long").agg(F.sum("last")).first()[0] or 0
    named = map_arrow(chunks, read, "w binary, n long, last long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("last").alias("last"))
    named = materialize(named, "named-words")
    least = named.orderBy(F.desc("n")).limit(FREQUENT).agg(F.min("n"), F.count("*")).first()
    bound = least[0] if least[1] == FREQUENT else 0
    chosen = [bytes(r["w"]) for r in named.where(F.col("n") + every - F.col("last") >= bound).select("w").collect()]

    def count(batches):
        for row in _rows(batches):
            t = _tokens(row)
            n = np.bincount(t.flat[t.train], minlength=t.end + 1)
            at = t.codes(chosen, np.append(np.arange(len(chosen)), -1))
            some = np.flatnonzero((at >= 0) & (n > 0))
            yield pa.record_batch([pa.array([chosen[k] for k in at[some].tolist()], pa.binary()), pa.array(n[some].astype(np.int64))], names=["w", "n"])

    found = map_arrow(chunks, count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(FREQUENT)
    return [bytes(r["w"]) for r in found.collect()]


def _follow(chunks: DataFrame, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Over training texts, of frequent words, the start (a row) and the end (a column): how
    often one is the next token after another (last column: any next token), and how often
    the next of them."""
    size = FREQUENT + 2

    def count(batches):
        next_one, next_of = np.zeros((size, size), np.int64), np.zeros((size, size), np.int64)
        for row in _rows(batches):
            t = _tokens(row)
            f = t.frequent(place)
            f[t.flat == t.end] = FREQUENT
            before = t.before(f, FREQUENT)
            led = t.train & (before >= 0)
            next_one += np.bincount(before[led] * size + np.where(f[led] >= 0, f[led], size - 1), minlength=size * size).reshape(size, size)
            some = np.flatnonzero((f >= 0) & (f < FREQUENT) & t.train)
            a, b = some[:-1], some[1:]
            same = t.text[a] == t.text[b]
            next_of += np.bincount(f[a][same] * size + f[b][same], minlength=size * size).reshape(size, size)
        rows = []
        for kind, m in ((0, next_one), (1, next_of)):
            at = np.flatnonzero(m)
            rows += [(kind, int(k), int(n)) for k, n in zip(at, m.ravel()[at])]
        if rows:
            yield pa.record_batch([pa.array(c, x) for c, x in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], names=["kind", "at", "n"])

    out = np.zeros((2, size * size), np.int64)
    for r in map_arrow(chunks, count, "kind int, at int, n long").groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        out[r["kind"], r["at"]] = r["n"]
    next_one, next_of = out.reshape(2, size, size)
    next_one[:, -1] = next_one.sum(1)
    return next_one, next_of[:FREQUENT, :FREQUENT]


def _groups(next_of: np.ndarray, n_top: int) -> np.ndarray:
    """The group of each frequent word. The two groups whose neighbours' distributions (square
    roots) are nearest, weighted by how much they cover, are merged again and again."""
    m = np.concatenate([next_of, next_of.T], 1)[:n_top].astype(float) + 1e-9
    held, rows = [[i] for i in range(n_top)], list(m)
    while len(held) > GROUPS:
        mass = np.array([r.sum() for r in rows])
        x = np.sqrt(np.array(rows) / mass[:, None])
        cost = (2 - 2 * x @ x.T) * mass[:, None] * mass / (mass[:, None] + mass)
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(np.unravel_index(int(np.argmin(cost)), cost.shape))
        held[i] += held.pop(j)
        rows[i] = rows[i] + rows.pop(j)
    out = np.full(FREQUENT + 1, -1)
    for g, members in enumerate(held):
        out[members] = g
    return out


# ---------------------------------------------------------------- pairs of words and classes

SENT = "shard int, g long, first int, n_pairs int, n_bytes int, words binary, new binary, class binary, n binary"
PAIRS = (
    "shard int, n_pairs int, n_bytes int, words binary, code binary, class binary, n binary, c binary, "
    "n_from int, from binary, n_back int, back binary"
)


def _pairs_of(t: Tokens, hashes: np.ndarray, kind: np.ndarray, shards: int):
    """The distinct (shard, word, class) of a chunk's tokens in order: words, classes, where
    shards begin among them and the number of all, and where each token is among them."""
    shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(order.size)
    pair = rank[t.flat] * CLASSES + kind
    met = np.zeros(order.size * CLASSES, bool)
    met[pair] = True
    unique, place = np.flatnonzero(met), np.cumsum(met, dtype=np.int32)
    edges = np.searchsorted(unique, np.searchsorted(shard[order], np.arange(shards + 1)) * CLASSES)
    return order[unique // CLASSES], unique % CLASSES, edges, place[pair] - 1


def _pairs(chunks: DataFrame, place: dict, group: np.ndarray, shards: int) -> DataFrame:
    """A row for each shard of words: its distinct (word, class) pairs in order of word and
    class, with training counts n and the word's c, and where each chunk's pairs are among
    them (from: g, first, number; back: places)."""

    def send(batches):
        for row in _rows(batches):
            t = _tokens(row)
            word, kind, edges, back = _pairs_of(t, t.hashes(), t.classes(group[t.frequent(place)]), shards)
            train = np.bincount(back[t.train], minlength=word.size)
            rows = []
            for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if a < b:
                    new = np.concatenate([[True], word[a + 1 : b] != word[a : b - 1]])
                    joined = b" ".join([t.words[k] for k in word[a:b][new].tolist()])
                    rows.append({
                        "g": row["g"], "shard": s, "first": a, "n_pairs": b - a, "n_bytes": len(joined), "words": _zip(joined),
                        "new": _zip(np.packbits(new)), "class": _zip(kind[a:b].astype(np.uint8)), "n": _zip(train[a:b]),
                    })
            yield _record(SENT, rows)

    def merge(batches):
        held: dict[int, list] = {}
        for row in _rows(batches):
            held.setdefault(row["shard"], []).append(row)
        for shard in sorted(held):
            rows = held.pop(shard)
            words, word, base = [], [], 0
            for r in rows:
                words.append(_unzip(r["words"], r["n_bytes"]))
                new = np.unpackbits(_unzip(r["new"], -(-r["n_pairs"] // 8), np.uint8), count=r["n_pairs"])
                word.append(np.cumsum(new) - 1 + base)
                base += int(new.sum(dtype=np.int64))
            coded = _spans(b" ".join(words)).dictionary_encode()
            del words
            order = pc.array_sort_indices(coded.dictionary)
            joined = _joined(coded.dictionary.take(order))
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(rank.size)
            code = rank[coded.indices.to_numpy()[np.concatenate(word)]]
            kind = np.concatenate([_unzip(r["class"], r["n_pairs"], np.uint8) for r in rows])
            n = np.concatenate([_unzip(r["n"], r["n_pairs"], np.int64) for r in rows])
            unique, back = np.unique(code * CLASSES + kind, return_inverse=True)
            n = np.rint(np.bincount(back, n, unique.size)).astype(np.int64)
            code = unique // CLASSES
            c = np.rint(np.bincount(code, n, rank.size)).astype(np.int64)
            origin = np.array([(r["g"], r["first"], r["n_pairs"]) for r in rows], np.int64)
            yield _record(PAIRS, [{
                "shard": shard, "n_pairs": unique.size, "n_bytes": len(joined),
                "words": _zip(joined), "code": _zip(code.astype(np.int32)), "class": _zip((unique % CLASSES).astype(np.uint8)),
                "n": _zip(n), "c": _zip(c[code]), "n_from": len(rows), "from": _zip(origin), "n_back": back.size,
                "back": _zip(back.astype(np.int32)),
            }])

    sent = map_arrow(chunks, send, SENT)
    return materialize(map_arrow(sent.repartition(shards, "shard"), merge, PAIRS), "pairs")


def _pair_arrays(row) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of a row of the table of pairs: words, classes, training counts of pairs and words."""
    words = _unzip(row["words"], row["n_bytes"]).split(b" ")
    code = _unzip(row["code"], row["n_pairs"], np.int32)
    n, c = (_unzip(row[x], row["n_pairs"], np.int64) for x in ("n", "c"))
    return [words[k] for k in code.tolist()], _unzip(row["class"], row["n_pairs"], np.uint8).astype(np.int64), n, c


def _totals(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Of each class its training tokens and the tokens of words that it hasn't seen; counts
    of bytes in training words; the numbers of pairs and of tokens seen in training."""

    def add(batches):
        seen, unseen, sizes, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), np.zeros(256, np.int64), 0
        distinct = 0
        for row in _rows(batches):
            words, kind, n, c = _pair_arrays(row)
            seen += np.rint(np.bincount(kind, n, CLASSES)).astype(np.int64)
            code = _unzip(row["code"], row["n_pairs"], np.int32)
            first = np.concatenate([[True], code[1:] != code[:-1]])
            met = n > 0
            unseen += int(c[first].sum()) - np.rint(np.bincount(kind[met], c[met], CLASSES)).astype(np.int64)
            types += int(met.sum())
            some = np.flatnonzero(first & (c > 0))
            distinct += some.size
            sizes += np.bincount(np.frombuffer(b" ".join([*(words[k] for k in some.tolist()), b""]), np.uint8), minlength=256)
        row = [x.tobytes() for x in (seen, unseen, sizes)]
        yield pa.record_batch([*(pa.array([x], pa.binary()) for x in row), pa.array([types]), pa.array([distinct])], names=["seen", "unseen", "sizes", "types", "distinct"])

    rows = map_arrow(pairs.select("n_pairs", "n_bytes", "words", "code", "class", "n", "c"), add, "seen binary, unseen binary, sizes binary, types long, distinct long")
    out = [np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64), np.zeros(256, np.int64), 0, 0]
    for r in rows.collect():  # a row for each task
        for k, x in enumerate(("seen", "unseen", "sizes")):
            out[k] = out[k] + np.frombuffer(r[x], np.int64)
        out[3] += r["types"]
        out[4] += r["distinct"]
    return tuple(out)


# ---------------------------------------------------------------- spelling


def huffman(weights) -> list[list[tuple[int, int]]]:
    """For each of 256 bytes its path of (node, bit)."""
    heap = [(float(w) + 1, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    children = {}
    for k in range(256, 511):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[k] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], k, k))
    paths: list = [None] * 256
    stack = [(510, [])]
    while stack:
        node, path = stack.pop()
        if node < 256:
            paths[node] = path
        else:
            for bit in (0, 1):
                stack.append((children[node][bit], [*path, (node - 256, bit)]))
    return paths


class Coder:
    """Turns (class, word) pairs into flat arrays of binary decisions. ``types`` pairs are
    expected in the tables."""

    def __init__(self, weights, types: int = 1 << 20):
        paths = huffman(weights)
        self.size = np.array([len(p) for p in paths])
        self.first = np.cumsum(self.size) - self.size
        self.node = np.array([n for p in paths for n, _ in p], np.uint64)
        self.bit = np.array([b for p in paths for _, b in p], np.uint8)
        need = max(10, int(types * 16).bit_length())
        self.bits = [min(b, need) for b in MOST_BITS]
        self.offsets = np.concatenate([[0], np.cumsum([1 << b for b in self.bits])]).astype(np.int64)

    def decisions(self, words: list[bytes], classes: np.ndarray):
        """(pair, bit, slots [CONTEXTS, n]) of all decisions."""
        raw = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        sizes = np.array([len(w) + 1 for w in words])
        pair = np.repeat(np.arange(sizes.size), sizes)
        start = np.cumsum(sizes) - sizes
        depth = np.arange(raw.size) - start[pair]
        b = raw.astype(np.uint64)
        back = []
        for k in (1, 2, 3, 4, 5):
            x = np.zeros(raw.size, np.uint64)
            x[k:] = b[:-k] + np.uint64(1)
            x[depth < k] = 0
            back.append(x)
        # Prefix hash: a polynomial in the bytes before, relative to the word's start.
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(raw.size, _A)]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(raw.size, np.uint64(pow(int(_A), -1, 1 << 64)))]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        here = start[pair]
        prefix = (sums[np.arange(raw.size)] - sums[here]) * down[here]
        c = (classes.astype(np.uint64) + np.uint64(1))[pair]
        two = c + (back[0] << np.uint64(8)) + (back[1] << np.uint64(17))
        three = two + (back[2] << np.uint64(26))
        five = three + (back[3] << np.uint64(35)) + (back[4] << np.uint64(44))
        contexts = [c + (back[0] << np.uint64(9)), two, three, five, prefix]
        n = self.size[raw]
        byte = np.repeat(np.arange(raw.size), n)
        at = self.first[raw][byte] + np.arange(byte.size) - np.repeat(np.cumsum(n) - n, n)
        node, bit = (self.node[at] + np.uint64(1)) * _B, self.bit[at]
        slots = np.empty((CONTEXTS, byte.size), np.int32)
        for k, (x, bits) in enumerate(zip(contexts, self.bits)):
            h = ((x * _A) ^ (x >> np.uint64(29)))[byte] + node
            h ^= h >> np.uint64(32)
            h *= _A
            slots[k] = (h >> np.uint64(64 - bits)).astype(np.int32) + np.int32(self.offsets[k])
        return pair[byte], bit, slots


COUNTED = "slice int, n int, at binary, zeros binary, ones binary"


def _bit_counts(pairs: DataFrame, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """Merged counts of 0 and 1 bits by slot; each distinct training pair counts once."""
    total = int(coder.offsets[-1])
    slices = -(-total // SLICE)

    def count(batches):
        counts = np.zeros((total, 2), np.float32)
        flat = counts.reshape(-1)
        for row in _rows(batches):
            words, classes, n, _ = _pair_arrays(row)
            some = np.flatnonzero(n > 0)
            for i in range(0, some.size, STEP):
                s = some[i : i + STEP]
                _, bit, slots = coder.decisions([words[k] for k in s], classes[s])
                for x in slots:
                    np.add.at(flat, 2 * x + bit, np.float32(1))
        used = np.flatnonzero(flat.view(np.uint64))
        edges = np.searchsorted(used, np.arange(slices + 1) * SLICE)
        rows = []
        for s in range(slices):
            x = used[edges[s] : edges[s + 1]]
            if x.size:
                at = (x - s * SLICE).astype(np.uint32)
                rows.append({"slice": s, "n": x.size, "at": _zip(at), "zeros": _zip(counts[x, 0]), "ones": _zip(counts[x, 1])})
        if rows:
            yield _record(COUNTED, rows)

    def merge(batches):
        sums = {}
        for r in _rows(batches):
            total = sums.setdefault(r["slice"], np.zeros((2, SLICE)))
            x = _unzip(r["at"], r["n"], np.uint32)
            for row, blob in zip(total, (r["zeros"], r["ones"])):
                row[x] += _unzip(blob, r["n"], np.float32)
        if sums:
            yield _record("slice int, counts binary", [{"slice": s, "counts": _zip(v.astype(np.float32))} for s, v in sums.items()])

    counted = map_arrow(pairs, count, COUNTED)
    merged = map_arrow(counted.repartition(slices, "slice"), merge, "slice int, counts binary")
    out = np.zeros((2, slices * SLICE), np.float32)
    for row in merged.collect():
        s = row["slice"] * SLICE
        out[:, s : s + SLICE] = _unzip(bytes(row["counts"]), 2 * SLICE, np.float32).reshape(2, SLICE)
    return out[0, :total].copy(), out[1, :total].copy()


_LOADED: dict = {}


def _beside(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The counts of 0 and 1 bits of each slot side by side, as one number: one access to memory."""
    counts = np.empty((zeros.size, 2), np.float32)
    counts[:, 0], counts[:, 1] = zeros, ones
    return counts.view(np.uint64).ravel()


def _loaded(tables) -> np.ndarray:
    """The counts of 0 and 1 bits, unpacked once for each Python worker. They are broadcast
    packed, as every executor stores a broadcast on its disk."""
    if _LOADED.get("of") is not tables:
        total, *blobs = tables.value
        _LOADED.update({"of": tables, "counts": _beside(*(_unzip_planes(blob, total) for blob in blobs))})
    return _LOADED["counts"]


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 0.5).astype(np.int64) + (n > 2.5) + (n > 8.5) + (n > 40.5)


def _place(z):
    """Lower bin and share of the upper one for the probability map."""
    x = (np.clip(z, -11.99, 11.99) + 12) * ((BINS - 1) / 24)
    low = x.astype(np.int64)
    return low, x - low


def _inputs(bit, slots, own, counts):
    """Stretched predictions [CONTEXTS, n] and gates of decisions; ``own`` is 1 where the
    pair itself was counted, which is left out."""
    up = bit == 1
    own_zero, own_one = own * ~up, own * up
    x, levels = np.empty((CONTEXTS, bit.size), np.float32), []
    for k in range(CONTEXTS):
        found = counts[slots[k]].view(np.float32).reshape(-1, 2)
        a, b = found[:, 0] - own_zero, found[:, 1] - own_one
        x[k] = np.log((b + DELTA) / (a + DELTA))
        if k >= 3:
            levels.append(_level(a + b))
    return x, levels[0] * 5 + levels[1]


def _mixed(weights, gate, x) -> np.ndarray:
    """The sum of predictions by the weights of their gates."""
    z = weights[:, 0][gate] * x[0]
    for k in range(1, len(x)):
        z += weights[:, k][gate] * x[k]
    return z


def _learn(pairs: DataFrame, coder: Coder, tables) -> tuple[np.ndarray, np.ndarray]:
    """Mixing weights [SETS, CONTEXTS] and the probability map [SETS, BINS], from the words
    that occur once in training texts. Each shard learns in the order of its words; shards
    are averaged by their decisions."""

    def fit(batches):
        counts = _loaded(tables)
        for row in _rows(batches):
            weights, load = np.full((SETS, CONTEXTS), 0.3), np.zeros(SETS)
            seen, hits = np.zeros((SETS, BINS)), np.zeros((SETS, BINS))
            words, classes, n, c = _pair_arrays(row)
            some = np.flatnonzero((n == 1) & (c == 1))
            for i in range(0, some.size, STEP):
                s = some[i : i + STEP]
                _, bit, slots = coder.decisions([words[k] for k in s], classes[s])
                x, gate = _inputs(bit, slots, np.float32(1), counts)
                up = bit == 1
                step = 1 << 12
                for a in range(0, bit.size, step):
                    g, xb = gate[a : a + step], x[:, a : a + step]
                    z = _mixed(weights, g, xb)
                    low, share = _place(z)
                    for at, part in ((low, 1 - share), (low + 1, share)):
                        cell = g * BINS + at
                        seen += np.bincount(cell, part, SETS * BINS).reshape(SETS, BINS)
                        hits += np.bincount(cell, part * up[a : a + step], SETS * BINS).reshape(SETS, BINS)
                    err = up[a : a + step] - _squash(z)
                    mass = np.bincount(g, minlength=SETS)
                    move = np.stack([np.bincount(g, err * xb[k], SETS) for k in range(CONTEXTS)], 1)
                    weights += 0.08 * move / np.maximum(mass, 32)[:, None]
                    load += mass
            out = [weights.tobytes(), load.tobytes(), seen.tobytes(), hits.tobytes()]
            names = ["shard", "weights", "load", "seen", "hits"]
            yield pa.record_batch([pa.array([row["shard"]], pa.int32()), *(pa.array([v], pa.binary()) for v in out)], names=names)

    chosen = pairs.select("shard", "n_pairs", "n_bytes", "words", "code", "class", "n", "c")
    found = map_arrow(chosen, fit, "shard int, weights binary, load binary, seen binary, hits binary").collect()  # some KB for each shard
    weights, load = np.full((SETS, CONTEXTS), 0.3), np.full(SETS, 1e-9)
    total = weights * load[:, None]
    seen, hits = np.zeros((SETS, BINS)), np.zeros((SETS, BINS))
    for row in sorted(found, key=lambda r: r["shard"]):
        here = np.frombuffer(row["load"])
        total += np.frombuffer(row["weights"]).reshape(SETS, CONTEXTS) * here[:, None]
        load += here
        seen += np.frombuffer(row["seen"]).reshape(SETS, BINS)
        hits += np.frombuffer(row["hits"]).reshape(SETS, BINS)
    centre = _squash(np.linspace(-12, 12, BINS))[None]
    return total / load[:, None], (hits + 4 * centre) / (seen + 4)


def spell(words, classes, own, coder: Coder, zeros, ones, weights, refine) -> np.ndarray:
    """log10 of the probability of each word's bytes; ``own`` is 1 for a word that is in the
    tables and is left out there."""
    return _spell(words, classes, own, coder, _beside(zeros, ones), weights, refine)


def _spell(words, classes, own, coder: Coder, counts, weights, refine) -> np.ndarray:
    out = np.zeros(len(words))
    flat = refine.reshape(-1)
    for i in range(0, len(words), STEP):
        pair, bit, slots = coder.decisions(words[i : i + STEP], classes[i : i + STEP])
        x, gate = _inputs(bit, slots, own[i : i + STEP][pair].astype(np.float32), counts)
        z = _mixed(weights, gate, x)
        low, share = _place(z)
        cell = gate * BINS + low
        p = 0.5 * _squash(z) + 0.5 * (flat[cell] * (1 - share) + flat[cell + 1] * share)
        p = np.clip(np.where(bit == 1, p, 1 - p), 1e-6, 1)
        out[i : i + STEP] = np.bincount(pair, np.log10(p), min(STEP, len(words) - i))
    return out


# ---------------------------------------------------------------- contexts of words

#: Levels of how often the first candidate came, and of how often another token did.
_HITS = np.array([1, 2, 3, 5, 9])
_MISSES = np.array([0, 1, 2, 3, 5, 9, 17, 33, 129])
#: Of each number up to the last its level.
_HIT_LEVEL, _MISS_LEVEL = (np.searchsorted(x, np.arange(x[-1] + 1), side="right") - 1 for x in (_HITS, _MISSES))
STATES = 1 + _HITS.size * _MISSES.size
#: A byte: 0 without a candidate, else 2 * state + whether the candidate came (state from 1).


def _state(k: np.ndarray, n: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The history of a candidate that came k times of n, and whether it comes now."""
    state = 1 + _HIT_LEVEL[np.clip(k, 0, _HITS[-1])] * _MISSES.size + _MISS_LEVEL[np.clip(n - k, 0, _MISSES[-1])]
    return np.where(k > 0, 2 * state + hit, 0).astype(np.uint8)


def _states(k1, h1, k2, h2, n, k, h, own) -> np.ndarray:
    """Of tokens with hash h that came k times in contexts of n tokens whose first two
    candidates came k1 and k2 times. ``own`` is 1 where the token itself was counted."""
    first = h == h1
    k1 = k1 - own * first
    swap = first & ((k1 < k2) | ((k1 == k2) & (h2 < h1)))
    hit = np.where(swap, False, first) & (k1 > 0)
    # A second candidate that is the token itself loses an own count too, and stays behind.
    return _state(np.where(swap, k2, k1), n - own, hit)


ENTRIES = "shard int, g long, first int, n int, keys binary, counts binary"


def context_bits(tokens: int) -> int:
    return min(47, max(12, int(tokens).bit_length() + 5))


def _keys_of(t: Tokens, hashes: np.ndarray, frequent: np.ndarray, bits: int):
    """The context entries of a chunk's tokens, those of one word and then those of two, and
    of each order the tokens that have one."""
    h = hashes[t.flat]
    one, two = t.before(h, _START), t.before(h, _START, 2)
    f1, f2 = t.before(frequent, FREQUENT), t.before(frequent, FREQUENT, 2)
    some = np.flatnonzero(f1 < 0)
    both = np.flatnonzero((f1 < 0) | (f2 < 0))
    # Half of the space of contexts for each order.
    half, down = np.uint64(1 << (bits - 1)), np.uint64(65 - bits)
    a = (_mix64(one[some]) >> down << W_BITS) | (h[some] & LOW)
    b = ((_mix64(two[both] * _B + one[both] + np.uint64(1)) >> down | half) << W_BITS) | (h[both] & LOW)
    return np.concatenate([a, b]), some, both


def _counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, below 2**63, and how often each is in training tokens."""
    both = np.sort((keys << np.uint64(1)) | train)
    keys = both >> np.uint64(1)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat((both & np.uint64(1)).astype(np.uint32), at)


def _inverse(keys: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of distinct keys and where each key is among them in order."""
    order = _order(keys)
    keys = keys[order]
    back = np.empty(keys.size, np.int64)
    back[order] = np.cumsum(np.concatenate([[False], keys[1:] != keys[:-1]]))
    return int(back[order[-1]]) + 1, back


def _shard_edges(shards: int, bits: int) -> np.ndarray:
    """First keys of the shards; a context's entries are in one."""
    return (np.arange(shards, dtype=np.float64) / shards * 2.0**bits).astype(np.uint64) << W_BITS


def _range_states(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries (keys of whole contexts, any order, with training counts) the byte for a
    training token and that for another."""
    if not key.size:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint8)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.flatnonzero(new)
    unique = ordered[at]
    k = np.add.reduceat(n[order], at, dtype=np.int64)
    back = np.empty(key.size, np.int64)
    back[order] = np.cumsum(new) - 1
    del ordered, order, new
    h = (unique & LOW).astype(np.int64)
    context = unique >> W_BITS
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    of = np.repeat(np.arange(starts.size), np.diff(np.append(starts, unique.size)))
    total = np.add.reduceat(k, starts)
    # The first two candidates: most often, then least hash.
    low = np.int64(LOW)
    rank = (k << np.int64(17)) | (low - h)
    top = np.maximum.reduceat(rank, starts)
    second = np.maximum.reduceat(np.where(rank == top[of], np.int64(0), rank), starts)
    split = lambda r: (r >> np.int64(17), low - (r & low))
    (k1, h1), (k2, h2) = split(top), split(second)
    args = (k1[of], h1[of], k2[of], h2[of], total[of], k, h)
    return _states(*args, (k > 0).astype(np.int64))[back], _states(*args, 0)[back]


def _histories(chunks: DataFrame, place: dict, shards: int, bits: int) -> DataFrame:
    """(g, first, n, a, b): of each chunk's entries, from number ``first`` on, the byte for a
    training token and that for another."""
    starts = _shard_edges(shards, bits)

    def send(batches):
        for row in _rows(batches):
            t = _tokens(row)
            keys, *orders = _keys_of(t, t.hashes(), t.frequent(place), bits)
            if not keys.size:
                continue
            entries, counts = _counted(keys, np.concatenate([t.train[x] for x in orders]))
            edges = np.append(np.searchsorted(entries, starts), entries.size)
            rows = []
            for s, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                if a < b:
                    rows.append({"shard": s, "g": row["g"], "first": a, "n": b - a, "keys": _zip_sorted(entries[a:b]), "counts": _planes(counts[a:b])})
                    if len(rows) >= 64:
                        yield _record(ENTRIES, rows)
                        rows = []
            if rows:
                yield _record(ENTRIES, rows)

    def merge(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["shard"], []).append(r)
        for shard in list(held):
            rows = held.pop(shard)
            keys = [_unzip_sorted(r["keys"], r["n"]) for r in rows]
            counts = [_unzip_planes(r["counts"], r["n"]) for r in rows]
            sent = [(r["g"], r["first"], r["n"]) for r in rows]
            del rows
            found = [(np.empty(k.size, np.uint8), np.empty(k.size, np.uint8)) for k in keys]
            # Range by range of keys, whole contexts each, for memory's sake.
            low, high = int(min(k[0] for k in keys)) >> int(W_BITS), (int(max(k[-1] for k in keys)) >> int(W_BITS)) + 1
            ranges = max(1, sum(k.size for k in keys) // PART)
            edges = np.array([(low + (high - low) * i // ranges) << int(W_BITS) for i in range(1, ranges)], np.uint64)
            cuts = [np.concatenate([[0], np.searchsorted(k, edges), [k.size]]) for k in keys]
            for i in range(ranges):
                spans = [(c[i], c[i + 1]) for c in cuts]
                states = _range_states(*(np.concatenate([x[p:q] for x, (p, q) in zip(xs, spans)]) for xs in (keys, counts)))
                at = 0
                for (p, q), mine in zip(spans, found):
                    for x, all_of in zip(mine, states):
                        x[p:q] = all_of[at : at + q - p]
                    at += q - p
            del keys, counts
            out = []
            for (g, first, size), (trained, other) in zip(sent, found):
                out.append({"g": g, "first": first, "n": size, "a": _zip(trained), "b": _zip(other)})
                if len(out) >= 64:
                    yield _record(RETURNED, out)
                    out = []
            if out:
                yield _record(RETURNED, out)

    sent = map_arrow(chunks, send, ENTRIES)
    return map_arrow(sent.repartition(shards, "shard"), merge, RETURNED)


#: What returns to a chunk: of entries two bytes (kind 1); of pairs the counts of the pair and
#: of the word, and the log-probability of the spelling, of those that need one (kind 0).
RETURNED = "g long, first int, n int, a binary, b binary"
RETURNED_PAIRS = "g long, first int, n int, a binary, b binary, p binary, n_p int"


# ---------------------------------------------------------------- decisions 1 to 4

HISTORY = 6  # hits in a row of decision 1 (none, one, more), and whether the token before was new
OUTCOMES = 3  # known in the class, known at all, new
S = 2 * STATES
N_CELLS = S * S * HISTORY * OUTCOMES


class Mixer:
    """One binary decision: bit predictors by several contexts, mixed by gated weights and
    refined, learned online from counted cells in their order."""

    def __init__(self, contexts: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, n: np.ndarray, epochs: int = 12):
        """Learns from rows with n > 0 and gives ``p``, the probability of a 1, of all rows."""
        gates = int(gate.max(initial=0)) + 1
        x = np.empty((len(contexts) + 1, gate.size))
        share = (float(n[bit == 1].sum()) + DELTA) / (float(n.sum()) + 2 * DELTA)
        for k, context in enumerate(contexts):
            size = int(context.max(initial=0)) + 1
            ones = np.bincount(context[bit == 1], n[bit == 1], size) + 2 * share
            every = np.bincount(context, n, size) + 2
            x[k] = np.log(ones / (every - ones))[context]
        x[-1] = 0.3
        weights = np.full((gates, x.shape[0]), 1.0 / len(contexts))
        weights[:, -1] = 0
        learned = np.flatnonzero(n > 0)
        blocks = np.array_split(learned, max(1, min(64, learned.size // 8)))
        for epoch in range(epochs):
            for block in blocks:
                g, w, xb = gate[block], n[block].astype(float), x[:, block]
                err = w * (bit[block] - _squash(np.einsum("nk,kn->n", weights[g], xb)))
                mass = np.bincount(g, w, gates)
                move = np.stack([np.bincount(g, err * r, gates) for r in xb], 1)
                weights += 0.3 / (1 + epoch / 2) * move / np.maximum(mass, 50)[:, None]
        z = np.einsum("nk,kn->n", weights[gate], x)
        low, part = _place(z)
        seen, hits = np.full((gates, BINS), 4.0), 4 * np.tile(_squash(np.linspace(-12, 12, BINS)), (gates, 1))
        for at, w in ((low, 1 - part), (low + 1, part)):
            np.add.at(seen, (gate, at), n * w)
            np.add.at(hits, (gate, at), n * w * bit)
        refined = hits / seen
        p = 0.5 * _squash(z) + 0.5 * (refined[gate, low] * (1 - part) + refined[gate, low + 1] * part)
        self.p = np.clip(p, 1e-6, 1 - 1e-6)

    def log10(self, bit: np.ndarray) -> np.ndarray:
        return np.log10(np.where(bit == 1, self.p, 1 - self.p))


def cell_scores(cells: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 of the probability of the outcomes of decisions 1 to 4 in each cell, learned from
    how often training tokens are in it (n)."""
    out_of, rest = cells % OUTCOMES, cells // OUTCOMES
    past, rest = rest % HISTORY, rest // HISTORY
    b1, b2 = rest % S, rest // S
    s1, hit1, s2, hit2 = b1 // 2, b1 % 2, b2 // 2, b2 % 2
    coarse = lambda s: np.where(s > 0, 1 + (s - 1) // _MISSES.size, 0)
    some = lambda s: np.where(s > 0, 1 + np.minimum((s - 1) % _MISSES.size // 2, 3), 0)
    score = np.zeros(cells.size)

    def decide(at, contexts, gate, bit):
        at = np.flatnonzero(at)
        if at.size:
            score[at] += Mixer([c[at] for c in contexts], gate[at], bit[at], n[at]).log10(bit[at])

    decide(s2 > 0, [s2, s2 * HISTORY + past, coarse(s2) * STATES + s1, s1 * HISTORY + past], past, hit2)
    left = (s2 == 0) | (hit2 == 0)
    decide(left & (s1 > 0), [s1, s1 * HISTORY + past, some(s1) * STATES + s2], past, hit1)
    left &= (s1 == 0) | (hit1 == 0)
    known = (out_of == 0).astype(np.int64)
    decide(left, [past, s1, s2, some(s1) * HISTORY + past], past, known)
    left &= known == 0
    decide(left, [past, some(s1), some(s2)], past, (out_of == 1).astype(np.int64))
    return score


def cells_of(planes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The cell of each token of texts of so many tokens, from its bytes of order two and one
    and its outcomes."""
    two, one, out_of = planes
    first = np.cumsum(sizes) - sizes

    def before(x, by=1):
        out = np.zeros_like(x)
        out[by:] = x[:-by]
        for k in range(by):
            out[first[sizes > k] + k] = 0
        return out

    hit = two & 1
    past = ((before(hit) + (before(hit) & before(hit, 2))) << 1) + before((out_of == 2).astype(np.uint8))
    return ((two.astype(np.int64) * S + one) * HISTORY + past) * OUTCOMES + out_of


#: A row for each chunk: of its texts the columns of the result but the score, the log-probability
#: apart from decisions 1 to 4, and what the cells of all tokens are made from.
SCORED = "n_docs int, size long, ids binary, known binary, held binary, n binary, n_known binary, base binary, tail binary, n_bytes binary, cells binary"
_SCORED = {"ids": np.int64, "known": np.bool_, "held": np.bool_, "n": np.int64, "n_known": np.int64, "base": np.float64, "tail": np.float64, "n_bytes": np.int64}


def _scored(row, *names) -> list[np.ndarray]:
    """Columns of a row of SCORED, then the cells of its tokens."""
    n = _unzip(row["n"], row["n_docs"], np.int64)
    cells = cells_of(_unzip(row["cells"], 3 * row["size"], np.uint8).reshape(3, -1), n)
    return [*(_unzip(row[x], row["n_docs"], _SCORED[x]) for x in names), cells]


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte
    of every document; ``held_out`` is a column of ``docs``, true for rows not learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    chunks = _chunks(docs)
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(4, -(-size // SHARD))
    top = _frequent(chunks)
    place = {w: i for i, w in enumerate(top)}
    next_one, next_of = _follow(chunks, place)
    group = _groups(next_of, len(top))
    pairs = _pairs(chunks, place, group, shards)
    seen, unseen, sizes, types, distinct = _totals(pairs)
    tokens = int(seen.sum())
    bits = context_bits(size // 4)  # a token has four bytes or more on average
    drop_shuffles(spark)
    coder = Coder(sizes, types)
    counted = pairs.select("n_pairs", "n_bytes", "words", "code", "class", "n", "c")
    zeros, ones = _bit_counts(counted, coder)
    tables = spark.sparkContext.broadcast((zeros.size, _planes(zeros), _planes(ones)))
    del zeros, ones
    weights, refine = _learn(pairs, coder, tables)

    def score_pairs(batches):
        counts = _loaded(tables)
        for row in _rows(batches):
            words, kind, n, c = _pair_arrays(row)
            new = np.flatnonzero(c <= 1)  # also of a single token, which is new to itself
            p = np.zeros(c.size, np.float32)
            p[new] = _spell([words[k] for k in new.tolist()], kind[new], n[new], coder, counts, weights, refine)
            back, rows, at = _unzip(row["back"], row["n_back"], np.int32), [], 0
            for g, first, k in _unzip(row["from"], 3 * row["n_from"], np.int64).reshape(-1, 3).tolist():
                x = back[at : at + k]
                at += k
                spelled = p[x][c[x] <= 1]
                rows.append({"g": g, "first": first, "n": k, "a": _zip(n[x]), "b": _zip(c[x]), "p": _zip(spelled), "n_p": spelled.size})
            yield _record(RETURNED_PAIRS, rows)

    of_pairs = map_arrow(pairs, score_pairs, RETURNED_PAIRS).withColumn("kind", F.lit(0))
    of_entries = _histories(chunks, place, shards, bits).select("g", "first", "n", "a", "b", F.lit(None).cast("binary").alias("p"), F.lit(0).alias("n_p"), F.lit(1).alias("kind"))
    listed = chunks.select("g", F.col("place").alias("first"), F.col("n_docs").alias("n"), F.col("file").cast("binary").alias("a"),
                           F.lit(None).cast("binary").alias("b"), F.lit(None).cast("binary").alias("p"), F.col("n_bytes").alias("n_p"), F.lit(2).alias("kind"))
    returned = of_pairs.select("g", "first", "n", "a", "b", "p", "n_p", "kind").union(of_entries).union(listed)
    floor = np.log10(tokens + 0.5 * (distinct + 1)) if tokens else 0.0
    # Of frequent words and the start: the first two candidates among frequent words and the end.
    followers = next_one[:, : FREQUENT + 1]
    best = np.argsort(-followers, axis=1, kind="stable")[:, :2]
    often = np.take_along_axis(followers, best, 1)
    after = next_one[:, -1]

    def add_up(held: pa.Table) -> pa.Table:
        parts = held.to_pylist()
        del held
        chunk = next(r for r in parts if r["kind"] == 2)
        t = _tokens({"file": chunk["a"].decode(), "place": chunk["first"], "n_docs": chunk["n"], "n_bytes": chunk["n_p"]})
        hashes, frequent = t.hashes(), t.frequent(place)
        kind = t.classes(group[frequent])
        keys, *orders = _keys_of(t, hashes, frequent, bits)
        n_entries, at = _inverse(keys) if keys.size else (0, np.zeros(0, np.int64))
        del keys
        word, classes, _, back = _pairs_of(t, hashes, kind, shards)
        trained, other = np.zeros(n_entries, np.uint8), np.zeros(n_entries, np.uint8)
        n, c, p = np.zeros(word.size, np.int64), np.zeros(word.size, np.int64), np.zeros(word.size, np.float32)
        for r in parts:
            here = slice(r["first"], r["first"] + r["n"])
            if r["kind"] == 1:
                trained[here], other[here] = _unzip(r["a"], r["n"], np.uint8), _unzip(r["b"], r["n"], np.uint8)
            elif r["kind"] == 0:
                n[here], c[here] = _unzip(r["a"], r["n"], np.int64), _unzip(r["b"], r["n"], np.int64)
                p[here][c[here] <= 1] = _unzip(r["p"], r["n_p"], np.float32)
        del parts
        state = np.zeros((2, t.flat.size), np.uint8)
        for k, (some, here) in enumerate(zip(orders, (at[: orders[0].size], at[orders[0].size :]))):
            state[k, some] = np.where(t.train[some], trained[here], other[here])
        one = frequent.copy()
        one[t.flat == t.end] = FREQUENT
        before = t.before(one, FREQUENT)
        some = np.flatnonzero(before >= 0)
        v, w = before[some], one[some]
        mine = np.where(w >= 0, followers[v, w], 0)
        state[0, some] = _states(often[v, 0], best[v, 0], often[v, 1], best[v, 1], after[v], mine, w, t.train[some].astype(np.int64))
        # The chain's last steps, of pairs and then of those without the token itself, which
        # is for where it is learned from.
        lasts, outs = [], []
        for own in (0, 1):
            n_, c_ = n - own, c - own
            out_of = np.where(n_ > 0, 0, np.where(c_ > 0, 1, 2)).astype(np.uint8)
            share = np.where(n_ > 0, n_ / np.maximum(seen[classes] - own, 1), np.where(c_ > 0, c_ / np.maximum(unseen[classes] + own * c_, 1), 1.0))
            lasts.append(np.where(out_of == 2, p, np.log10(np.maximum(np.minimum(share, 1.0), 1e-300))))
            outs.append(out_of)
        mine = back + word.size * t.train
        last, out_of = np.concatenate(lasts)[mine], np.concatenate(outs)[mine]
        hit = state % 2 == 1
        last = np.where(hit.any(0), 0.0, last)
        state[0] = np.where(hit[1], state[0] & 254, state[0])
        planes = np.stack([state[1], state[0], np.where(hit.any(0), 0, out_of).astype(np.uint8)])
        base = (np.log10(c + 0.5) - floor)[back]
        sums = lambda x: np.add.reduceat(x, t.first)
        columns = [t.ids, t.known, t.held, t.n, sums((c > 0).astype(np.int64)[back]), sums(base), sums(last), t.bytes]
        return pa.Table.from_batches([_record(SCORED, [{"n_docs": t.n.size, "size": t.flat.size, "cells": _zip(planes), **{x: _zip(v) for x, v in zip(_SCORED, columns)}}])])

    scored = materialize(returned.groupBy("g").applyInArrow(add_up, SCORED), "scored-texts")

    def count_cells(batches):
        n = np.zeros((2, N_CELLS), np.int64)
        for row in _rows(batches):
            held, sizes, cells = _scored(row, "held", "n")
            held = np.repeat(held, sizes)
            for k in (0, 1):
                n[k] += np.bincount(cells[held == k], minlength=N_CELLS)
        at = np.flatnonzero(n.any(0))
        yield pa.record_batch([pa.array(at), pa.array(n[0, at])], names=["cell", "n"])

    table = map_arrow(scored.select("n_docs", "size", "held", "n", "cells"), count_cells, "cell long, n long")
    table = sorted(tuple(r) for r in table.groupBy("cell").agg(F.sum("n").alias("n")).collect())
    cells, n = (np.array([r[k] for r in table], np.int64) for k in (0, 1))
    logs = np.zeros(N_CELLS)
    logs[cells] = cell_scores(cells, n)
    logs = spark.sparkContext.broadcast(logs)

    def finish(batches):
        for row in _rows(batches):
            ids, known, held, sizes, n_known, base, tail, n_bytes, cells = _scored(row, *_SCORED)
            score = np.add.reduceat(logs.value[cells], np.cumsum(sizes) - sizes) + tail
            bits = -score * np.log2(10) / np.maximum(n_bytes, 1)
            columns = [pa.array(ids, mask=~known), *(pa.array(x) for x in (held, sizes, n_known, np.full(ids.size, tokens, np.int64), base, score, bits))]
            yield pa.record_batch(columns, names=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return map_arrow(scored, finish, schema)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_documents(docs, id_remainder(F.col("doc_id")) == 1)
