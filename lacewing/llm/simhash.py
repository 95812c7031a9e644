"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint's 64 bits are the majority bits of its shingles' XXH64 (seed 42). Copies share
a fingerprint, so only distinct fingerprints are joined.

Fingerprints within ``budget`` differing bits agree wholly on one of ``budget + 1`` blocks of
bits. For each block in turn the bits are rotated to bring it to the front and fingerprints
are dealt by it: each deal is a set of tries whose first levels are the block. Within a
task, pairs of trie nodes are traversed together, level by level: a pair of nodes is split
into pairs of children, the differing bit is added to the pair's error, and a pair over the
budget is dropped. A sorted array stands for the trie; nodes are ranges of it. Pairs that
remain are united in the task, which hands on at most one link for each fingerprint, never
the pairs of a group; the union of the links over all deals has the same components as all
pairs.

Defined cases: a text without words has fingerprint zero, linked like any other; null text is
empty; null ids keep their row, count as greater than any id, and a component of null ids alone has a
null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, documents, map_arrow, materialize, parts
from .components import components

ONE = np.uint64(1)


def _more(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each shingle, mixed from its first."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, or of all words if there are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    cut = text.lower().split()  # bytes: A-Z only, and ASCII white space
    if not cut:
        return np.zeros(0, np.uint64)
    joined = b" ".join(cut)
    if len(cut) <= width:
        hashes = [digest(joined, 42)]
    else:
        at = list(accumulate(map(len, cut), lambda a, n: a + n + 1, initial=0))
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(at, at[width:])]
    return np.array(hashes, np.uint64)


def majority(held: np.ndarray, n_hashes: int = 1) -> bytes:
    """``n_hashes`` times 64 majority bits of hashes, big-endian; zeros for none."""
    out = b""
    for k in range(n_hashes):
        h = (held if not k else _more(held, k)).astype(">u8")
        ones = np.zeros(64, np.int64)
        for i in range(0, h.size, 8192):
            ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * ones > h.size).tobytes()
    return out


def fingerprint(text: bytes, width: int) -> bytes:
    """64 majority bits of a text's shingles."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """The columns of ``docs`` but text and clashing names, and each text's fingerprint, as
    bytes (w) and as a signed long (f)."""
    rest = [c for c in docs.columns if c not in {"text", "f", "w"}]
    kinds = {x.name: x.dataType.simpleString() for x in docs.schema}

    def hash_texts(batches):
        for batch in parts(batches):
            found = [fingerprint(t, width) for t in as_bytes(batch.column("text"))]
            first = np.array([int.from_bytes(x, "big", signed=True) for x in found], np.int64)
            columns = [*(batch.column(c) for c in rest), pa.array(first), pa.array(found, pa.binary())]
            yield pa.record_batch(columns, names=[*rest, "f", "w"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "f long, w binary"])
    return map_arrow(docs.select(*rest, "text"), hash_texts, schema)


def unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Join the classes of u[i] and v[i]; ``parent`` is kept flat, roots are the least."""
    while u.size:
        u, v = parent[u], parent[v]
        apart = u != v
        if not apart.any():
            return
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


class _Trie:
    """The self-join of many tries in one task.

    ``keys`` [n, words] are in order within each group of ``groups`` (an array of equal
    neighbours); pairs are sought within groups, among bits from ``depth`` on. After a run
    ``parent`` holds each key's class."""

    def __init__(self, keys: np.ndarray, groups: np.ndarray, depth: int, budget: int, most: int = 1 << 17):
        self.keys, self.budget, self.most = keys, budget, most
        n, self.bits = keys.shape[0], 64 * keys.shape[1]
        self.parent = np.arange(n)
        self.ones: dict[int, np.ndarray] = {}
        if n < 2:
            return
        lo = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        hi = np.append(lo[1:], n)
        grown = hi - lo > 1
        lo, hi = lo[grown], hi[grown]
        stack = [(depth, lo, hi, lo, hi, np.zeros(lo.size, np.int16))]
        while stack:
            depth, *pairs = stack.pop()
            if pairs[0].size > most:
                half = pairs[0].size // 2
                stack += [(depth, *(x[half:] for x in pairs)), (depth, *(x[:half] for x in pairs))]
            elif pairs[0].size:
                stack.append((depth + 1, *self.step(depth, *self.open_pairs(*pairs))))

    def open_pairs(self, a, b, c, d, err):
        """Without the node pairs whose leaves are all in one class already."""
        changes = np.cumsum(np.concatenate([[0], self.parent[1:] != self.parent[:-1]]))
        one = (changes[b - 1] == changes[a]) & (changes[d - 1] == changes[c]) & (self.parent[a] == self.parent[c])
        return [x[~one] for x in (a, b, c, d, err)]

    def step(self, depth, a, b, c, d, err):
        """Children pairs of the node pairs [a,b) x [c,d); small pairs are settled here."""
        small = (b - a) * (d - c) <= 16
        if depth == self.bits:
            small[:] = True
        if small.any():
            self.settle(a[small], b[small], c[small], d[small])
            big = ~small
            a, b, c, d, err = a[big], b[big], c[big], d[big], err[big]
        if not a.size:
            return a, b, c, d, err
        if depth not in self.ones:
            self.ones.pop(depth - 64, None)
            bit = (self.keys[:, depth // 64] >> np.uint64(63 - depth % 64)) & ONE
            self.ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        ones = self.ones[depth]
        m, n = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same, room = a == c, err < self.budget
        every = np.ones(a.size, bool)
        parts = [(a, m, c, n, err, every), (m, b, n, d, err, every), (a, m, n, d, err + 1, room), (m, b, c, n, err + 1, room & ~same)]
        out = []
        for *x, held in parts:
            held = held & (x[1] > x[0]) & (x[3] > x[2]) & ~((x[0] == x[2]) & (x[1] - x[0] < 2))
            out.append([y[held] for y in x])
        return [np.concatenate(x) for x in zip(*out)]

    def settle(self, a, b, c, d):
        """Compare all leaves of small node pairs."""
        n = (b - a) * (d - c)
        for i in range(0, n.size, self.most // 16):
            s = slice(i, i + self.most // 16)
            size, row = n[s], np.repeat(np.arange(n[s].size), n[s])
            k = np.arange(row.size) - np.repeat(np.cumsum(size) - size, size)
            across = (d - c)[s][row]
            u, v = a[s][row] + k // across, c[s][row] + k % across
            differ = np.zeros(u.size, np.int16)
            for word in range(self.keys.shape[1]):
                differ += np.bitwise_count(self.keys[u, word] ^ self.keys[v, word])
            near = differ <= self.budget
            unite(self.parent, u[near], v[near])


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks that cover the 64 bits."""
    edges = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotate(keys: np.ndarray, by: int) -> np.ndarray:
    return keys if not by else (keys << np.uint64(by)) | (keys >> np.uint64(64 - by))


def fingerprint_links(distinct: DataFrame, budget: int = 4) -> DataFrame:
    """Links (src, dst) between fingerprints ``f`` whose components are those of all pairs
    within ``budget`` bits."""
    blocks = _blocks(budget)

    def join(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        f = table.column("f").to_numpy().view(np.uint64)
        turn = table.column("turn").to_numpy()
        for k, (start, bits) in enumerate(blocks):
            keys = np.unique(_rotate(f[turn == k], start))
            parent = _Trie(keys[:, None], keys >> np.uint64(64 - bits), bits, budget).parent
            linked = np.flatnonzero(parent != np.arange(keys.size))
            back = _rotate(keys, (64 - start) % 64).view(np.int64)
            if linked.size:
                yield pa.record_batch([pa.array(back[linked]), pa.array(back[parent[linked]])], names=["src", "dst"])

    def block(k: int):
        start, bits = blocks[k]
        return F.shiftrightunsigned(F.shiftleft("f", start), 64 - bits)

    turns = F.array(*(F.struct(F.lit(k).alias("turn"), block(k).alias("head")) for k in range(len(blocks))))
    dealt = distinct.select("f", F.explode(turns).alias("t")).select("f", "t.turn", "t.head")
    return map_arrow(dealt.repartition("turn", "head").select("f", "turn"), join, "src long, dst long")


#: Most rows of a few longs each that are broadcast, so that texts needn't be shuffled.
SMALL_ROWS = 1_000_000

#: Bands of least hashes, and hashes in a band. Sets at a similarity of 0.8 agree on no band
#: with a chance of (1 - 0.8**4)**32, or 5e-8.
BANDS, IN_BAND = 32, 4


def bands(held: np.ndarray, seed: int = 3) -> np.ndarray:
    """A long for each band: a hash of the set's IN_BAND least elements under as many orders."""
    odd = np.random.default_rng(seed).integers(0, 1 << 63, (2, BANDS * IN_BAND), dtype=np.uint64) * np.uint64(2) + ONE
    least = np.full(BANDS * IN_BAND, np.uint64((1 << 64) - 1))
    for i in range(0, held.size, 512):
        np.minimum(least, (held[i : i + 512, None] * odd[0]).min(0), out=least)
    return _more((_more(least, 1) * odd[1]).reshape(BANDS, IN_BAND).sum(1, dtype=np.uint64), 2).view(np.int64)


def shingle_sets(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    """doc_id and near_text, and of each text's set of shingles: its hash (node), size (n),
    fingerprint (w) and ``bands``."""

    def describe(batches):
        import xxhash

        for batch in parts(batches):
            sets = [np.unique(shingle_hashes(t, width)) for t in as_bytes(batch.column("text"))]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            flat = np.concatenate([np.zeros(0, np.int64), *(bands(x) for x in sets)])
            columns = [
                batch.column("doc_id"), batch.column("near_text"), pa.array(node), pa.array([x.size for x in sets], pa.int64()),
                pa.array([majority(x, n_hashes) for x in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(flat)),
            ]
            yield pa.record_batch(columns, names=["doc_id", "near_text", "node", "n", "w", "bands"])

    schema = "doc_id long, near_text long, node long, n long, w binary, bands array<long>"
    return map_arrow(docs.select("doc_id", "near_text", "text"), describe, schema)


def wide_budget(similarity: float, bits: int) -> int:
    """Differing bits that sets of at least this Jaccard similarity stay within: five standard
    deviations above the mean of the worst case, which is large sets of equal size or, as
    majorities of few shingles are rough, four shingles against five."""
    p = max(math.acos(2 * similarity / (1 + similarity)) / math.pi, 3 / 16)
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def wide_links(distinct: DataFrame, budget: int, n_hashes: int, most: int = 1 << 17) -> DataFrame:
    """Links (src, dst) between nodes (node long, w binary, bands array<long>) that agree on
    a band and differ in at most ``budget`` bits: candidates, at most one for each node and
    trie. All nodes that such pairs lead to within a trie have links to one ``dst``.

    A trie is a band's bucket. One of more than ``most`` nodes is cut into chunks, of which
    each meets each in a trie of its own."""

    def join(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        node, deal = table.column("node").to_numpy(), table.column("deal").to_numpy()
        keys = np.frombuffer(b"".join(table.column("w").to_pylist()), ">u8").reshape(node.size, -1).astype(np.uint64)
        order = np.lexsort((*(keys[:, k] for k in reversed(range(n_hashes))), deal))
        node, deal, keys = node[order], deal[order], keys[order]
        parent = _Trie(keys, deal, 0, budget).parent
        linked = np.flatnonzero(parent != np.arange(node.size))
        if linked.size:
            yield pa.record_batch([pa.array(node[linked]), pa.array(node[parent[linked]])], names=["src", "dst"])

    held = distinct.select("node", "w", F.posexplode("bands").alias("turn", "head"))
    chunks = F.ceil(F.count("*") / most).cast("int").alias("chunks")
    large = materialize(held.groupBy("turn", "head").agg(chunks).where("chunks > 1"), "large-buckets")
    deal = [F.col("turn"), F.col("head")]
    if n_large := large.count():
        held = held.join(F.broadcast(large) if n_large <= SMALL_ROWS else large, ["turn", "head"], "left")
        n = F.coalesce("chunks", F.lit(1))
        held = held.withColumn("own", F.pmod(F.xxhash64(F.lit(7), "node"), n).cast("int"))
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        deal += [F.least("own", "other"), F.greatest("own", "other")]
    # Should two deals have one hash, they are one trie: more candidates, none less.
    dealt = held.select("node", "w", F.xxhash64(*deal).alias("deal"))
    return map_arrow(dealt.repartition("deal"), join, "src long, dst long")


def similar(sets: list[np.ndarray], similarity: float, known: np.ndarray | None = None, most: int = 1 << 22) -> np.ndarray:
    """The class of each set (arrays of distinct hashes): those of all pairs whose exact
    Jaccard similarity is ``similarity`` or more, and of sets that are ``known`` to be of one."""
    parent = np.arange(len(sets))
    if known is not None and known.size:
        _, first, of = np.unique(known, return_index=True, return_inverse=True)
        parent = first[of]
    # Any pair of two classes has one outside the most frequent.
    rest = np.flatnonzero(parent != np.bincount(parent).argmax()) if len(sets) else parent
    sizes = np.array([x.size for x in sets], np.int64)
    tokens, code = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(code, kind="stable")]
    n_of = np.bincount(code, minlength=tokens.size)
    first = np.cumsum(n_of) - n_of
    edges = np.concatenate([[0], np.cumsum(sizes)])
    for i in rest.tolist():
        if not parent.any():
            break
        own = code[edges[i] : edges[i + 1]]
        own = own[n_of[own] > 1]
        shared = np.zeros(len(sets), np.int64)
        block = np.cumsum(n_of[own]) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), own.size]
        for a, b in zip(cuts, cuts[1:]):
            n = n_of[own[a:b]]
            at = np.repeat(first[own[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shared += np.bincount(holder[at], minlength=len(sets))
        # Whole numbers against a product of floats: room for rounding at the limit.
        near = np.flatnonzero((shared > 0) & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-6))
        unite(parent, near, np.full(near.size, i))
    return parent


def _compared(members: DataFrame, width: int, similarity: float, *by: str) -> DataFrame:
    """Links (src, dst) within each group of ``members`` (node, class, text) by the sets of shingles
    themselves; nodes of one class are linked already."""

    def compare(table: pa.Table) -> pa.Table:
        node, at = np.unique(table.column("node").to_numpy(), return_index=True)
        texts = as_bytes(table.column("text").combine_chunks().take(pa.array(at)))
        known = table.column("class").to_numpy()[at]
        parent = similar([np.unique(shingle_hashes(t, width)) for t in texts], similarity, known)
        linked = np.flatnonzero(parent != np.arange(node.size))
        return pa.table({"src": pa.array(node[linked]), "dst": pa.array(node[parent[linked]])})

    return members.groupBy(*by).applyInArrow(compare, "src long, dst long")


def verified_links(candidates: DataFrame, sizes: DataFrame, with_text, width: int, similarity: float, most: int = 1 << 17) -> DataFrame:
    """Links (src, dst) with the components of all pairs of a group whose sets of shingles
    have this Jaccard similarity or more, by the sets themselves.

    A group is a ``dst`` of the ``candidates`` and all that have links to it. ``sizes`` has node
    and n (shingles); ``with_text`` adds the column text to rows with a node. A group of
    more than ``most`` shingles is cut into pieces that each get the ``dst`` too, so that copies of
    one text are of one class after a single comparison. Only pieces of groups in which several
    classes remain meet each other, and never two pieces of one class."""
    pair = candidates.select(F.col("dst").alias("root"), F.col("src").alias("node")).distinct()
    held = pair.union(pair.select("root", F.col("root").alias("node")).distinct()).join(sizes, "node")
    held = materialize(held.select("root", "node", "n"), "candidate-groups")
    pieces = F.greatest(F.ceil(F.sum("n") / most).cast("int"), F.lit(1))
    totals = materialize(held.groupBy("root").agg(pieces.alias("pieces")), "candidate-totals")
    own = F.pmod(F.xxhash64(F.lit(5), "node"), "pieces").cast("int")
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    star = held.where("node <> root").join(totals, "root").select("root", own.alias("piece"), "node")
    star = star.union(totals.select("root", F.explode(every).alias("piece"), F.col("root").alias("node")))
    star = with_text(star.withColumn("class", F.col("node")))
    links = materialize(_compared(star, width, similarity, "root", "piece"), "verified-links")
    if totals.where("pieces > 1").isEmpty():
        return links
    known = components(links).withColumnRenamed("component", "class")
    held = held.join(totals.where("pieces > 1").select("root"), "root").join(known, "node", "left")
    held = materialize(held.withColumn("class", F.coalesce("class", "node")), "candidate-classes")
    size = held.groupBy("root", "class").agg(F.sum("n").alias("n"))
    large = F.col("n") > most
    apart = size.groupBy("root").agg(F.count("*").alias("classes"), F.sum(F.when(~large, F.col("n"))).alias("few")).where("classes > 1")
    # A large class has pieces of its own, the others share some.
    pieces = F.when(large, F.ceil(F.col("n") / most)).otherwise(F.greatest(F.ceil(F.col("few") / most), F.lit(1))).cast("int")
    size = materialize(size.join(apart, "root").select("root", "class", large.alias("large"), pieces.alias("pieces")), "class-pieces")

    def piece(k):
        return F.struct("large", F.when(F.col("large"), F.col("class")).otherwise(0).alias("class"), k.alias("k"))

    shared = F.pmod(F.xxhash64(F.lit(5), "class"), "pieces").cast("int")
    listed = F.when(F.col("large"), every).otherwise(F.array(shared))
    listed = size.select("root", "class", "large", F.explode(listed).alias("k")).select("root", piece(F.col("k")).alias("low")).distinct()
    pairs = listed.join(listed.withColumnRenamed("low", "high"), "root").where("low <= high")
    pairs = pairs.where("NOT (low.large AND high.large AND low.class = high.class)")
    dealt = pairs.select("root", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("piece"))
    placed = held.join(size, ["root", "class"]).select("root", "node", "class", piece(F.when(F.col("large"), own).otherwise(shared)).alias("piece"))
    met = materialize(placed.join(dealt, ["root", "piece"]).select("root", "low", "high", "node", "class"), "pieces-that-meet")
    return links.union(_compared(with_text(met), width, similarity, "root", "low", "high"))


def _classes(hashed: DataFrame, key: str, least, links) -> DataFrame:
    """(key, component_id) from rows with a fingerprint's ``key`` (long)."""
    grouped = materialize(hashed.groupBy(key).agg(F.min(least).alias("least"), F.min("w").alias("w")), "distinct-fingerprints")
    roots = components(links(grouped)).withColumnRenamed("node", key)
    rooted = grouped.join(roots, key, "left").select(key, "least", F.coalesce("component", key).alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select(key, "component_id")


def near_duplicates(docs: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, f (fingerprint as a signed long) and component_id, the least doc_id reachable
    by links of at most ``budget`` differing bits, for every document."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = materialize(fingerprints(chosen, width), "fingerprints")
    classes = _classes(hashed, "f", "doc_id", lambda d: fingerprint_links(d, budget))
    return hashed.join(classes, "f").select("doc_id", "f", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, n_hashes: int = 5) -> DataFrame:
    """``docs`` with one row of each group: the least id, then the least text.

    Rows are linked if their sets of ``width``-word shingles have a Jaccard similarity of
    ``similarity`` or more. Candidates agree on a band of least hashes and have near
    fingerprints of ``n_hashes`` times 64 bits, and all pairs of candidates of different classes are
    compared by the sets. Texts without words are linked to each other. Columns named
    ``near_*`` are not kept. Keys are broadcast up to ``SMALL_ROWS``; beyond it the texts are
    shuffled to them."""
    columns = docs.columns
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash.alias("near_text"), "text")
    hashed = materialize(shingle_sets(chosen, width, n_hashes), "shingle-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "near_text")).alias("least")
    # All but the ids are the same for a node.
    grouped = materialize(hashed.groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("n", "w", "bands"))), "distinct-sets")
    budget = wide_budget(similarity, 64 * n_hashes)
    candidates = materialize(wide_links(grouped, budget, n_hashes), "candidates")
    keys = grouped.select("node", F.col("least.doc_id").alias("near_id"), F.col("least.near_text").alias("near_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("near_text") == F.col("near_hash"))

    def with_text(rows):
        named = materialize(rows.join(keys, "node"), "candidates-named")
        found = chosen.join(F.broadcast(named) if named.count() <= SMALL_ROWS else named.hint("merge"), same)
        return found.select(*rows.columns, "text")

    roots = components(verified_links(candidates, grouped.select("node", "n"), with_text, width, similarity))
    roots = roots.withColumnRenamed("node", "near_node")
    rooted = grouped.select("node", "least").join(roots, F.col("node") == F.col("near_node"), "left")
    first = rooted.groupBy(F.coalesce("component", "node")).agg(F.min("least").alias("least"))
    first = first.select(F.col("least.doc_id").alias("near_id"), F.col("least.near_text").alias("near_hash"))
    first = materialize(first, "kept-keys")
    same = F.col("doc_id").eqNullSafe(F.col("near_id")) & (F.col("near_text") == F.col("near_hash"))
    lost = materialize(hashed.select("doc_id", "near_text").distinct().join(first, same, "left_anti"), "lost-keys")
    lost = lost.toDF("near_id", "near_hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("near_id")) & (text_hash == F.col("near_hash"))
    # Without the keys that go if these are few, else with those that stay.
    kept = docs.join(F.broadcast(lost), same, "left_anti") if lost.count() <= SMALL_ROWS else docs.join(first, same, "left_semi")
    # Rows that repeat an id and its text wholly are one document.
    return kept.select(*columns).dropDuplicates(["doc_id", "text"]) if _repeats(hashed) else kept.select(*columns)


def _repeats(hashed: DataFrame) -> bool:
    """Whether any id comes with the same text twice."""
    return not hashed.groupBy("doc_id", "near_text").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), width=4, budget=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
