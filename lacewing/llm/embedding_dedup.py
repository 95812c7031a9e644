"""Embedding near-duplicates: cross-polytope hashing with multiprobe buckets.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash
is the signed axis nearest to the result. ``hashes`` of these make a table's bucket code,
and each of ``tables`` tables also probes the next-nearest codes. Two vectors meet in a table
if one's bucket is the other's bucket or one of its probes. Pairs that meet are verified by
their cosine in double precision, in blocks, by a matrix product.

Exact copies are one vector with a weight. A pair is counted in the first table in which it
meets and in one bucket of that, so links are counted without being written out: a block
hands on a weighted count for each vector and a spanning set of links. Buckets in which
nothing can meet go before vectors are attached; large buckets are split into chunks, and
each pair of chunks is a block of its own, so no bucket is capped.

The number of hashes follows the number of vectors, the number of tables the number of
hashes; see :func:`plan`. Vectors of different lengths never meet.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; repeated ids are rows each; a null id is greater than any; an empty table gives
no rows; other columns are ignored. Distinct vectors are told apart by a 64-bit hash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import map_arrow, materialize, partitions
from .components import components
from .simhash import unite

#: The nearest axes of two hashes that a probe replaces: one hash's 2nd or 3rd nearest.
RANKS = (1, 2)


def plan(n: int, dim: int) -> tuple[int, int]:
    """(hashes, tables): more buckets than vectors; tables for a chance of a few in ten
    thousand to miss a pair at cosine 0.95, of which a table finds about 0.8**hashes."""
    axes = 2 * _width(dim)
    hashes = max(1, math.ceil(math.log(4 * max(n, 1)) / math.log(axes)))
    return hashes, max(4, math.ceil(math.log(2e-4) / math.log(1 - 0.8**hashes)))


def _width(dim: int) -> int:
    return 1 << max(2, (dim - 1).bit_length())


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(x.shape[0], n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(x.shape[0], n)
        h *= 2
    return x


def codes(x: np.ndarray, hashes: int, tables: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Bucket codes [n, tables] and probe codes [n, tables, probes] of unit vectors."""
    n, dim = x.shape
    width = _width(dim)
    signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, hashes, 3, width))
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    mult = np.random.default_rng([seed, 1]).integers(1, 2**63, (tables, hashes), dtype=np.uint64) | np.uint64(1)
    base = np.zeros((n, tables), np.int32)
    probes = np.zeros((n, tables, hashes * len(RANKS)), np.int32)
    fold = lambda v: (v >> np.uint64(33)).astype(np.int32)
    for t in range(tables):
        best = []
        for k in range(hashes):
            y = padded
            for s in signs[t, k]:
                y = _hadamard(y * s)
            near = np.argpartition(-np.abs(y), max(RANKS), axis=1)[:, : max(RANKS) + 1]
            order = np.argsort(-np.abs(np.take_along_axis(y, near, 1)), axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            axis = 2 * near + (np.take_along_axis(y, near, 1) < 0)
            best.append((axis.astype(np.uint64) + np.uint64(1 + dim)) * mult[t, k])
        total = sum(b[:, 0] for b in best)
        base[:, t] = fold(total)
        probes[:, t] = np.stack([fold(total - b[:, 0] + b[:, r]) for b in best for r in RANKS], 1)
    return base, probes


def _unit(flat: bytes, n: int, kind: str) -> np.ndarray:
    x = np.frombuffer(flat, kind).reshape(n, -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_meeting(bx, px, by, py, x_first, t: int, code: int) -> np.ndarray:
    """Whether table ``t`` and bucket ``code`` are where each pair is counted."""
    same = bx == by
    xy = (px == by[:, :, None]).any(2)
    yx = (py == bx[:, :, None]).any(2)
    here = np.argmax(same | xy | yx, axis=1) == t
    to_y = np.where(x_first, xy[:, t], ~yx[:, t])
    return here & (np.where(same[:, t] | ~to_y, bx[:, t], by[:, t]) == code)


class _Block:
    """The rows of two chunks of a bucket."""

    def __init__(self, table: pa.Table, kind: str, tables: int, n_probes: int):
        self.r = table.column("r").to_numpy()
        self.m = table.column("m").to_numpy()
        self.base_row = table.column("kind").to_numpy() == 0
        self.chunk = table.column("chunk").to_numpy()
        raw = lambda c: b"".join(table.column(c).to_pylist())
        self.x = _unit(raw("x"), self.r.size, kind)
        self.base = np.frombuffer(raw("base"), np.int32).reshape(-1, tables)
        self.probes = np.frombuffer(raw("probes"), np.int32).reshape(-1, tables, n_probes)

    def links(self, t: int, code: int, i: int, j: int, least: float, strip: int = 512, most: int = 100_000):
        left, right = (np.flatnonzero(self.chunk == c) for c in (i, j))
        count, parent = np.zeros(self.r.size), np.arange(self.r.size)
        for at in range(0, left.size, strip):
            rows = left[at : at + strip]
            u, v = np.nonzero(self.x[rows] @ self.x[right].T >= least)
            u, v = rows[u], right[v]
            ok = (self.base_row[u] | self.base_row[v]) & (self.r[u] != self.r[v])
            if i == j:
                ok &= u < v
            u, v = u[ok], v[ok]
            for k in range(0, u.size, most):
                a, b = u[k : k + most], v[k : k + most]
                x_first = self.r[a] < self.r[b]
                ok = first_meeting(self.base[a], self.probes[a], self.base[b], self.probes[b], x_first, t, code)
                a, b = a[ok], b[ok]
                count += np.bincount(a, self.m[b], self.r.size) + np.bincount(b, self.m[a], self.r.size)
                unite(parent, a, b)
        linked, hung = np.flatnonzero(count), np.flatnonzero(parent != np.arange(self.r.size))
        kinds = np.repeat(np.array([0, 1], np.int32), [linked.size, hung.size])
        return kinds, np.concatenate([self.r[linked], self.r[hung]]), np.concatenate([count[linked].astype(np.int64), self.r[parent[hung]]])


def near_vectors(vectors: DataFrame, least: float = 0.95, chunk_rows: int = 4096, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id long,
    embedding array of float or double)."""
    spark = vectors.sparkSession
    single = isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>"))

    def flatten(batches):
        for batch in batches:
            out = []
            for v in batch.column("embedding"):
                x = None
                if v.is_valid and v.values is not None and len(v.values) and not v.values.null_count:
                    a = v.values.to_numpy().astype(kind)
                    if np.isfinite(a).all() and a.any():
                        x = a.tobytes()
                out.append(x)
            yield pa.record_batch([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "x"])

    flat = map_arrow(chosen, flatten, "vec_id long, x binary").withColumn("r", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    flat = materialize(flat, "vectors")
    distinct = flat.where("x IS NOT NULL").groupBy("r").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"), F.min("x").alias("x"))
    seen = distinct.agg(F.count("*").alias("n"), F.max(F.length("x")).alias("bytes")).first()
    dim = (seen["bytes"] or 0) // np.dtype(kind).itemsize
    hashes, tables = plan(seen["n"], dim)
    n_probes = hashes * len(RANKS)

    def hash_vectors(batches):
        for batch in batches:
            x = batch.column("x").to_pylist()
            base, probes = [b""] * len(x), [b""] * len(x)
            sizes = np.array([len(v) for v in x])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                b, p = codes(_unit(b"".join(x[i] for i in rows), rows.size, kind), hashes, tables, seed)
                for k, i in enumerate(rows):
                    base[i], probes[i] = b[k].tobytes(), p[k].tobytes()
            new = [pa.array(base, pa.binary()), pa.array(probes, pa.binary())]
            yield pa.record_batch([*(batch.column(c) for c in ("r", "m", "least", "x")), *new], names=["r", "m", "least", "x", "base", "probes"])

    hashed = map_arrow(distinct, hash_vectors, "r long, m long, least long, x binary, base binary, probes binary")
    hashed = materialize(hashed, "hashed-vectors")

    def spread(batches):
        """A row for each bucket that a vector lies in (kind 0) or probes (1)."""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            base = np.frombuffer(b"".join(batch.column("base").to_pylist()), np.int32).reshape(n, tables, 1)
            probes = np.frombuffer(b"".join(batch.column("probes").to_pylist()), np.int32).reshape(n, tables, n_probes)
            both = np.concatenate([base, probes], 2)
            fresh = np.ones(both.shape, bool)
            for k in range(1, both.shape[2]):
                fresh[:, :, k] = (both[:, :, :k] != both[:, :, k : k + 1]).all(2)
            row, t, k = np.nonzero(fresh)
            columns = [batch.column("r").to_numpy()[row], t.astype(np.int32), both[row, t, k], (k > 0).astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in columns], names=["r", "t", "code", "kind"])

    rows = map_arrow(hashed.select("r", "base", "probes"), spread, "r long, t int, code int, kind int")
    buckets = rows.groupBy("t", "code").agg(F.count("*").alias("n"), F.min("kind").alias("k"))
    buckets = buckets.where("n > 1 AND k = 0").withColumn("chunks", F.ceil(F.col("n") / chunk_rows).cast("int"))
    met = rows.join(buckets.select("t", "code", "chunks"), ["t", "code"])
    met = met.withColumn("chunk", F.pmod(F.xxhash64("r", F.lit(1)), F.col("chunks")).cast("int"))
    pair = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j"))
    )
    blocks = met.withColumn("pair", F.explode(pair)).select("r", "t", "code", "kind", "chunk", "pair.i", "pair.j")
    full = blocks.join(hashed.select("r", "m", "x", "base", "probes"), "r")
    key = ["t", "code", "i", "j"]

    def verify(batches):
        held, now = [], None

        def done():
            table = pa.Table.from_batches(held)
            if table.num_rows > 1:
                kinds, a, b = _Block(table, kind, tables, n_probes).links(*now, least)
                if kinds.size:
                    yield pa.record_batch([pa.array(kinds), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in key]
            change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                this = tuple(int(c[s]) for c in columns)
                if this != now and held:
                    yield from done()
                    held = []
                now = this
                held.append(batch.slice(s, e - s))
        if held:
            yield from done()

    ordered = full.repartition(partitions(spark), *key).sortWithinPartitions(*key)
    found = materialize(map_arrow(ordered, verify, "kind int, a long, b long"), "vector-links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("r")).agg(F.sum("b").alias("others"))
    roots = components(found.where("kind = 1").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    nodes = hashed.select("r", "m", "least").join(roots.withColumnRenamed("node", "r"), "r", "left").withColumn("root", F.coalesce("component", "r"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    known = nodes.join(named, "root").join(counts, "r", "left")
    known = known.select("r", "component_id", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    out = flat.select("vec_id", "r").join(known, "r", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("r").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Every pair's cosine, and the least id handed along links until nothing changes.
OP5_SQL = r"""
WITH RECURSIVE read AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, embedding::DOUBLE[] AS x FROM embeddings
), sound AS MATERIALIZED (
  SELECT row_id, vec_id, x FROM read
  WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.row_id AS a, b.row_id AS b FROM sound a JOIN sound b ON a.row_id <> b.row_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.95
), reached(a, b) AS (
  SELECT row_id, row_id FROM sound
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
), classes AS (
  SELECT r.a AS row_id, min(s.vec_id) AS component_id FROM reached r JOIN sound s ON s.row_id = r.b GROUP BY r.a
), counts AS (
  SELECT a AS row_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM read LEFT JOIN classes USING (row_id) LEFT JOIN counts USING (row_id)
"""
