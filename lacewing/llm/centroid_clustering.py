"""Exact integer clustering around centroids by partial-distance search.

Components become integers, so distances, sums and centroids are exact and no result depends
on how rows are dealt. Of each vector the squared differences are added up over a few
dimensions at a time, those of the highest variance over all vectors first. The centroid that
leads after the first dimensions is finished first; every other one is left as soon as its
partial sum is strictly above the best whole distance so far, and survivors finish all
dimensions, so ties are seen and go to the smaller number.

Each round is one pass over the vectors that hands on a count and a sum for each centroid and
dimension, combined before they are shuffled; nothing is written. Rounds end early once no
centroid moves, since the rest would repeat it.

Defined cases: vectors that are null, have another number of components, or hold a null, a
non-finite component or one beyond ``LIMIT / scale`` are left out (the last can't be squared
in 64 bits); null ids come after all others when the first centroids are chosen, and repeated
ids by the vector; repeated rows count each; with fewer vectors than centroids there are as
many centroids as vectors; an empty table gives no rows; other columns are ignored but for
the id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import map_arrow
from .integer_vectors import LIMIT, SUMS, add_up, as_integers, floor_means, integers, sums_record, usable

STEP = 8  # dimensions between two looks at the partial sums


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x`` the nearest centroid and its squared distance, and how many squared
    differences were computed in all."""
    n, k, dims = len(x), len(centroids), x.shape[1]
    x, c = x[:, order], centroids[:, order]
    head = min(step, dims)
    first = np.empty((k, n), np.int64)
    for j in range(k):
        d = x[:, :head] - c[j, :head]
        first[j] = np.einsum("ij,ij->i", d, d)
    best = first.argmin(0)
    d = x[:, head:] - c[best, head:]
    least = first[best, np.arange(n)] + np.einsum("ij,ij->i", d, d)
    lead, work = best.copy(), n * (k * head + dims - head)
    for j in range(k):
        alive = np.flatnonzero((lead != j) & (first[j] <= least))
        part = first[j, alive]
        for at in range(head, dims, step):
            d = x[alive, at : at + step] - c[j, at : at + step]
            part = part + np.einsum("ij,ij->i", d, d)
            work += d.size
            stay = part <= least[alive]
            alive, part = alive[stay], part[stay]
            if not alive.size:
                break
        wins = (part < least[alive]) | (j < best[alive])
        alive, part = alive[wins], part[wins]
        best[alive], least[alive] = j, part
    return best, least, work


def first_centroids(vectors: DataFrame, id_column: str, column: str, k: int, dims: int, scale: int, salt: str) -> np.ndarray:
    """The usable vectors whose salted ids hash least, at most ``k``."""
    key = F.sha2(F.concat(F.lit(salt), F.col(id_column).cast("string")), 256)
    rows = vectors.where(usable(column, scale) & (F.size(column) == dims)).select(key.alias("key"), integers(column, scale).alias("v"))
    found = rows.orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64).reshape(-1, dims)


def high_variance_first(vectors: DataFrame, column: str, dims: int, scale: int) -> np.ndarray:
    """The dimensions by descending variance over all usable vectors. The order decides how
    early centroids are left, never which one is nearest."""

    def measure(batches):
        total = np.zeros((3, dims))
        for batch in batches:
            _, x = as_integers(batch.column(0), dims, scale)
            x = x.astype(np.float64)
            total += [np.full(dims, len(x)), x.sum(0), (x * x).sum(0)]
        yield pa.record_batch([pa.array(np.arange(3 * dims)), pa.array(total.ravel())], names=["k", "v"])

    sums = map_arrow(vectors.select(column), measure, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    n, s, q = np.array([r["v"] for r in sorted(sums)]).reshape(3, dims) if sums else np.zeros((3, dims))
    n = np.maximum(n, 1)
    return np.argsort(-(q / n - (s / n) ** 2), kind="stable")


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 8, dims: int = 64,
    scale: int = 1024, rounds: int = 10, salt: str = "3:",
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster int, distance long) of every usable vector, and the final centroids."""
    centroids = first_centroids(vectors, id_column, column, k, dims, scale, salt)
    order = high_variance_first(vectors, column, dims, scale) if len(centroids) else np.arange(dims)
    for _ in range(rounds if len(centroids) else 0):

        def gather(batches, centroids=centroids):
            sums = np.zeros((len(centroids), dims + 1), np.int64)
            for batch in batches:
                _, x = as_integers(batch.column(0), dims, scale)
                best, _, _ = nearest(x, centroids, order)
                sums[:, 0] += np.bincount(best, minlength=len(centroids))
                for j in range(len(centroids)):
                    sums[j, 1:] += x[best == j].sum(0)
            yield sums_record(sums)

        sums = add_up(map_arrow(vectors.select(column), gather, SUMS), (len(centroids), dims + 1))
        after = floor_means(sums[:, 1:], sums[:, 0], centroids)
        if np.array_equal(after, centroids):
            break
        centroids = after

    def assign(batches):
        for batch in batches:
            at, x = as_integers(batch.column(1), dims, scale)
            if at.size:
                best, least, _ = nearest(x, centroids, order)
                yield pa.record_batch([batch.column(0).take(pa.array(at)), pa.array(best, pa.int32()), pa.array(least)], names=[id_column, "cluster", "distance"])

    schema = f"`{id_column}` {vectors.schema[id_column].dataType.simpleString()}, cluster int, distance long"
    return map_arrow(vectors.select(id_column, column), assign, schema), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256: one row for each centroid is
    broadcast."""
    spark = assigned.sparkSession
    by_cluster = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(j, by_cluster.get(j, 0), sum(by_cluster.values()), digest[j]) for j in range(len(centroids))]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assigned, centroids = cluster(vectors)
    return with_inertia(assigned, centroids).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024) -> str:
    """Every round spelt out: whole distances, least by (distance, number)."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS MATERIALIZED (SELECT rid, min(d::HUGEINT * {k} + c) AS m FROM (
  SELECT rid, c, list_sum(list_transform(list_zip(x.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x CROSS JOIN c{r}) GROUP BY rid),
a{r} AS MATERIALIZED (SELECT rid, (m % {k})::INTEGER AS c, (m // {k})::BIGINT AS d FROM d{r})"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT c, j, sum(y) AS s, count(*) AS n FROM (SELECT c, unnest(range({dims})) AS j, unnest(v) AS y FROM a{r} JOIN x USING (rid)) GROUP BY c, j),
n{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c))"""
            )
    last = f"a{rounds}"
    chain = ",\n".join(steps)
    return f"""WITH k AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dims}),
good AS (SELECT vec_id, e FROM k WHERE len(list_filter(e, lambda y: y IS NOT NULL AND isfinite(y) AND abs(floor({scale} * y::DOUBLE)) <= {LIMIT})) = {dims}),
x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS v FROM good),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, v) - 1)::INTEGER AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM x) ORDER BY c LIMIT {k}),
{chain},
t AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM {last} GROUP BY c)
SELECT x.vec_id, {last}.c AS cluster, {last}.d AS distance, t.cluster_inertia, (SELECT sum(d) FROM {last})::BIGINT AS inertia,
  sha256(list_aggregate(list_transform(c{rounds}.v, lambda y: y::VARCHAR), 'string_agg', ',')) AS centroid_sha256
FROM x JOIN {last} USING (rid) JOIN t ON t.c = {last}.c JOIN c{rounds} ON c{rounds}.c = {last}.c"""


OP13_SQL = _sql()
