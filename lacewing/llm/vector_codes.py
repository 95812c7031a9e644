"""Product codes of vectors, assigned by Exponion search over exact integers.

A vector's components become integers and are cut into equal parts, each coded by the number
of its nearest entry in its position's codebook. The search starts at the entry that the
part had in the previous round (entry 0 in the first) and scans that entry's neighbours by
ascending distance between entries, no further than twice the part's own distance to it: an
entry beyond that is strictly farther from the part, by the triangle inequality, and one at
it may tie. All comparisons are of squared integers; ties go to the lower number.

A round reads the table that the round before wrote (integers and codes), so a lost executor
costs one task's work again, and writes its own; the older table is then deleted. Each task also
writes its counts and sums by entry as one row, and only that column is read to move the
entries. Codebooks are ``parts * entries`` rows of integers, whatever the input.

Defined cases: vectors that are null or empty, hold a null, a non-finite component or one
beyond ``LIMIT / scale`` (which can't be squared in 64 bits), or don't have as many components
as the vector of the least id whose components cut into equal parts, are left out; null ids come
after all others when the first entries are chosen, and repeated ids by the vector; repeated rows
count each; with fewer vectors than entries there are as many entries as vectors; null labels
are equal to each other; an empty table gives no rows; columns named like a result are dropped,
others kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import map_arrow, materialize, release
from .integer_vectors import LIMIT, SUMS, add_up, as_integers, floor_means, integers, sums_record, usable


class Neighbours:
    """A position's entries, and of each entry the others by ascending distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = entries[:, None, :] - entries[None, :, :]
        apart = np.einsum("ijk,ijk->ij", apart, apart)
        np.fill_diagonal(apart, -1)  # an entry comes first among its own neighbours, before its equals
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each part its nearest entry and squared distance, and the distances computed."""
        k = len(self.entries)
        d = x - self.entries[start]
        d = np.einsum("ij,ij->i", d, d)
        radius, best, least, work = 4 * d, start.copy(), d.copy(), len(x)
        alive = np.arange(len(x))
        for rank in range(1, k):
            alive = alive[self.apart[start[alive], rank] <= radius[alive]]
            if not alive.size:
                break
            other = self.order[start[alive], rank]
            d = x[alive] - self.entries[other]
            d = np.einsum("ij,ij->i", d, d)
            wins = (d < least[alive]) | (d == least[alive]) & (other < best[alive])
            best[alive[wins]], least[alive[wins]] = other[wins], d[wins]
            work += alive.size
        return best, least, work


def first_codebooks(vectors: DataFrame, id_column: str, column: str, parts: int, entries: int, scale: int) -> np.ndarray:
    """(parts, entries, components of a part), from the usable vectors of the least ids."""
    fits = vectors.where(usable(column, scale) & (F.size(column) > 0) & (F.size(column) % parts == 0))
    least = lambda df: df.select(id_column, integers(column, scale).alias("v")).orderBy(F.asc_nulls_last(id_column), "v").limit(entries).collect()
    rows = least(fits)
    if rows and any(len(r["v"]) != len(rows[0]["v"]) for r in rows):
        rows = least(fits.where(F.size(column) == len(rows[0]["v"])))
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    v = np.array([r["v"] for r in rows], np.int64)
    return v.reshape(len(v), parts, -1).transpose(1, 0, 2).copy()


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    ends = np.arange(len(x) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.reshape(-1).view(np.uint8))])


def _unpacked(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _assign(x: np.ndarray, code: np.ndarray, books: list[Neighbours]) -> tuple[np.ndarray, np.ndarray]:
    """The next code of each row and its error; codes are numbers by part."""
    width = x.shape[1] // len(books)
    after, error = np.empty_like(code), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        best, d, _ = book.nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), code[:, p].astype(np.int64))
        after[:, p] = best
        error += d
    return after, error


def encode(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", parts: int = 16, entries: int = 64,
    scale: int = 256, rounds: int = 2,
) -> tuple[DataFrame, np.ndarray]:
    """Every usable vector's other columns with code string (two hex digits a part) and error
    long; and the final codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256: two hex digits a part")
    rest = [c for c in vectors.columns if c not in {column, "code", "error", "_x", "_code", "_sums"}]
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in rest)
    books = first_codebooks(vectors, id_column, column, parts, entries, scale)
    _, k, width = books.shape
    dims = parts * width

    def rows_of(batch, read):
        """Which rows are coded, their integers and the codes to start from."""
        if not read:
            at, x = as_integers(batch.column(len(rest)), dims, scale)
            return at, x, np.zeros((len(at), parts), np.uint8)
        x = _unpacked(batch.column(len(rest)), "<i4", dims).astype(np.int64)
        return np.arange(len(x)), x, _unpacked(batch.column(len(rest) + 1), np.uint8, parts)

    def kept_columns(batch, at):
        at = pa.array(at)
        return [batch.column(i).take(at) for i in range(len(rest))]

    state, now = None, vectors.select(*rest, column)
    for _ in range(rounds if k else 0):

        def step(batches, books=books, read=state is not None):
            near = [Neighbours(b) for b in books]
            sums = np.zeros((parts, k, width + 1), np.int64)
            empty = None
            for batch in batches:
                empty = batch.slice(0, 0)
                at, x, code = rows_of(batch, read)
                code, _ = _assign(x, code, near)
                for p in range(parts):
                    sums[p, :, 0] += np.bincount(code[:, p], minlength=k)
                    for j in range(width):
                        np.add.at(sums[p, :, j + 1], code[:, p], x[:, p * width + j])
                out = [*kept_columns(batch, at), _packed(x.astype("<i4")), _packed(code), pa.nulls(len(at), pa.binary())]
                yield pa.record_batch(out, names=[*rest, "_x", "_code", "_sums"])
            if empty is not None:  # the task's sums, in a row of their own
                none = [pa.nulls(1, empty.column(i).type) for i in range(len(rest))]
                yield pa.record_batch([*none, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=[*rest, "_x", "_code", "_sums"])

        def merge(batches):
            total = np.zeros((parts, k, width + 1), np.int64)
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    total += np.frombuffer(blob, np.int64).reshape(total.shape)
            yield sums_record(total)

        after = materialize(map_arrow(now, step, f"{kinds}, _x binary, _code binary, _sums binary"), "vector-codes")
        if state is not None:
            release(state)
        state = after
        sums = add_up(map_arrow(state.where("_sums IS NOT NULL").select("_sums"), merge, SUMS), (parts, k, width + 1))
        books = floor_means(sums[:, :, 1:], sums[:, :, 0], books)
        now = state.where("_sums IS NULL").select(*rest, "_x", "_code")

    def finish(batches, read=state is not None):
        near = [Neighbours(b) for b in books]
        for batch in batches if k else ():
            at, x, code = rows_of(batch, read)
            code, error = _assign(x, code, near)
            text = [c.hex() for c in map(bytes, code)]
            yield pa.record_batch([*kept_columns(batch, at), pa.array(text, pa.string()), pa.array(error)], names=[*rest, "code", "error"])

    done = map_arrow(now, finish, f"{kinds}, code string, error long")
    if state is not None:
        done = materialize(done, "vector-codes")
        release(state)
    return done, books


def with_group_sum(rows: DataFrame, column: str, value: str, name: str, most_hot: int = 1000) -> DataFrame:
    """Adds to each row the sum of ``value`` over the rows with an equal ``column``, nulls being
    equal. Values with more than a ``most_hot``-th of all rows are at most ``most_hot``, so
    their sums are broadcast and no hot value is shuffled; the rest is joined by a shuffle."""
    sums = materialize(rows.groupBy(F.col(column).alias("_g")).agg(F.sum(value).alias(name), F.count("*").alias("_n")), "group-sums")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    hot = sums.where(F.col("_n") * most_hot > total).select("_g", F.col(name), F.lit(True).alias("_hot"))
    other = sums.where(F.col("_n") * most_hot <= total).select("_g", name)
    same = F.col(column).eqNullSafe(F.col("_g"))
    dealt = rows.join(F.broadcast(hot), same, "left")
    cool = dealt.where("_hot IS NULL").drop("_g", name, "_hot").join(other, same)
    return dealt.where("_hot").drop("_g", "_hot").unionByName(cool.drop("_g"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    out = with_group_sum(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """Whole scans of every codebook, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT rid, p, (m % {entries})::INTEGER AS c, (m // {entries})::BIGINT AS d FROM (
  SELECT rid, y.p, min(list_sum(list_transform(list_zip(y.v, b.v), lambda q: (q[1] - q[2]) * (q[1] - q[2])))::HUGEINT * {entries} + c) AS m
  FROM y JOIN c{r} b ON y.p = b.p GROUP BY rid, y.p))"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (SELECT p, c, j, sum(z) AS s, count(*) AS n FROM (SELECT p, c, unnest(range(len(v))) AS j, unnest(v) AS z FROM a{r} JOIN y USING (rid, p)) GROUP BY p, c, j),
n{r} AS (SELECT p, c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{r} GROUP BY p, c),
c{r + 1} AS MATERIALIZED (SELECT c{r}.p, c{r}.c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (p, c))"""
            )
    chain = ",\n".join(steps)
    return f"""WITH good AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0
  AND len(list_filter(embedding, lambda z: z IS NOT NULL AND isfinite(z) AND abs(floor({scale} * z::DOUBLE)) <= {LIMIT})) = len(embedding)),
i AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(e, lambda z: floor({scale} * z::DOUBLE)::BIGINT) AS v FROM good),
w AS (SELECT len(v) // {parts} AS w FROM i ORDER BY vec_id NULLS LAST, v LIMIT 1),
x AS MATERIALIZED (SELECT * FROM i WHERE len(v) = (SELECT w FROM w) * {parts}),
y AS MATERIALIZED (SELECT rid, p, v[p * w + 1 : (p + 1) * w] AS v FROM (SELECT rid, v, (SELECT w FROM w) AS w, unnest(range({parts})) AS p FROM x)),
o AS (SELECT rid, (row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1)::INTEGER AS c FROM x),
c0 AS MATERIALIZED (SELECT p, c, v FROM o JOIN y USING (rid) WHERE c < {entries}),
{chain},
f AS (SELECT rid, string_agg(printf('%02x', c), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
l AS (SELECT vec_id, label, code, error FROM f JOIN x USING (rid))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(list_aggregate(list_transform(v, lambda z: z::VARCHAR), 'string_agg', ','), ',' ORDER BY p, c)) FROM c{rounds}) AS codebooks_sha256 FROM l"""


OP12_SQL = _sql()
