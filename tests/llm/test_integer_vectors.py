import hashlib
import math

import numpy as np
import pytest

from lacewing.llm import centroid_clustering as c
from lacewing.llm import integer_vectors as iv
from lacewing.llm import vector_codes as v
from lacewing.llm._shared import release_since, written


def whole(vector, scale, dims):
    """Plain Python integers of a vector, None if it isn't used."""
    if vector is None or len(vector) != dims or any(x is None or not math.isfinite(x) for x in vector):
        return None
    out = [math.floor(scale * np.float64(np.float32(x))) for x in vector]
    return out if all(abs(x) <= iv.LIMIT for x in out) else None


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def least(point, entries):
    return min((distance(point, e), i) for i, e in enumerate(entries))


def moved(entries, groups):
    return [[sum(x) // len(g) for x in zip(*g)] if g else e for e, g in zip(entries, groups)]


def brute_cluster(rows, k, dims, scale, rounds):
    kept = [(i, whole(x, scale, dims)) for i, x in rows]
    kept = [(i, x) for i, x in kept if x is not None]
    hashed = sorted((i is None, "" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept)
    entries = [x for *_, x in hashed[:k]]
    for _ in range(rounds):
        groups = [[] for _ in entries]
        for _, x in kept:
            groups[least(x, entries)[1]].append(x)
        entries = moved(entries, groups)
    return [(i, least(x, entries)[1], least(x, entries)[0]) for i, x in kept], entries


def brute_codes(rows, parts, entries, scale, rounds, dims):
    kept = [(i, label, x) for i, label, x in ((i, label, whole(x, scale, dims)) for i, label, x in rows) if x is not None]
    width = dims // parts
    part = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(((i is None, i or 0, x) for i, _, x in kept))[:entries]
    books = [[part(x, p) for *_, x in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for *_, x in kept:
                groups[least(part(x, p), books[p])[1]].append(part(x, p))
            books[p] = moved(books[p], groups)
    out = []
    for i, label, x in kept:
        best = [least(part(x, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, books


@pytest.fixture(scope="module")
def rows():
    """Clusters, copies, ties (few distinct whole numbers), odd vectors, null and repeated ids."""
    rng = np.random.default_rng(4)
    found = []
    centres = rng.normal(size=(6, 32))
    for k in range(150):
        found.append(np.float32(centres[k % 6] + rng.normal(size=32) * 0.3).tolist())
    found += [np.float32(rng.integers(-1, 2, 32)).tolist() for _ in range(60)]
    found += [found[0]] * 40 + [[0.0] * 32] * 5
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0] * 31, [nan] + [0.0] * 31, [inf] * 32, [None] + [0.0] * 31, [1e30] * 32, [1.0] * 64]
    ids = [(k * 7) % 251 + 1 for k in range(len(found))]
    ids[3] = ids[170] = None
    labels = [None if k % 5 == 0 else "hot" if k % 5 < 4 else f"l{k}" for k in range(len(found))]
    return list(zip(ids, labels, found)) + [(1000 + k, "odd", x) for k, x in enumerate(odd)]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label string, embedding array<float>, cluster int, code string").repartition(6)


@pytest.mark.parametrize("k,scale,rounds", [(8, 1024, 10), (3, 1, 2), (400, 2, 3), (1, 16, 1), (5, 64, 0)])
def test_clusters_against_brute_force(vectors, rows, rows_of, in_order, k, scale, rounds):
    want, entries = brute_cluster([(i, x) for i, _, x in rows], k, 32, scale, rounds)
    got, centroids = c.cluster(vectors, k=k, dims=32, scale=scale, rounds=rounds)
    assert centroids.tolist() == entries
    assert rows_of(got, "vec_id", "cluster", "distance") == in_order(want)
    total = c.with_inertia(got, centroids).collect()
    assert {r["inertia"] for r in total} == {sum(d for *_, d in want)}
    for r in total:
        assert r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, entries[r["cluster"]])).encode()).hexdigest()


def test_partial_distances_leave_centroids_early_and_miss_no_tie():
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (500, 64)) * rng.integers(0, 2, (500, 64))
    centroids = np.concatenate([x[:7], x[:1], x[3:4] + 1])
    order = np.argsort(-x.var(0))
    best, d, work = c.nearest(x, centroids, order)
    full = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (best == full.argmin(1)).all() and (d == full.min(1)).all()
    apart = np.concatenate([x, x + 1000 * (1 + np.arange(500) % 8)[:, None]])
    *_, work = c.nearest(apart, apart[500:508], order)
    assert work < 0.4 * len(apart) * 8 * 64


def test_the_order_of_dimensions_is_by_variance(spark):
    df = spark.createDataFrame([([float(k % 2), 5.0, float(k)],) for k in range(20)] + [([math.nan] * 3,)], "embedding array<double>")
    assert c.high_variance_first(df, "embedding", 3, 16).tolist() == [2, 0, 1]


@pytest.mark.parametrize("parts,entries,scale,rounds", [(16, 64, 256, 2), (4, 5, 1, 3), (1, 256, 2, 1), (32, 3, 8, 0), (2, 40, 2, 4)])
def test_codes_against_brute_force(spark, vectors, rows, rows_of, in_order, parts, entries, scale, rounds):
    want, books = brute_codes(rows, parts, entries, scale, rounds, 32)
    mark = written()
    got, found = v.encode(vectors, parts=parts, entries=entries, scale=scale, rounds=rounds)
    assert found.tolist() == books
    assert rows_of(got, "vec_id", "label", "code", "error") == in_order(want)
    assert "cluster" in got.columns and "embedding" not in got.columns
    assert written() - mark == (rounds > 0)  # the tables of the rounds are gone
    release_since(spark, mark)


def test_exponion_search_skips_far_entries_and_misses_no_tie():
    rng = np.random.default_rng(6)
    entries = np.concatenate([rng.integers(-50, 50, (60, 4)), rng.integers(-2, 3, (4, 4))])
    entries[10] = entries[20]
    x = np.concatenate([entries[rng.integers(0, 64, 2000)] + rng.integers(-3, 4, (2000, 4)), (entries[:40] + entries[1:41]) // 2])
    book = v.Neighbours(entries)
    full = ((x[:, None] - entries[None]) ** 2).sum(2)
    best, d, work = book.nearest(x, full.argmin(1))
    assert (best == full.argmin(1)).all() and (d == full.min(1)).all()
    assert work < 0.2 * len(x) * 64
    for start in (np.zeros(len(x), np.int64), rng.integers(0, 64, len(x))):
        best, d, _ = book.nearest(x, start)
        assert (best == full.argmin(1)).all() and (d == full.min(1)).all()


def test_largest_components_stay_exact():
    x = np.array([[iv.LIMIT] * 16, [-iv.LIMIT] * 16], np.int64)
    book = v.Neighbours(np.concatenate([np.repeat(-x[:1], 255, 0), x[:1]]))
    best, d, _ = book.nearest(x, np.array([0, 0]))
    assert best.tolist() == [255, 0] and d.tolist() == [0, 0]
    best, d, _ = c.nearest(np.repeat(x, 4, 1), np.repeat(x[1:], 4, 1), np.arange(64))
    assert d.tolist() == [64 * (2 * iv.LIMIT) ** 2, 0]


def test_sums_of_equal_labels(spark, rows_of, in_order):
    data = [(k, None if k % 3 == 0 else "hot" if k % 3 == 1 else f"r{k // 2}", k) for k in range(600)]
    df = spark.createDataFrame(data, "i int, label string, e long")
    want = [(i, label, sum(e for _, other, e in data if other == label)) for i, label, _ in data]
    mark = written()
    for hot in (1000, 10, 2, 1):  # all values broadcast, some, none
        assert rows_of(v.with_group_sum(df, "label", "e", "total", hot), "i", "label", "total") == in_order(want)
    release_since(spark, mark)


def test_no_usable_vector(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", [math.nan] * 64)], "vec_id long, label string, embedding array<float>")
    assert v.encode(df)[0].collect() == [] and c.cluster(df)[0].collect() == []
    with pytest.raises(ValueError):
        v.encode(df, entries=257)
