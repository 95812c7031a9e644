import numpy as np
import pytest

from lacewing.llm import embedding_dedup as e


def brute(ids, vectors, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    links, parent = [0] * n, list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    least_id = {}
    for i in range(n):
        r = find(i)
        if ids[i] is not None:
            least_id[r] = ids[i] if least_id.get(r) is None else min(least_id[r], ids[i])
    return [(ids[i], links[i], least_id.get(find(i)), ids[i] == least_id.get(find(i))) for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [4096, 16])
def test_against_brute_force(spark, rows_of, in_order, chunk_rows):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24)).astype(np.float32)
    vectors = [v.tolist() for v in base]
    for k in range(120):
        near = base[k % 6] + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.25])
        vectors.append(near.astype(np.float32).tolist())
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]], None, [], [0.0] * 24, [None] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    ids = [(7 * i) % 211 for i in range(len(vectors))]
    ids[5] = None
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>, r int, n int, least int")
    want = brute(ids, vectors)
    got = rows_of(e.near_vectors(df, chunk_rows=chunk_rows), "vec_id", "n_links", "component_id", "kept")
    assert got == in_order(want)


def test_empty_table(spark):
    assert e.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
