import random
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lacewing.llm import components, simhash


def brute_print(text, width=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)]
    nodes = sorted({x for e in edges for x in e})
    pos = {x: i for i, x in enumerate(nodes)}
    held = {(pos[a], pos[b]) for a, b in edges}
    root = brute_components(len(nodes), lambda i, j: (i, j) in held or (j, i) in held)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: nodes[root[i]] for i, x in enumerate(nodes) if nodes[root[i]] != x}
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_trie_join_finds_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    f = list(base)
    for x in base[:30]:
        for _ in range(6):
            y = int(x)
            for b in rng.choice(64, rng.integers(1, 7), replace=False):
                y ^= 1 << int(b)
            f.append(np.uint64(y))
    f = np.unique(np.array([*f, 0, 2**64 - 1, 3], np.uint64))
    near = lambda i, j: int(f[i] ^ f[j]).bit_count() <= 4
    root = brute_components(f.size, near)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f long"), 4).collect()
    of = {int(x): i for i, x in enumerate(f.view(np.int64))}
    pairs = {(of[r.src], of[r.dst]) for r in links}
    got = brute_components(f.size, lambda i, j: (i, j) in pairs or (j, i) in pairs)
    assert got == root


def test_near_duplicates_against_brute_force(messy, messy_rows, rows_of, in_order):
    f = [brute_print(t) for _, t in messy_rows]
    root = brute_components(len(f), lambda i, j: (f[i] ^ f[j]).bit_count() <= 4)
    least = defaultdict(lambda: None)
    for (i, _), r in zip(messy_rows, root):
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    want = [(i, x - (x >> 63 << 64), least[r]) for (i, _), x, r in zip(messy_rows, f, root)]
    assert rows_of(simhash.near_duplicates(messy), "doc_id", "f", "component_id") == in_order(want)


def test_large_near_group_in_one_trie():
    rng = np.random.default_rng(9)
    f = [0x123456789ABCDEF0]
    for _ in range(3000):
        f.append(f[0] ^ (1 << int(rng.integers(8, 52))) ^ (1 << int(rng.integers(8, 52))))
    keys = np.unique(np.array(f, np.uint64))
    parent = simhash._Trie(keys[:, None], keys >> np.uint64(52), 12, 4, most=4096).parent
    want = brute_components(400, lambda i, j: int(keys[i] ^ keys[j]).bit_count() <= 4)
    assert (np.unique(parent).size == 1) == (len(set(want)) == 1) and (parent <= np.arange(keys.size)).all()


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0


def test_dropping_near_copies(spark, messy, messy_rows, nothing):
    kept = simhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    texts = [" ".join((t or "").lower().split()) for _, t in got]
    assert len(set(texts)) == len(texts)
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert len(a & b) / len(a | b) < 0.8
    base = set(got)
    rare = {t: i for i, t in messy_rows if t and sum(x == t for _, x in messy_rows) == 1 and "changed" not in t and len(t.split()) > 20}
    assert sum((i, t) in base for t, i in rare.items()) >= 0.95 * len(rare)
    assert simhash.drop_near_duplicates(nothing).count() == 0


def test_similarity_limit_is_exact(spark):
    """Pairs just above 0.8 are all linked, pairs just below never, whatever the size."""
    rng, rows, n = random.Random(11), [], 0
    for k in range(300):
        size = rng.choice([60, 100, 200, 400])
        words = [f"t{k}w{i}" for i in range(size + 4)]  # ``size`` shingles, all distinct
        # Cutting c words off the end leaves (size - c) of size shingles.
        cut = size // 5 + (k % 2)
        rows += [(n, " ".join(words)), (n + 1, " ".join(words[: size + 4 - cut]))]
        n += 2
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Even k: exactly 0.8, one document kept; odd k: just below, both kept.
    assert kept == {i for i in range(n) if i % 2 == 0 or (i // 2) % 2 == 1}


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def changed_texts(rng, n_base=6, each=30):
    """Families of texts whose words are changed, dropped or added anywhere, chained and apart."""
    texts = []
    for k in range(n_base):
        base = [f"f{k}w{rng.randrange(500)}" for _ in range(rng.choice([60, 150, 300]))]
        family = [base]
        for _ in range(each):
            words = list(rng.choice(family))
            for _ in range(rng.choice([1, 2, 4, 8])):
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"] * rng.randrange(2)
            family.append(words)
        texts += [" ".join(x) for x in family]
    return texts


def test_words_changed_inside_against_brute_force(spark):
    texts = changed_texts(random.Random(21))
    sets = [shingle_set(t) for t in texts]
    root = brute_components(len(texts), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert 12 < len(set(root)) < len(texts) - 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()} == set(root)


def test_large_bucket_in_chunks_has_the_same_candidates(spark):
    rng, rows = np.random.default_rng(4), []
    base = rng.integers(0, 2**63, (4, 5), dtype=np.uint64)
    for i in range(160):
        key = [int(x) for x in base[i % 4]]
        for b in rng.choice(320, rng.integers(0, 30), replace=False):
            key[b // 64] ^= 1 << int(b % 64)
        rows.append((i, b"".join(x.to_bytes(8, "big") for x in key), [i % 2]))
    bits = [int.from_bytes(w, "big") for _, w, _ in rows]
    want = brute_components(160, lambda i, j: i % 2 == j % 2 and (bits[i] ^ bits[j]).bit_count() <= 25)
    nodes = spark.createDataFrame(rows, "node long, w binary, bands array<long>")
    for most in (1 << 17, 16):
        pairs = {(r.src, r.dst) for r in simhash.wide_links(nodes, 25, 5, most).collect()}
        assert brute_components(160, lambda i, j: (i, j) in pairs or (j, i) in pairs) == want


def test_verified_links_of_groups_cut_into_pieces(spark):
    """One group of all texts: chains, a large class, and single texts beside it."""
    texts = changed_texts(random.Random(8), 3, 25)
    texts += [" ".join(f"w{i}" for i in range(104 - 4 * k)) for k in range(20)]
    sets = [shingle_set(t) for t in texts]
    n = len(texts)
    want = brute_components(n, lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "node long, n long")
    candidates = spark.createDataFrame([(i, 0) for i in range(1, n)] * 2, "src long, dst long")
    for most in (1 << 19, 3000, 400):
        found = simhash.verified_links(candidates, sizes, lambda rows: rows.join(table, "node"), 5, 0.8, most)
        pairs = {(r.src, r.dst) for r in found.collect()}
        assert brute_components(n, lambda i, j: (i, j) in pairs or (j, i) in pairs) == want


def test_copies_of_one_text_are_not_compared_pair_by_pair(spark):
    """Texts that are all near the first: each is read once, and the first once a piece."""
    base = [f"w{i}" for i in range(104)]
    texts = [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(100)] + [" ".join(base)]
    table = spark.createDataFrame([((i + 1) % 101, t) for i, t in enumerate(texts)], "node long, text string")
    sizes = table.select("node", F.lit(100).cast("long").alias("n"))
    read = []

    def with_text(rows):
        read.append(rows.count())
        return rows.join(table, "node")

    candidates = spark.createDataFrame([(i, 0) for i in range(1, 101)], "src long, dst long")
    pairs = {(r.src, r.dst) for r in simhash.verified_links(candidates, sizes, with_text, 5, 0.8, 1000).collect()}
    assert len(set(brute_components(101, lambda i, j: (i, j) in pairs or (j, i) in pairs))) == 1
    assert sum(read) <= 100 + 11
