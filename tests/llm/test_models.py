import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacewing.llm import lm_scoring, quality_classifier
from lacewing.llm._shared import id_remainder

SF = "/root/testdata/sf0.01"


def test_base_score_and_counts_by_hand(messy, messy_rows, in_order):
    rows = lm_scoring.score_documents(messy, id_remainder(F.col("doc_id")) == 1).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    cut = [(i, [*(t or "").encode().lower().split(), b"\0end"]) for i, t in messy_rows]
    c = Counter(w for i, ws in cut if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    base = lambda ws: sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
    want = in_order([(i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(float(base(ws)), 6)) for i, ws in cut])
    assert in_order([(*tuple(r)[:5], round(r.base_score, 6)) for r in rows]) == want
    assert all(r.score < 0 and np.isfinite(r.score) for r in rows)


def test_probabilities_of_spellings_are_a_distribution():
    """All strings of up to a length, and all longer ones by their prefix, sum to one."""
    coder = lm_scoring.Coder(np.arange(256), 1000)
    total = int(coder.offsets[-1])
    rng = np.random.default_rng(0)
    zeros, ones = rng.integers(0, 9, (2, total)).astype(np.float32)
    w = rng.normal(size=(lm_scoring.SETS, lm_scoring.CONTEXTS))
    refine = rng.uniform(0.1, 0.9, (lm_scoring.SETS, lm_scoring.BINS))
    letters = [bytes([b]) for b in range(256) if b != 32]
    p = lambda words: 10 ** lm_scoring.spell(words, np.zeros(len(words), np.int64), np.zeros(len(words)), coder, zeros, ones, w, refine)
    assert p([b""])[0] + p(letters).sum() < 1
    assert sum(2.0 ** -len(path) for path in lm_scoring.huffman(np.arange(256))) == pytest.approx(1)


def split_texts(rows):
    return [[*(t or "").encode().lower().split(), b""] for _, t in rows]


def test_frequent_words_and_what_follows_them_are_exact_in_any_partitions(spark, messy, messy_rows, monkeypatch):
    cut = split_texts(messy_rows)
    words = Counter(w for ws in cut for w in ws[:-1])
    for named, n in ((2000, 1), (7, 7), (40, 3)):
        monkeypatch.setattr(lm_scoring, "NAMED", named)
        monkeypatch.setattr(lm_scoring, "FREQUENT", 5)
        want = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]]
        docs = messy.select("doc_id", F.lit(False).alias("held_out"), "text").repartition(n)
        chunks = lm_scoring._chunks(docs)
        if named == 2000:  # the workers see the module's own constants
            assert lm_scoring._frequent(chunks) == want
            place = {w: i for i, w in enumerate(want)}
    monkeypatch.undo()
    next_one, next_of = lm_scoring._follow(chunks, place)
    adjacent, skipping = Counter(), Counter()
    size = lm_scoring.FREQUENT
    for ws in cut:
        f = [place.get(w, -1) if w else size for w in ws]
        adjacent.update((a, b) for a, b in zip([size, *f], f) if a >= 0 and b >= 0)
        seen = [x for x in f if 0 <= x < size]
        skipping.update(zip(seen, seen[1:]))
    assert {(int(a), int(b)): int(next_one[a, b]) for a, b in zip(*np.nonzero(next_one[:, : size + 1]))} == adjacent
    assert {(int(a), int(b)): int(next_of[a, b]) for a, b in zip(*np.nonzero(next_of))} == skipping


def test_upper_bounds_leave_no_frequent_word_out(spark):
    """Words that no chunk names first, but that are frequent over all chunks."""
    own = [" ".join(f"own{i}_{k} " * 50 for k in range(2000)) for i in range(3)]
    docs = spark.createDataFrame([(i, t + " common" * 40, False) for i, t in enumerate(own)], "doc_id long, text string, held_out boolean").repartition(3, "doc_id")
    top = lm_scoring._frequent(lm_scoring._chunks(docs))
    assert top[0] == b"common" and len(top) == lm_scoring.FREQUENT


def brute_histories(cut, held, top):
    """Of each token the bytes of its contexts of one and two tokens, by dictionaries."""
    import xxhash

    place = {w: i for i, w in enumerate(top)}
    low = int(lm_scoring.LOW)
    code = lambda w: xxhash.xxh64_intdigest(w, 1) & low
    begun = [[None, None, *ws] for ws in cut]
    often = lambda w: w is None or w in place
    after = {1: {}, 2: {}}
    for ws, out in zip(begun, held):
        for i in range(2, len(ws)):
            if not out:
                after[1].setdefault(ws[i - 1], Counter())[ws[i]] += 1
                after[2].setdefault((ws[i - 2], ws[i - 1]), Counter())[ws[i]] += 1

    def byte(found, w, own, name):
        n = Counter(found)
        if own:
            n[w] -= 1
        total = sum(n.values())
        named = [(-k, name(x), x) for x, k in n.items() if k > 0 and name(x) is not None]
        if not named:
            return 0
        k, _, first = min(named)
        return int(lm_scoring._state(np.array([-k]), np.array([total]), np.array([first == w]))[0])

    few = lambda x: lm_scoring.FREQUENT if x == b"" else place.get(x)
    rows = []
    for ws, out in zip(begun, held):
        for i in range(2, len(ws)):
            u, v, w = ws[i - 2 : i + 1]
            one = byte(after[1].get(v, {}), w, not out, few if often(v) else code)
            two = 0 if often(u) and often(v) else byte(after[2].get((u, v), {}), w, not out, code)
            rows.append((two, one))
    return rows


def test_scores_against_brute_force(spark, messy_rows, monkeypatch):
    """Counts, classes, histories and the chain of decisions by dictionaries; the learned
    parts, cells and spelling, by the functions themselves on those counts."""
    monkeypatch.setattr(lm_scoring, "context_bits", lambda tokens: 47)  # no two contexts with one hash
    keep = [(i, t) for i, t in messy_rows if t is None or len(t) < 20_000]
    docs = spark.createDataFrame(keep, "doc_id long, text string")
    got = lm_scoring.score_documents(docs.repartition(3), id_remainder(F.col("doc_id")) == 1).collect()
    cut = split_texts(keep)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in keep]
    counts = Counter(w for ws, out in zip(cut, held) if not out for w in ws)
    top = [w for w, _ in sorted(((w, n) for w, n in counts.items() if w), key=lambda x: (-x[1], x[0]))[: lm_scoring.FREQUENT]]
    place = {w: i for i, w in enumerate(top)}
    m = np.zeros((lm_scoring.FREQUENT,) * 2, np.int64)
    for ws, out in zip(cut, held):
        seen = [place[w] for w in ws if w in place]
        if not out:
            for a, b in zip(seen, seen[1:]):
                m[a, b] += 1
    group = lm_scoring._groups(m, len(top))
    classes, pair, of_class = [], Counter(), Counter()
    for ws, out in zip(cut, held):
        n = np.zeros(lm_scoring.GROUPS)
        for w in ws:
            c = int(np.argmax(n)) if n.any() else lm_scoring.GROUPS
            classes.append(c)
            if not out:
                pair[w, c] += 1
                of_class[c] += 1
            if w in place:
                n[group[place[w]]] += 1
    histories = brute_histories(cut, held, top)
    # spelling
    sizes = np.zeros(256)
    for w in counts:
        sizes += np.bincount(np.frombuffer(w + b" ", np.uint8), minlength=256)
    coder = lm_scoring.Coder(sizes, len(pair))
    zeros, ones = np.zeros(int(coder.offsets[-1]), np.float32), np.zeros(int(coder.offsets[-1]), np.float32)
    for w, c in pair:
        _, bit, slots = coder.decisions([w], np.array([c]))
        for row in slots:
            np.add.at(ones, row[bit == 1], 1)
            np.add.at(zeros, row[bit == 0], 1)
    chunks = lm_scoring._chunks(docs.withColumn("held_out", id_remainder(F.col("doc_id")) == 1))
    size = chunks.agg(F.sum("n_bytes")).first()[0]
    pairs = lm_scoring._pairs(chunks, place, group, max(4, -(-size // lm_scoring.SHARD)))
    z, o = lm_scoring._bit_counts(pairs, coder)
    assert np.array_equal(z, zeros) and np.array_equal(o, ones)
    weights, refine = lm_scoring._learn(pairs, coder, spark.sparkContext.broadcast((z.size, lm_scoring._planes(z), lm_scoring._planes(o))))
    # the chain
    tokens, cells, tails, at = [], [], [], 0
    for ws, out in zip(cut, held):
        own, hits, new = int(not out), [0, 0], 0
        for w in ws:
            c, (two, one) = classes[at], histories[at]
            at += 1
            n, k = pair[w, c] - own, counts[w] - own
            last = 0 if n > 0 else 1 if k > 0 else 2
            met = {x for x, y in pair if y == c}
            unseen = sum(v for x, v in counts.items() if x not in met) + (own * k if n == 0 and own else 0)
            if last == 2:
                tail = lm_scoring.spell([w], np.array([c]), np.array([own]), coder, zeros, ones, weights, refine)[0]
            else:
                tail = np.log10(min(1.0, n / max(of_class[c] - own, 1) if last == 0 else k / max(unseen, 1)))
            hit2, hit1 = two % 2, one % 2
            if hit2:
                one &= 254
            if hit1 or hit2:
                tail, shown = 0.0, 0
            else:
                shown = last
            past = (hits[-1] + (hits[-1] & hits[-2])) * 2 + new
            cells.append(((two * lm_scoring.S + one) * lm_scoring.HISTORY + past) * 3 + shown)
            tails.append(tail)
            tokens.append(out)
            hits.append(hit2)
            new = int(shown == 2)
    cells, tails, tokens = np.array(cells), np.array(tails), np.array(tokens)
    seen = np.unique(cells)
    n = np.array([((cells == c) & ~tokens).sum() for c in seen])
    logs = dict(zip(seen.tolist(), lm_scoring.cell_scores(seen, n)))
    each, at, want = [logs[c] for c in cells.tolist()], 0, []
    for (i, _), ws in zip(keep, cut):
        want.append((i is not None, i or 0, len(ws), round(float(sum(each[at : at + len(ws)]) + tails[at : at + len(ws)].sum()), 3)))
        at += len(ws)
    found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, round(r.score, 3)) for r in got)
    assert [x[:3] for x in found] == [x[:3] for x in sorted(want)]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in sorted(want)], abs=0.02)


def test_scores_do_not_depend_on_partitions(spark, messy):
    scores = []
    for n in (1, 16):
        r = lm_scoring.score_documents(messy.repartition(n), id_remainder(F.col("doc_id")) == 1).collect()
        scores.append(sorted((str(x.doc_id), x.n_tokens, round(x.score, 6)) for x in r))
    assert scores[0] == scores[1]


def test_a_mixer_learns_the_better_context():
    rng = np.random.default_rng(0)
    good, noise = rng.integers(0, 4, 4000), rng.integers(0, 4, 4000)
    bit = (rng.random(4000) < np.array([0.05, 0.3, 0.7, 0.95])[good]).astype(np.int64)
    m = lm_scoring.Mixer([good, noise], np.zeros(4000, np.int64), bit, np.ones(4000, np.int64))
    ideal = -np.log10(np.where(bit == 1, np.array([0.05, 0.3, 0.7, 0.95])[good], 1 - np.array([0.05, 0.3, 0.7, 0.95])[good])).mean()
    assert -m.log10(bit).mean() < 1.05 * ideal


@pytest.mark.parametrize("sf, most_below", [("sf0.01", 0.25), ("sf0.1", 0.08)])
def test_scores_are_better_than_the_base_on_held_out_texts(spark, sf, most_below):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    r = lm_scoring.score_documents(docs, id_remainder(F.col("doc_id")) == 1).where("held_out")
    r = r.agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") < F.col("base_score")).cast("double"))).first()
    assert r[0] > 0.85 * r[1] and r[2] < most_below


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model, prior = quality_classifier.train(docs, labels)
    assert 0.6 < prior < 0.98
    rows = quality_classifier.score(docs, model).where("held_out").join(labels, "doc_id").where("quality IS NOT NULL").select("quality", "score", "predicted").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_classifier_ignores_labels_of_held_out_rows_and_negatives(spark, messy):
    labels = messy.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0).alias("quality"))
    held = id_remainder(F.col("doc_id")) == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("quality")))
    a, b = (quality_classifier.train(messy, x)[0] for x in (labels, other))
    assert np.allclose(a.weights, b.weights)
    rows = quality_classifier.score(messy, a).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model, _ = quality_classifier.train(nothing, labels)
    assert quality_classifier.score(nothing, model).count() == 0
    assert lm_scoring.score_documents(nothing, F.lit(False)).count() == 0


def test_pipeline_stages_on_a_small_table(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.columns == docs.columns
    clean = labels.where("quality = 1").join(docs, "doc_id").count()
    assert kept.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * clean
    single = corpus_pipeline.STAGES[1][1](spark, docs, SF)
    assert single.columns == docs.columns
    assert single.select("text").distinct().count() == single.count() <= docs.select("text").distinct().count()
    last = corpus_pipeline.run(spark, SF)
    used = last.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert used.where("n > 2048").count() == 0 and last.count() > 0
