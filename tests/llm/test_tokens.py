import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer, models, pre_tokenizers  # noqa: E402

from lacewing.llm import packing, token_counts, token_files  # noqa: E402
from lacewing.llm._shared import shared_path  # noqa: E402


def library(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_equal_the_librarys_unigram_model(messy, messy_rows, rows_of, in_order):
    path = P.path("piece_bpe_32k.model")
    vocabulary = [("<unk>", 0.0), *token_counts.unigram_vocabulary(path)]
    t = Tokenizer(models.Unigram([(p, s) for p, s in vocabulary], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    want = []
    for i, s in messy_rows:
        if s is not None and "\x1c" in s:
            s = None
        ids = t.encode(s or "").ids
        want.append((i, len(ids), ids.count(0)))
    got = rows_of(token_counts.count_tokens(messy, path), "doc_id", "n_tokens", "n_unknown")
    odd = next(i for i, s in messy_rows if s and "\x1c" in s)
    drop = lambda rows: [r for r in rows if r[0] != odd]
    assert drop(got) == drop(in_order(want))


def test_count_ties_take_the_longest_last_piece():
    # ab+c and a+bc tie at -2, and so does abc as a single piece
    c = token_counts.ViterbiCounter([("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -1.0), ("bc", -1.0)])
    t = Tokenizer(models.Unigram([("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -1.0), ("bc", -1.0)], unk_id=0))
    for word in ("abc", "aabbcc", "cbabcbab", "abzzc", "zz", "z"):
        ids = t.encode(word).ids
        c.unknown = -1.0 - 10
        assert c.count(word)[0] == len(ids), word
    assert c.count("") == (0, 0)


def test_packing_against_the_library(messy, messy_rows, in_order):
    encode = library("byte_bpe_50k.json")
    want = []
    for i, s in messy_rows:
        ids = [*encode(s), 0]
        first = (len(ids) - 1) % 128 + 1
        cuts = [0, *range(first, len(ids) + 1, 128)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    out = packing.pack_documents(messy, P.path("byte_bpe_50k.json"), 0, 128, bins_per_group=50).collect()
    assert in_order([tuple(r)[:5] for r in out]) == in_order(want)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 128
    assert len(bins) <= 1.05 * sum(r.length for r in out) / 128 + 8


@pytest.mark.parametrize("tasks", [2, 20_000])
def test_groups_are_even_and_whole_whatever_the_ids(spark, monkeypatch, tasks):
    """A third of all pieces repeats one row; a task with many groups packs as many tasks with one do."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(packing, "MOST_TASKS", tasks)
    one = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"))
    one = one.withColumns({"length": F.lit(7).cast("long"), "ids_crc32": F.lit(1).cast("long")})
    rest = spark.range(0, 8000, 1, 4).select("id", F.lit(0), F.lit(0).cast("long"), F.col("id") % 128 + 1, F.lit(2).cast("long"))
    table = one.union(rest)
    out = packing.pack(table, 128, bins_per_group=40).collect()
    assert sorted(r.length for r in out) == sorted(r.length for r in table.collect()) and len(out) == 12_000
    bins, groups, hot = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        groups[r.sequence_id >> 32] += 1
        hot[r.sequence_id >> 32] += r.doc_id is None
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [a for a, _ in sorted(held)] == [0, *ends[:-1].tolist()] and ends[-1] <= 128
    assert len(groups) == -(-sum(r.length for r in out) // (128 * 40))
    assert max(groups.values()) < 1.5 * 12_000 / len(groups) and max(hot.values()) < 2 * 4000 / len(groups)
    assert len(bins) <= 1.06 * sum(r.length for r in out) / 128


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_respects_every_capacity(rule):
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(1, 100, 500))[::-1]
    bins, offsets = packing.best_fit(n, (100, 3, 6000 + 100 * 100 - 6000), (1, 1, 1), rule)
    for b in np.unique(bins):
        held = n[bins == b]
        assert held.sum() <= 100 and held.size <= 3 and (held**2).sum() <= 10000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(held) - held)
    tight, _ = packing.best_fit(n, (100, 100, 10000), (1, 0, 0))
    assert np.bincount(tight, n).max() <= 100
    with pytest.raises(ValueError):
        packing.best_fit(np.array([50]), (100, 3, 100))


def test_token_files_round_trip(spark, messy, messy_rows, rows_of):
    encode = library("word_bpe_49k.json")
    out = shared_path(spark, "test-files")
    manifest = token_files.write_token_files(messy, out, P.path("word_bpe_49k.json"), 1, 32, 4, ranges=3)
    got = token_files.read_token_files(spark, manifest, out)
    import xxhash

    signed = lambda x: x - (x >> 63 << 64)
    digest = lambda t: 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42))  # noqa: E731  Spark's hash of a null is the seed
    rows = sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    at, want = 0, []
    for i, s in rows:
        ids = [*encode(s), 1]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    by_start = sorted(want, key=lambda r: r[1])
    assert sorted((tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1]) == by_start
    # random access: every sequence of every file, masks included, gives the stream again
    stream = []
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        reader = token_files.open_sequences(r.file)
        n = sum(reader.get_batch(i).num_rows for i in range(reader.num_record_batches))
        for i in range(n):
            ids, mask = token_files.sequence(reader, i)
            assert ids.size == mask.size == 32
            stream += ids[mask].tolist()
    assert stream == [x for i, s in rows for x in [*encode(s), 1]]


def test_empty_tables(spark, nothing):
    assert token_counts.count_tokens(nothing, P.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack_documents(nothing, P.path("byte_bpe_50k.json")).count() == 0
    out = shared_path(spark, "test-none")
    manifest = token_files.write_token_files(nothing, out, P.path("word_bpe_49k.json"))
    assert token_files.read_token_files(spark, manifest, out).count() == 0


def random_texts():
    """Strings of awkward parts, and of all code points below U+0250 and marks."""
    import random

    rng = random.Random(4)
    parts = ["don't", "co-op", "caf\u0065\u0301", "a\u0301b", "stra\u00dfe", "\u0416\u0436x", "x\u0416", "\u6f22\u5b57", "12a3", "'s", "'", "a's", "...", "a.b,c", "!!\x1c!",
             " ", "  ", "\n", "\t\n ", "\xa0", "\u3000", "\u2003", "\x85", "\u200b", "\U0001f642", "%%%", "I'LL", "\u0130\u03a3", "\u0130!", "\u0130.\u0130", "\u1e9e", "<|endoftext|>",
             "\u00aa1", "\u00b2", "\u0345", "A sixteen-byte-or-longer word", "Donaudampfschiffahrt"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    points = [chr(i) for i in range(0x250)] + [chr(i) for i in range(0x300, 0x370)]
    letters = "abcXYZ .,!'19\u00e9\u0130"
    texts += ["".join(rng.choice(points if rng.random() < 0.6 else letters) for _ in range(rng.randrange(1, 14))) for _ in range(20000)]
    return texts


@pytest.mark.parametrize("name, lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_are_encoded_as_the_whole_text(name, lower):
    from lacewing.llm.encoding import Encoder

    texts = random_texts()
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    want = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    raw = [x.encode() for x in texts]
    for code, step in ((Encoder(P.path(name), lower), len(raw)), (Encoder(P.path(name), lower, 3000), 100)):
        for i in range(0, len(raw), step):
            ids, edges = code.encode(raw[i : i + step])
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                assert ids[a:b].tolist() == want[i + k], repr(texts[i + k])
    assert [x.size for x in Encoder(P.path(name)).encode([])] == [0, 1]


def test_ids_that_do_not_fit_are_refused(spark):
    docs = spark.createDataFrame([(1, "\u4e00")], "doc_id long, text string")
    with pytest.raises(Exception, match="doesn't fit"):
        token_files.write_token_files(docs, shared_path(spark, "test-wide"), P.path("byte_bpe_50k.json"), id_bits=8)


def test_as_few_sequences_as_an_exhaustive_search():
    """Small cases under tight document and attention limits, against all ways of packing."""

    def least(items, caps):
        best = len(items)

        def place(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            n = items[i]
            need = (n, 1, n * n)
            for b in range(len(bins)):
                if all(x + y <= c for x, y, c in zip(bins[b], need, caps)):
                    place(i + 1, [*bins[:b], tuple(x + y for x, y in zip(bins[b], need)), *bins[b + 1 :]])
            place(i + 1, [*bins, need])

        place(0, [])
        return best

    rng = np.random.default_rng(3)
    for rule in ("norm", "dot"):
        over = 0
        for _ in range(60):
            n = np.sort(rng.integers(1, 60, 9))[::-1]
            caps = (100, int(rng.integers(2, 5)), int(rng.integers(3600, 6000)))
            bins, _ = packing.best_fit(n, caps, (1.0, 1.0, 1.0), rule)
            over += int(bins.max()) + 1 - least(n.tolist(), caps)
        assert over <= 20  # a third of a sequence on average, of about four
