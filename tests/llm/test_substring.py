from collections import Counter

import pytest

from lacewing.llm import substring_dedup as s


def brute(rows, width):
    cut = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(w[i : i + width]) for w in cut for i in range(len(w) - width + 1))
    out = []
    for (i, t), w in zip(rows, cut):
        gone = {k for a in range(len(w) - width + 1) if n[tuple(w[a : a + width])] > 1 for k in range(a, a + width)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t
        out.append((i, len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("width,load,span", [(35, 1.6, 1 << 23), (3, 1.6, 256), (35, 0.01, 1 << 23), (1, 0.1, 1000)])
def test_against_brute_force(messy, messy_rows, rows_of, in_order, width, load, span):
    """Also with many small slices and chunks, and with a sketch so small that nearly every
    window goes to the exact pass."""
    found = s.remove_repeats(messy, width, load=load, span=span, chars=s.CHARS if width == 35 else 5000)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept") == in_order(brute(messy_rows, width))


def test_digest_and_other_columns(spark, messy, messy_rows, rows_of, in_order):
    import hashlib

    found = s.remove_repeats(messy, 35, digest=True)
    want = [(i, hashlib.sha256(b" ".join((k or "").encode().split())).hexdigest()) for i, *_, k in brute(messy_rows, 35)]
    assert rows_of(found, "doc_id", "kept_sha256") == in_order(want)
    assert {"lang", "source", "n_chars", "f", "start", "size", "score"} <= set(found.columns)


def test_empty_table(nothing):
    assert s.remove_repeats(nothing).count() == 0


def test_word_hashes_do_not_depend_on_blocks(monkeypatch, messy_rows):
    import numpy as np

    from lacewing.llm import substring_dedup as s

    texts = [(t or "").encode() for _, t in messy_rows]
    want = s.window_hashes(texts, 3)
    monkeypatch.setattr(s, "BLOCK", 50)
    for a, b in zip(want, s.window_hashes(texts, 3)):
        assert np.array_equal(a, b)


def thue_morse(n, one, other):
    return [one if bin(i).count("1") % 2 == 0 else other for i in range(n)]


def test_words_and_windows_of_one_pattern_are_told_apart(spark, rows_of):
    """Sequences whose polynomial hashes are equal for every odd base modulo 2**64."""
    x, y = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    tail = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{x} {tail}"), (2, f"{y} {tail}")], "doc_id long, text string")
    assert rows_of(s.remove_repeats(docs, 35), "doc_id", "n_words", "n_removed") == [(1, 35, 0), (2, 35, 0)]
    long = [(1, " ".join(thue_morse(4096, "p", "q"))), (2, " ".join(thue_morse(4096, "q", "p")))]
    found = s.remove_repeats(spark.createDataFrame(long, "doc_id long, text string"), 4096)
    assert rows_of(found, "doc_id", "n_removed") == [(1, 0), (2, 0)]


@pytest.mark.parametrize("width", [1, 2, 3, 7, 35, 64])
def test_window_hashes_follow_the_words(width):
    import numpy as np

    rng = np.random.default_rng(width)
    words = [f"{rng.integers(3)}" for _ in range(400)]
    h1, h2, at, n = s.window_hashes([" ".join(words[:200]).encode(), b"", " ".join(words[200:]).encode()], width)
    assert n.tolist() == [200, 0, 200] and len(h1) == len(h2) == 2 * (201 - width)
    spans = [tuple(words[i : i + width]) for i in at.tolist()]
    for h in (h1, h2):
        assert len(set(zip(spans, h.tolist()))) == len(set(spans)) == len(set(h.tolist()))


@pytest.mark.parametrize("n,span", [(2000, 1 << 23), (2000, 500), (16000, 500)])
def test_share_of_single_windows_that_pass(spark, n, span):
    """The prefilter works alike whatever the number of slices and of windows."""
    rows = [(i, " ".join(f"{i}w{k}" for k in range(12))) for i in range(n // 10)]
    chunks = s.write_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    size = sum(r["n_bytes"] for r in chunks.collect())
    sketch = s.sketch_for(size, 1.6 * 6.2 * n / size, span)
    shares = []
    for r in s.answers(chunks, 3, sketch).collect():
        shares.append((r["slice"] // sketch.slices, int(s._unzip_bits(bytes(r["hot"]), r["n"]).sum())))
    hot = [sum(k for row, k in shares if row == r) / n for r in range(s.ROWS)]
    assert all(0.2 < h < 0.45 for h in hot)  # of distinct cells; of windows 0.46


def test_files_go_with_the_tables(spark, messy):
    from lacewing.llm import _shared

    mark = _shared.written()
    s.remove_repeats(messy, 35).count()
    folders = [p.removeprefix("file://") for p in _shared._WRITTEN[mark:]]
    assert len(folders) == 2
    _shared.release_since(spark, mark)
    import os

    assert not any(os.path.exists(f) for f in folders)
