import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex

from lacewing.llm import language_id as l

PATH = public_tokenizers.path(l.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    """Piece -> number, and bytes' pieces, read apart from the class under test."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PATH)
    names, spelt = {}, {}
    n = 0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or "\n" in model.id_to_piece(i):
            continue
        if model.is_byte(i):
            spelt[int(model.id_to_piece(i)[3:5], 16)] = n
        else:
            names[model.id_to_piece(i)] = n
        n += 1
    return names, spelt, n


def ways(word, vocabulary):
    """Every segmentation of a word, as lists of piece numbers."""
    names, spelt, _ = vocabulary
    if not word:
        yield []
        return
    if word[0] not in names:
        head = [spelt[b] for b in word[0].encode()]
        for rest in ways(word[1:], vocabulary):
            yield head + rest
        return
    for k in range(1, len(word) + 1):
        if word[:k] in names:
            for rest in ways(word[k:], vocabulary):
                yield [names[word[:k]], *rest]


def brute_total(word, logs, vocabulary):
    return math.log(sum(math.exp(sum(logs[i] for i in way)) for way in ways("▁" + word, vocabulary)))


WORDS = ["a", "the", "und", "été", "ñandú", "straße", "ꙮx", "漢字", "zzz", "ﷺ"]


def test_word_probability_is_the_sum_over_segmentations(vocabulary):
    assert l.pieces_of(PATH).count == vocabulary[2]
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(vocabulary[2]) * 0.1, 2) + 1e-9)
    score = l.Model(PATH, ["x", "y"], np.zeros(2), logs).word_scores()
    got = score(WORDS)
    want = [[brute_total(w, row, vocabulary) for row in logs] for w in WORDS]
    assert np.allclose(got, want, rtol=1e-10)


def test_expected_pieces_are_shares_of_segmentations(vocabulary):
    pieces = l.pieces_of(PATH)
    logs = np.log(np.random.default_rng(2).dirichlet(np.ones(pieces.count) * 0.1, 2) + 1e-9)
    lang = np.array([k % 2 for k in range(len(WORDS))])
    edges = pieces.edges(WORDS)
    share = edges.posteriors(l.Weights(logs, pieces.sizes), lang)
    for k, w in enumerate(WORDS):
        found, total = defaultdict(float), 0.0
        for way in ways("▁" + w, vocabulary):
            p = math.exp(sum(logs[lang[k]][i] for i in way))
            total += p
            for i in way:
                found[i] += p
        got = defaultdict(float)
        for i, s in zip(edges.piece[edges.word == k], share[edges.word == k]):
            got[i] += s
        for i in found:
            assert got[i] == pytest.approx(found[i] / total, rel=1e-9)
        assert set(got) == set(found)


def test_long_words_go_on_in_logarithms():
    """The same sums, whether plain numbers or logarithms are added; a word of 50,000 letters
    doesn't underflow."""
    pieces = l.pieces_of(PATH)
    logs = np.log(np.random.default_rng(3).dirichlet(np.ones(pieces.count) * 0.1, 2) + 1e-9)
    batch = ["w" * 50_000, "short", "ab" * 400, "e"]
    edges, weights = pieces.edges(batch), l.Weights(logs, pieces.sizes)
    total = edges.totals(weights)
    assert np.isfinite(total).all() and total[0, 0] < -1000
    assert np.allclose(total, edges.forward(logs, edges.piece, True)[:, edges.stop], rtol=1e-9)
    share = edges.posteriors(weights, np.zeros(4, np.int64))
    assert np.isfinite(share).all() and share.min() >= 0
    covered = np.bincount(edges.word, share * (edges.to - edges.come), 4)
    assert np.allclose(covered, edges.lengths)  # each character is in one piece


def brute_words(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())


def test_words_of_whole_texts(messy_rows, monkeypatch):
    for span in (l.SPAN, 7):
        monkeypatch.setattr(l, "SPAN", span)
        for text in [t for _, t in messy_rows if t] + ["½x² áb́ ́c Iİ don't", "x" * 40, "é" * 9 + "1" + "ß"]:
            found = Counter(w for some in l.words(text) for w in some)
            assert found == Counter(brute_words(text))


def brute_model(rows, vocabulary, rounds):
    counts, docs = defaultdict(Counter), Counter()
    for lang, text in rows:
        if lang is not None and text is not None:
            docs[lang] += 1
            counts[lang].update(brute_words(text))
    langs = sorted(k for k in counts if counts[k])
    logs = np.full((len(langs), vocabulary[2]), -math.log(vocabulary[2]))
    for _ in range(rounds):
        c = np.zeros(logs.shape)
        for k, lang in enumerate(langs):
            for w, n in counts[lang].items():
                found, total = defaultdict(float), 0.0
                for way in ways("▁" + w, vocabulary):
                    p = math.exp(sum(logs[k][i] for i in way))
                    total += p
                    for i in way:
                        found[i] += p
                for i, p in found.items():
                    c[k, i] += n * p / total
        pooled = (c.sum(0) + l.FLOOR) / (c.sum(0) + l.FLOOR).sum()
        logs = np.log((c + l.PRIOR * pooled) / (c.sum(1, keepdims=True) + l.PRIOR))
    share = np.log([docs[x] / sum(docs[y] for y in langs) for x in langs])
    return langs, share, logs


TRAIN = [
    ("en", "the cat and the dog"), ("en", "this and that"), ("de", "der hund und die katze"), ("de", "Das ist ein Hund"), ("fr", None), (None, "not read"),
    ("xx", "12 ..."), ("es", "el gato y el perro"), ("es", "ñandú"), ("en", "漢字 the"),
]


def test_against_brute_force(spark, vocabulary):
    langs, share, logs = brute_model(TRAIN, vocabulary, l.ROUNDS)
    model = l.train(spark.createDataFrame(TRAIN, "lang string, text string").repartition(3), PATH)
    assert model.langs == langs == ["de", "en", "es"]
    assert np.allclose(model.shares, share)
    assert np.allclose(model.logs, logs, atol=0.02)  # expectations are whole 4096ths
    texts = ["the dog", "die Katze!", None, "", "1234 %", "el perro y", "und the und", "漢", "Ω"]
    docs = spark.createDataFrame([(i, t, "clash", 7.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in l.predict(docs, model, limit=2).collect()}
    for i, t in enumerate(texts):
        w = brute_words(t)
        if not w:
            assert got[i] == ("und", 0.0)
            continue
        z = np.array([s + sum(brute_total(x, row, vocabulary) for x in w) for s, row in zip(model.shares, model.logs)])
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i][0] == langs[int(p.argmax())] and got[i][1] == pytest.approx(p.max(), rel=1e-9)


def test_the_model_does_not_depend_on_partitions(spark, messy):
    texts = messy.select("lang", "text")
    one = l.train(texts.coalesce(1), PATH)
    many = l.train(texts.repartition(7), PATH)
    assert one.langs == many.langs and np.array_equal(one.logs, many.logs) and np.array_equal(one.shares, many.shares)


def test_few_words_held_at_once(spark, messy, rows_of):
    texts = messy.select("lang", "text")
    assert rows_of(l.count_words(texts, 5), "lang", "word", "n") == rows_of(l.count_words(texts), "lang", "word", "n")


def test_nothing_learned(spark, nothing, messy):
    model = l.train(nothing, PATH)
    assert model.langs == []
    assert {(r["lang_pred"], r["score"]) for r in l.predict(messy.select("doc_id", "text"), model).collect()} == {("und", 0.0)}


def test_held_out_texts(spark, sf_dir):
    found = l.op11_language_id(spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in found.collect() if r["held_out"] and truth[r["doc_id"]] is not None]
    assert len(held) > 20 and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
