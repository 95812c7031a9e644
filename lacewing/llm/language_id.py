"""Language identification by unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary (a sentencepiece file); each language has its own
probabilities for them. A word (a run of letters with their marks, in lower case, led by
U+2581) has the probability of all its segmentations together: the forward algorithm adds up, at
each position, every piece that ends there times what comes before it. A character that no piece
holds is spelt by its UTF-8 bytes' pieces. A text's score for a language is the language's
share of the training documents times the product over its words; ``score`` is the posterior of
the language predicted.

Probabilities are learned by expectation-maximisation. The training texts are counted to (language, word, count) once; a round adds up, over these distinct words, how often each piece is
expected by the forward and backward sums. Expectations are rounded to whole 4096ths for each
word, so sums are exact and the model is the same however rows are dealt. Each language is
smoothed towards all languages together. The driver holds a number for each piece and language,
nothing that grows with the texts; languages are assumed to be few (thousands at most).

Pieces are found by a walk in their trie from every character, and sums are made in
NumPy for all words together, position by position; words too long for plain numbers are
summed in logarithms, by the same steps. Every word of every text counts, whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text
if nothing was learned; null languages are not learned from, nor are languages without any word;
ties go to the least language by code point; a null id counts as an empty text in the fold;
repeated rows and null ids give a row each; an empty table gives none; other columns are kept but
for those named like a result.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, id_remainder, map_arrow, materialize, parts, release

LEAD, CUT = "▁", "\n"
UNDETERMINED = "und"
VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
#: Pseudo-counts of all languages' shares in each, and of each piece in these.
PRIOR, FLOOR = 2000.0, 0.01
WHOLE = 4096
BYTE = 0xF0000  # private characters that stand for the bytes of a character without piece
SPAN = 1 << 20  # characters of a text at once
WORDS = 400_000  # distinct words that a task holds before it hands them on, or starts anew
BATCH = 4_000  # words at once in the sums
LEVEL = 2.0  # added to a log probability for each character, so that sums stay near 1

_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_OTHER = regex.compile(r"[^\p{L}\p{M}]")


def words(text: str):
    """Lists of a text's words, in no order, a stretch of the text at a time."""
    at, n = 0, len(text)
    while at < n:
        end = at + SPAN
        if end < n:  # to the end of a word
            found = _OTHER.search(text, end)
            end = found.start() if found else n
        out, odd = [], []
        for w in text[at:end].lower().split():
            (out if w.isalpha() else odd).append(w)
        if odd:
            out += _RUN.findall(" ".join(odd))
        yield out
        at = end


class Pieces:
    """The vocabulary as a trie, its steps in a hash table, walked from every character of many
    words at once."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                names.append(chr(BYTE + int(name[1:-1], 16)))
            elif name and CUT not in name and not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                names.append(name)
        self.count = len(names)
        self.sizes = np.array([len(x) for x in names], np.int64)
        self.known = {x for x in names if len(x) == 1} | {LEAD}
        steps: dict[int, int] = {}
        ends = {}
        for i, name in enumerate(names):
            state = 0
            for c in name:
                state = steps.setdefault(state << 21 | ord(c), len(steps) + 1)
            ends[state] = i
        self.piece = np.full(len(steps) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.next = np.zeros(1 << self.bits, np.int32)
        keys, after = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32)
        slots = self._slots(keys)
        while keys.size:  # one key to a free slot, the others try the next slot
            first = np.unique(slots, return_index=True)[1]
            first = first[self.keys[slots[first]] < 0]
            self.keys[slots[first]], self.next[slots[first]] = keys[first], after[first]
            left = np.ones(keys.size, bool)
            left[first] = False
            keys, after, slots = keys[left], after[left], (slots[left] + 1) % self.keys.size

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after each character, 0 where no piece goes on so."""
        keys = state.astype(np.int64) << 21 | codes
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.next[slots], 0)
        again = np.flatnonzero((there != keys) & (there >= 0))
        while again.size:
            slots[again] = (slots[again] + 1) % self.keys.size
            there = self.keys[slots[again]]
            hit = there == keys[again]
            out[again[hit]] = self.next[slots[again[hit]]]
            again = again[~hit & (there >= 0)]
        return out

    def spell(self, word: str) -> str:
        if self.known.issuperset(word):
            return LEAD + word
        return LEAD + "".join(c if c in self.known else "".join(chr(BYTE + b) for b in c.encode()) for c in word)

    def edges(self, batch: list[str]) -> Edges:
        spelt = [self.spell(w) for w in batch]
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        codes = np.frombuffer((CUT.join(spelt) + CUT).encode("utf-32-le"), "<u4").astype(np.int64)
        start = np.arange(codes.size)
        state, size = np.zeros(codes.size, np.int32), 0
        come, piece, sizes = [], [], []
        while start.size:
            state = self._step(state, codes[start + size])
            size += 1
            alive = np.flatnonzero(state)
            start, state = start[alive], state[alive]
            found = self.piece[state]
            some = np.flatnonzero(found >= 0)
            come.append(start[some])
            piece.append(found[some])
            sizes.append(np.full(some.size, size, np.int64))
        return Edges(np.concatenate(come), np.concatenate(piece), np.concatenate(sizes), lengths)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


class Weights:
    """Log probabilities by language and piece, and the same as plain numbers, raised by LEVEL
    for each character."""

    def __init__(self, logs: np.ndarray, sizes: np.ndarray):
        self.logs, self.plain, self.count = logs, np.exp(logs + LEVEL * sizes), logs.shape[1]


class Edges:
    """The pieces in words that lie one after another, a separator between them. Nodes are the
    places between characters, counted through all words. Every character is a piece, so
    every node is reached, and a word has a node at every place up to its length."""

    def __init__(self, come, piece, sizes, lengths):
        self.come, self.to, self.piece, self.lengths = come, come + sizes, piece, lengths
        self.begin = np.cumsum(lengths + 1) - lengths - 1  # each word's first node
        self.word = np.repeat(np.arange(lengths.size), lengths + 1)[come]
        self.stop = self.begin + lengths  # each word's last node

    def _sweep(self, table: np.ndarray, index: np.ndarray, come: np.ndarray, place: np.ndarray, first: np.ndarray, way: int, logs: bool) -> np.ndarray:
        """By row of ``table`` and node, sums over all paths from each word's ``first`` node;
        ``index`` is where edges have their weights in a row, ``place`` how many nodes an edge's
        far side is from the first, ``way`` the direction."""
        n = self.lengths.size
        out = np.full((len(table), int(self.lengths.sum()) + n), -np.inf if logs else 0.0)
        out[:, first] = 0.0 if logs else 1.0
        order = np.argsort(place.astype(np.int16) if place.size and place.max() < 1 << 15 else place, kind="stable")
        word, come, index = self.word[order], come[order], index[order]
        steps = np.append(np.flatnonzero(np.diff(place[order], prepend=-1)), order.size)
        for k, (a, b) in enumerate(zip(steps[:-1].tolist(), steps[1:].tolist()), 1):
            w, c, i = word[a:b], come[a:b], index[a:b]
            there = np.flatnonzero(self.lengths >= k)
            at = first[there] + way * k
            for row, weights in zip(out, table):
                if logs:
                    found = np.full(n, -np.inf)
                    np.logaddexp.at(found, w, row[c] + weights[i])
                else:
                    found = np.bincount(w, row[c] * weights[i], n)
                row[at] = found[there]
        return out

    def forward(self, table: np.ndarray, index: np.ndarray, logs: bool = False) -> np.ndarray:
        """Sums over all segmentations of what comes before each node."""
        return self._sweep(table, index, self.come, self.to - self.begin[self.word], self.begin, 1, logs)

    def backward(self, table: np.ndarray, index: np.ndarray, logs: bool = False) -> np.ndarray:
        return self._sweep(table, index, self.to, self.stop[self.word] - self.come, self.stop, -1, logs)

    def only(self, words: np.ndarray) -> tuple[Edges, np.ndarray]:
        """The edges of some words alone, and which they are."""
        chosen = np.zeros(self.lengths.size, bool)
        chosen[words] = True
        at = np.flatnonzero(chosen[self.word])
        few = object.__new__(Edges)
        few.piece, few.lengths = self.piece[at], self.lengths[chosen]
        few.begin = np.cumsum(few.lengths + 1) - few.lengths - 1
        few.word = (np.cumsum(chosen) - 1)[self.word[at]]
        moved = few.begin[few.word] - self.begin[self.word[at]]
        few.to, few.come, few.stop = self.to[at] + moved, self.come[at] + moved, few.begin + few.lengths
        return few, at

    def totals(self, weights: Weights) -> np.ndarray:
        """(languages, words): log probability of each word by all its segmentations. Sums are of
        plain numbers; words whose sums leave their range are done in logarithms."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            sums = self.forward(weights.plain, self.piece)[:, self.stop]
            out = np.log(sums) - LEVEL * self.lengths
        odd = np.flatnonzero(~((sums > 1e-250) & (sums < 1e250)).all(0))
        if odd.size:
            few, _ = self.only(odd)
            out[:, odd] = few.forward(weights.logs, few.piece, True)[:, few.stop]
        return out

    def posteriors(self, weights: Weights, lang: np.ndarray) -> np.ndarray:
        """Of each edge, the share of its word's probability in segmentations that use it, in the
        word's language."""
        flat, table = weights.logs.reshape(1, -1), weights.plain.reshape(1, -1)
        index = lang[self.word] * weights.count + self.piece
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            f, b = self.forward(table, index)[0], self.backward(table, index)[0]
            total = f[self.stop]
            out = f[self.come] * table[0, index] * b[self.to] / total[self.word]
        odd = np.flatnonzero(~((total > 1e-125) & (total < 1e125)))
        if odd.size:
            few, at = self.only(odd)
            f, b = few.forward(flat, index[at], True)[0], few.backward(flat, index[at], True)[0]
            out[at] = np.exp(f[few.come] + flat[0, index[at]] + b[few.to] - f[few.stop][few.word])
        return out


# ---------------------------------------------------------------- learning


def count_words(texts: DataFrame, limit: int = WORDS) -> DataFrame:
    """(lang, word, n) of rows (lang, text): counted within tasks first, so that a frequent
    word or language costs a row for each task."""

    def count(batches):
        held: dict[str, Counter] = {}

        def rows():
            for lang, found in held.items():
                names, n = list(found), list(found.values())
                for i in range(0, len(names), BATCH):
                    yield pa.record_batch([pa.array([lang] * len(names[i : i + BATCH]), pa.string()), pa.array(names[i : i + BATCH], pa.string()), pa.array(n[i : i + BATCH], pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in parts(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = held.setdefault(lang, Counter())
                for some in words(text):
                    found.update(some)
                    if sum(map(len, held.values())) > limit:
                        yield from rows()
                        found = held.setdefault(lang, Counter())
        yield from rows()

    found = map_arrow(texts.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text"), count, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(counted: DataFrame, path: str, langs: list[str], logs: np.ndarray) -> np.ndarray:
    """(languages, pieces): whole ``WHOLE``ths of how often each piece is expected."""
    at = {lang: i for i, lang in enumerate(langs)}

    def expect(batches):
        pieces = pieces_of(path)
        weights = Weights(logs, pieces.sizes)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                part = batch.slice(i, BATCH)
                lang = np.array([at[x] for x in part.column("lang").to_pylist()])
                n = part.column("n").to_numpy()
                edges = pieces.edges(part.column("word").to_pylist())
                share = edges.posteriors(weights, lang)
                # An edge's share is rounded by itself; a piece twice in a word is two edges.
                whole = np.rint(share * n[edges.word] * WHOLE).astype(np.int64)
                for k in np.unique(lang):
                    own = lang[edges.word] == k
                    total = sums.setdefault(int(k), np.zeros(pieces.count, np.int64))
                    np.add.at(total, edges.piece[own], whole[own])
        for k, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(np.full(some.size, k), pa.int32()), pa.array(some, pa.int32()), pa.array(total[some])], names=["lang", "piece", "v"])

    found = map_arrow(counted, expect, "lang int, piece int, v long").groupBy("lang", "piece").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(logs.shape, np.int64)
    out[found.column("lang").to_numpy(), found.column("piece").to_numpy()] = found.column("v").to_numpy()
    return out


def smoothed(counts: np.ndarray, prior: float = PRIOR, floor: float = FLOOR) -> np.ndarray:
    """Log probabilities by language and piece."""
    c = counts / WHOLE
    pooled = c.sum(0) + floor
    pooled /= pooled.sum()
    return np.log((c + prior * pooled) / (c.sum(1, keepdims=True) + prior))


class Model:
    """Languages in code point order, their log shares of documents and log piece probabilities."""

    def __init__(self, path: str, langs: list[str], shares: np.ndarray, logs: np.ndarray):
        self.path, self.langs, self.shares, self.logs = path, langs, shares, logs

    def word_scores(self):
        """words -> (words, languages)"""
        pieces = pieces_of(self.path)
        weights = Weights(self.logs, pieces.sizes)

        def score(batch: list[str]) -> np.ndarray:
            cut = (batch[i : i + BATCH] for i in range(0, len(batch), BATCH))
            return np.concatenate([np.zeros((0, len(self.langs))), *(pieces.edges(x).totals(weights).T for x in cut)])

        return score


def train(docs: DataFrame, path: str, rounds: int = ROUNDS) -> Model:
    """Learns from rows (lang, text)."""
    counted = materialize(count_words(docs), "language-words")
    n_docs = {r["lang"]: r["n"] for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    count = pieces_of(path).count
    logs = np.full((len(langs), count), -np.log(count))
    for _ in range(rounds if langs else 0):
        logs = smoothed(expected_counts(counted, path, langs, logs))
    release(counted)
    total = sum(n_docs[lang] for lang in langs)
    return Model(path, langs, np.log(np.array([n_docs[lang] / total for lang in langs])), logs)


# ---------------------------------------------------------------- prediction


def predict(docs: DataFrame, model: Model, limit: int = WORDS) -> DataFrame:
    """All columns of ``docs`` but for clashing names, and lang_pred and score."""
    rest = [c for c in docs.columns if c not in {"lang_pred", "score"}]
    at = rest.index("text")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def compute(batches):
        place: dict[str, int] = {}
        score_words = model.word_scores() if model.langs else None
        scores = np.zeros((1024, len(model.langs)))

        def of(some: list[str]) -> np.ndarray:
            """The words' scores; they are kept from text to text, up to ``limit`` words."""
            nonlocal scores
            if len(place) > limit:
                place.clear()
            new = list(set(some).difference(place))
            if new:
                at, end = len(place), len(place) + len(new)
                if end > len(scores):
                    scores = np.concatenate([scores[:at], np.zeros((max(at, end - at), scores.shape[1]))])
                scores[at:end] = score_words(new)
                place.update(zip(new, range(at, end)))
            return scores[np.fromiter(map(place.__getitem__, some), np.int64, len(some))]

        for batch in parts(batches):
            texts = batch.column(at).to_pylist()
            sums, some_letter = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts), bool)
            held, sizes, which = [], [], []

            def settle():
                rows = of(held)
                starts = np.cumsum([0, *sizes[:-1]])
                np.add.at(sums, which, np.add.reduceat(rows, starts, axis=0))
                for x in (held, sizes, which):
                    x.clear()

            for i, text in enumerate(texts):
                for some in words(text or ""):
                    if some:
                        some_letter[i] = True
                        if model.langs:
                            held += some
                            sizes.append(len(some))
                            which.append(i)
                if len(held) > 5 * BATCH:
                    settle()
            if held:
                settle()
            if model.langs:
                z = sums + model.shares
                best = z.argmax(1)
                score = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                names = [model.langs[k] if some else UNDETERMINED for k, some in zip(best, some_letter)]
                score = np.where(some_letter, score, 0.0)
            else:
                names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(score)], names=[*rest, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "lang_pred string, score double"])
    return map_arrow(docs.select(*rest), compute, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir)
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out).select("lang", "text"), public_tokenizers.path(VOCABULARY))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
