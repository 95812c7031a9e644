"""Token counts under a unigram vocabulary, without the tokens themselves.

An Aho-Corasick automaton lists every vocabulary match that ends at a position; dynamic
programming over positions carries the best score and its number of pieces. Ties follow the
tokenizers library's unigram model: of equal scores the longest last piece stays; a position
without a one-character match also offers one unknown character, at the least score minus
10; neighbouring unknown characters make one token.

Words (runs between white space) are led by U+2581 and counted apart, as by that library's
WhitespaceSplit and Metaspace steps, so the count of a word is kept in a bounded cache and a
text is a sum of counts.

Defined cases: a null or empty text has 0 tokens; repeated rows and null ids give a row
each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, map_arrow
from .encoding import SPACE

LEAD = "\u2581"
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"[^{SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")


def split(text: str) -> list[str]:
    """str.split also cuts at U+001C to U+001F, which are not white space here."""
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file in id order. A file of merge ranks has no
    probabilities; its r-th piece then gets the score -ln(r + 1)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = [model.get_score(i) for i in ids]
    if all(float(s).is_integer() for s in scores):
        scores = [-math.log(r + 1.0) for r in range(len(ids))]
    return [(model.id_to_piece(i), float(s)) for i, s in zip(ids, scores)]


class ViterbiCounter(dict):
    """Word -> (tokens, unknown tokens); at most ``limit`` words of at most 64 characters
    are kept."""

    def __init__(self, vocabulary: list[tuple[str, float]], limit: int = 1_000_000):
        import ahocorasick

        self.limit = limit
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def count(self, text: str) -> tuple[int, int]:
        """Tokens and unknown tokens of the best path over ``text``."""
        n = len(text)
        if not n:
            return 0, 0
        score, tokens, unknowns = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        last_unknown = bytearray(n + 1)
        none = -math.inf
        done, matches = 0, self.automaton.iter(text)
        item = next(matches, None)
        unknown = self.unknown
        for end in range(1, n + 1):
            best, start, single = none, -1, False
            while item is not None and item[0] == end - 1:  # longest first
                size, s = item[1]
                here = score[end - size] + s
                if here > best:
                    best, start = here, end - size
                single = single or size == 1
                item = next(matches, None)
            odd = False
            if not single:
                here = score[end - 1] + unknown
                if here > best:
                    best, start, odd = here, end - 1, True
            score[end] = best
            if odd:
                joined = last_unknown[start]
                tokens[end] = tokens[start] + (not joined)
                unknowns[end] = unknowns[start] + (not joined)
                last_unknown[end] = 1
            else:
                tokens[end], unknowns[end] = tokens[start] + 1, unknowns[start]
        return tokens[n], unknowns[n]

    def __missing__(self, word: str) -> tuple[int, int]:
        found = self.count(LEAD + word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found


_COUNTERS: dict = {}


def _counter(path: str) -> ViterbiCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = ViterbiCounter(unigram_vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every text; a narrow map, no shuffle."""

    def count(batches):
        counter = _counter(vocabulary)
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column("text").to_pylist():
                cut = split(text or "")
                pairs = [counter[w] for w in cut]
                n_words.append(len(cut))
                n_tokens.append(sum(p[0] for p in pairs))
                n_unknown.append(sum(p[1] for p in pairs))
            yield pa.record_batch(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))],
                names=["doc_id", "n_words", "n_tokens", "n_unknown"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(chosen, count, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
