"""Whole-text encoding with the tokenizers library through a bounded cache of chunks.

A pre-token of either vocabulary never runs across the start of a white-space run, nor from
a letter to an ASCII character that is neither letter nor space, so a text is cut there and
each chunk is encoded on its own: the ids are those of the whole text. Chunks repeat far more
often than texts do. The texts of a slice are cut at once as bytes, Arrow finds the distinct
chunks, only these meet the cache, and the ids are gathered with NumPy. Strings of special
tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

# The code points with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Classes of bytes: 0 others, 1 ASCII letters, 2 ASCII white space, 3 other ASCII.
_KIND = np.zeros(256, np.uint8)
_KIND[:128] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(9, 14), 32]] = 2


def _two_byte_letters() -> np.ndarray:
    """Of the code points below U+0250, which are letters that end a letter run before any
    ASCII character. U+0130 isn't: in lower case it ends in a mark."""
    out = np.zeros(0x250, bool)
    out[[0xAA, 0xB5, 0xBA]] = True
    out[0xC0:] = True
    out[[0xD7, 0xF7, 0x130]] = False
    return out


_LETTER = _two_byte_letters()


def chunk_starts(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of texts that lie in ``raw`` (UTF-8) one after another."""
    kind = _KIND[raw]
    high = np.flatnonzero(kind == 0)
    if high.size:
        b = [raw[np.minimum(high + k, raw.size - 1)] for k in range(3)]
        two = (b[0] >= 0xC2) & (b[0] <= 0xC9)
        at = high[two]
        point = ((b[0][two] & 0x1F).astype(np.int64) << 6) | (b[1][two] & 0x3F)
        kind[at[_LETTER[point]] + 1] = 1  # the byte before what follows
        blank = at[(point == 0x85) | (point == 0xA0)]
        kind[blank], kind[blank + 1] = 2, 2
        three = (b[0] == 0xE1) & (b[1] == 0x9A) & (b[2] == 0x80)
        three |= (b[0] == 0xE2) & (b[1] == 0x80) & ((b[2] <= 0x8A) | (b[2] == 0xA8) | (b[2] == 0xA9) | (b[2] == 0xAF))
        three |= (b[0] == 0xE2) & (b[1] == 0x81) & (b[2] == 0x9F)
        three |= (b[0] == 0xE3) & (b[1] == 0x80) & (b[2] == 0x80)
        blank = high[three]
        for k in range(3):
            kind[blank + k] = 2
    cut = np.empty(raw.size, bool)
    here, before = kind[1:], kind[:-1]
    cut[1:] = ((here == 2) & (before != 2)) | ((here == 3) & (before == 1))
    cut[text_starts[text_starts < raw.size]] = True
    return np.flatnonzero(cut)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but where a mark might follow: composed, a capital may differ."""
    capital = (raw - np.uint8(65)) < 26
    capital[:-1] &= raw[1:] < 0x80
    return raw + capital.view(np.uint8) * np.uint8(32)


WIDTH = 16


def _keys(chunks: pa.BinaryArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the size of chunks of under WIDTH bytes, as two numbers each: exact. The
    keys of longer chunks are of no use."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks)]
    raw = np.concatenate([np.frombuffer(chunks.buffers()[2] or b"", np.uint8), np.zeros(WIDTH, np.uint8)])
    held = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[offsets]
    held *= np.arange(WIDTH) < sizes[:, None]
    held[:, WIDTH - 1] = np.minimum(sizes, 255)
    two = held.view(np.uint64)
    return two[:, 0], two[:, 1]


class Encoder:
    """``encode`` gives the ids of all texts one after another, and each text's bounds there.

    The cache holds at most ``limit`` chunks of under WIDTH bytes, about 50 bytes each, by an
    order of hashes; when it is full it starts anew. ``lower`` lower-cases most of A-Z first,
    for vocabularies that do so anyway."""

    def __init__(self, path: str, lower: bool = False, limit: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower, self.limit = lower, limit
        self._clear()

    def _clear(self) -> None:
        self.hash, self.a, self.b = (np.zeros(0, np.uint64) for _ in range(3))
        self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.pool, self.n_pool = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk its first place in the pool, to which its ids are added, and their number."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        end = self.n_pool + int(size.sum())
        if end > self.pool.size:
            self.pool = np.concatenate([self.pool, np.zeros(max(end, 2 * self.pool.size) - self.pool.size, np.uint32)])
        self.pool[self.n_pool : end] = np.fromiter(chain.from_iterable(got), np.uint32, end - self.n_pool)
        first = np.cumsum(size) - size + self.n_pool
        self.n_pool = end
        return first, size

    def _find(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct chunk its first place in the pool and its number of ids."""
        n = len(chunks)
        sizes = np.diff(np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + n + 1])
        a, b = _keys(chunks, sizes)
        h = (a ^ (b * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        short = sizes < WIDTH
        if self.hash.size + n > self.limit or self.n_pool > 8 * self.limit:
            self._clear()
        at = np.minimum(np.searchsorted(self.hash, h), max(self.hash.size - 1, 0))
        known = short & (self.hash[at] == h) & (self.a[at] == a) & (self.b[at] == b) if self.hash.size else np.zeros(n, bool)
        first, size = np.empty(n, np.int64), np.empty(n, np.int64)
        first[known], size[known] = self.first[at[known]], self.size[at[known]]
        new = np.flatnonzero(~known)
        if new.size:
            first[new], size[new] = self._learn(chunks.take(pa.array(new)).to_pylist())
            # Of chunks with one hash only one is kept; the others are encoded again.
            keep = new[short[new]]
            keep = keep[np.unique(h[keep], return_index=True)[1]]
            at = np.searchsorted(self.hash, h[keep])
            if self.hash.size:
                free = self.hash[np.minimum(at, self.hash.size - 1)] != h[keep]
                keep, at = keep[free], at[free]
            for name, values in (("hash", h), ("a", a), ("b", b), ("first", first), ("size", size)):
                setattr(self, name, np.insert(getattr(self, name), at, values[keep]))
        return first, size

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        if not raw.size:
            return np.zeros(0, np.uint32), np.zeros(edges.size, np.int64)
        if self.lower:
            raw = lowered(raw)
        starts = chunk_starts(raw, edges[:-1])
        offsets = np.append(starts, raw.size).astype(np.int32)
        chunks = pa.BinaryArray.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = chunks.dictionary_encode()
        first, size = self._find(coded.dictionary)
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(first[code] - (ends - n), n) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, edges)]
        return ids, bounds


_ENCODERS: dict = {}


def encoder(path: str, lower: bool = False, limit: int = 2_000_000) -> Encoder:
    """One encoder for each vocabulary and Python worker, kept from task to task."""
    key = (path, lower, limit)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, lower, limit)
    return _ENCODERS[key]


def slices(texts: list[bytes], most: int = 8_000_000):
    """Index ranges of consecutive texts of about ``most`` bytes together."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
