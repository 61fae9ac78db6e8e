"""Word and n-gram hashes of whole texts, computed on the UTF-8 bytes with numpy.

A word is a run of digits, ASCII letters (lower-cased) and non-ASCII
characters.  In UTF-8 that is a class of bytes, so word ends, lower-casing
and hashing are array operations over a block of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

U = np.uint64

# byte -> lower-cased byte of a word, or 0 for a separator
FOLD = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    FOLD[_b] = _b + 32

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
GRAM = U(0xD1342543DE82EF95)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, key: str, n: int) -> np.ndarray:
    t = _powers.get(key)
    if t is None or len(t) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base & ((1 << 64) - 1), U)
        steps[0] = 1
        t = _powers[key] = np.cumprod(steps, dtype=U)
    return t[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into blocks of about `size` bytes of whole texts.

    Yields (first row, end row, bytes, text offsets within the bytes).  A text
    longer than `size` is a block of its own.  Null reads as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a block of texts: byte ranges, text number and hash of each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        n = len(data)
        self.n_texts = len(offs) - 1
        self.low = low = FOLD[data]
        inside = low != 0
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        firsts = offs[:-1][offs[:-1] < n]
        before[firsts] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[firsts[firsts > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(offs, self.start, side="right") - 1
        total = np.zeros(n + 1, U)
        np.cumsum(low * _power_table(BASE, "p", n), dtype=U, out=total[1:])
        h = (total[self.end] - total[self.start]) * _power_table(INVERSE, "i", n + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.doc, np.arange(self.n_texts + 1))

    def __len__(self) -> int:
        return len(self.start)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1, lower-cased, joined by single spaces."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True))

    @cached_property
    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, lower-cased, each with a space after it, and where each begins (and the last ends)."""
        size = self.end - self.start
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=at[1:])
        out = np.full(at[-1], 0x20, np.uint8)
        # the words' bytes in a row, each word moved on by the spaces before it
        out[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = self.low[self.low != 0]
        return out.tobytes(), at

    def texts(self, i: np.ndarray, j: np.ndarray) -> list[bytes]:
        """text(i, j) of each of many ranges."""
        raw, at = self.joined
        return [raw[a:b] for a, b in zip(at[i].tolist(), (at[j] - (j > i)).tolist(), strict=True)]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are of one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U), np.zeros(0, bool)
        g = self.hash[:m].copy()
        for k in range(1, n):
            g *= GRAM
            g += self.hash[k : k + m]
        return mix(g), self.doc[:m] == self.doc[n - 1 :]


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-word shingle hashes and their text numbers, in text order.

    A text of fewer words, but not none, has one shingle: all its words.
    """
    g, ok = w.grams(n)
    g, doc = g[ok], w.doc[: len(ok)][ok]
    counts = w.count()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return g, doc
    extra = []
    for d in short.tolist():
        h = U(counts[d])
        with np.errstate(over="ignore"):
            for x in w.hash[w.first[d] : w.first[d + 1]]:
                h = h * GRAM + x
        extra.append(h)
    g = np.concatenate([g, mix(np.array(extra, U))])
    doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    return g[order], doc[order]
