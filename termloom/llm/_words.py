"""Words and word n-grams of many texts at once, in numpy.

A chunk of texts becomes one byte buffer; words are found by a byte class, and every word gets a 64-bit
hash from one prefix sum over the buffer. Nothing here loops over words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_B, _G = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SPACE = np.ones(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n or more."""
    if base not in _POW or len(_POW[base][0]) < n:
        m = max(1 << 16, 1 << int(n - 1).bit_length())
        one = np.ones(m, U)
        one[1:] = U(base)
        inv = np.ones(m, U)
        inv[1:] = U(pow(base, -1, 2**64))
        _POW[base] = np.cumprod(one), np.cumprod(inv)
    p, q = _POW[base]
    return p[:n], q[:n]


class Words:
    """Words of ``texts`` (bytes). ``hash``, ``doc``, ``start``, ``end`` by word; ``first[d]:first[d + 1]`` are the words of text d."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        inside = SPACE[self.buf]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.start, self.end = edge[::2], edge[1::2]
        p, q = _powers(_B, len(self.buf) + 1)
        h = np.zeros(len(self.buf) + 1, U)
        np.cumsum((self.buf.astype(U) + U(1)) * p[: len(self.buf)], out=h[1:])
        self.hash = mix((h[self.end] - h[self.start]) * q[self.start])
        stop = np.cumsum(size)
        self.first = np.concatenate([[0], np.searchsorted(self.start, stop, "left")]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of every n-gram that lies in one text."""
        at, h = ngrams(self.hash, n)
        same = self.doc[: len(at)] == self.doc[n - 1 :][: len(at)]
        return at[same], h[same]

    def text(self, a: int, b: int) -> bytes:
        return self.buf[self.start[a] : self.end[b - 1]].tobytes()


def ngrams(word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every run of n words in an array of word hashes."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    if n == 1:
        return np.arange(m), word
    p, q = _powers(_G, len(word) + 1)
    h = np.zeros(len(word) + 1, U)
    np.cumsum(word * p[: len(word)], out=h[1:])
    return np.arange(m), mix((h[n:] - h[:-n]) * q[:m])
