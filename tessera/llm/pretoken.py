"""Vectorised pre-tokenization: texts to words by the two public split patterns, over code points.

The classes of code points (letter, number, white space, other) are asked from the tokenizers
library itself, so they are those of its regular-expression engine.
"""

from __future__ import annotations

import numpy as np

from tessera.llm import vec

OTHER, LETTER, NUMBER, SPACE = range(4)
APOSTROPHE = 39
#: What may follow an apostrophe as one word in either pattern.
ONE = np.zeros(0x110000, bool)
ONE[[ord(c) for c in "stmd"]] = True
TWO = ("re", "ve", "ll")


def class_table() -> np.ndarray:
    """The class of every code point."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for _, (a, b) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[points[a:b]] = kind
    return table


def decode(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets in them, byte position of each and of the end)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offs, np.arange(len(data) + 1)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return points, np.searchsorted(at, offs), at


def _runs(points: np.ndarray, offs: np.ndarray, kinds: np.ndarray):
    n = len(points)
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = kinds[1:] != kinds[:-1]
    border = np.zeros(n + 1, bool)
    border[offs] = True
    cut |= border
    at = np.flatnonzero(cut)
    return cut, border, at[:-1], at[1:]


def _contract(cut, border, points, kinds, s, e, free: np.ndarray) -> None:
    """Move the cut after a lone apostrophe behind the ending that belongs to it."""
    k = np.flatnonzero(free & (e - s == 1) & (points[s] == APOSTROPHE))
    k = k[(k + 1 < len(s)) & ~border[e[k]]]
    k = k[kinds[e[k]] == LETTER]
    if not len(k):
        return
    at, size = e[k], (e - s)[k + 1]
    x, y = points[at], points[np.minimum(at + 1, len(points) - 1)]
    n = ONE[x].astype(np.int64)
    for a, b in TWO:
        n[(size > 1) & (x == ord(a)) & (y == ord(b))] = 2
    at, n = at[n > 0], n[n > 0]
    cut[at] = False
    cut[at + n] = True


def split_bytes(points: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the byte-level pattern: a space joins the word after it; nothing is dropped."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = table[points]
    cut, border, s, e = _runs(points, offs, kinds)
    white = kinds[s] == SPACE
    inner = white & ~border[e]  # white space with more text after it
    joins = inner & (points[e - 1] == 32)
    taken = np.zeros(len(s), bool)
    taken[1:] = joins[:-1]
    cut[e[joins]] = False
    cut[e[inner] - 1] = True
    _contract(cut, border, points, kinds, s, e, ~white & ~taken)
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def split_words(points: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the pattern that drops white space and takes each digit alone (lower-cased text)."""
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds = table[points]
    cut, border, s, e = _runs(points, offs, kinds)
    _contract(cut, border, points, kinds, s, e, kinds[s] == OTHER)
    cut[:-1] |= kinds == NUMBER
    at = np.flatnonzero(cut)
    word = kinds[at[:-1]] != SPACE
    return at[:-1][word], at[1:][word]


class WordTable:
    """Open-addressed table of hashed words, each with a list of ids; lookups are vectorised."""

    def __init__(self, bits: int = 18, limit: int = 1_000_000):
        self.limit, self.first_bits = limit, bits
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self._room(self.first_bits)
        self.ptr, self.flat = np.zeros(1025, np.int64), np.zeros(4096, np.int32)

    def _room(self, bits: int) -> None:
        self.mask = vec.U64((1 << bits) - 1)
        self.key, self.check, self.val = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Numbers of the words, -1 for those not here."""
        slot = (h & self.mask).astype(np.int64)
        k = self.key[slot]
        good = (k == h) & (self.check[slot] == c)
        out = np.where(good, self.val[slot], -1)
        todo = np.flatnonzero(~good & (k != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & int(self.mask)
            k = self.key[slot]
            good = (k == h[todo]) & (self.check[slot] == c[todo])
            out[todo[good]] = self.val[slot[good]]
            more = ~good & (k != 0)
            todo, slot = todo[more], slot[more]
        return out

    def _place(self, h, c, val) -> None:
        slot, todo = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(todo):
            s = slot[todo]
            free = self.key[s] == 0
            self.key[s[free]] = h[todo[free]]
            won = free & (self.key[s] == h[todo])
            self.check[s[won]], self.val[s[won]] = c[todo[won]], val[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & int(self.mask)

    def add(self, h: np.ndarray, c: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Add distinct words; returns their numbers."""
        n, used = self.n + len(h), int(self.ptr[self.n])
        if 4 * n > 3 * len(self.key):
            full = self.key != 0
            old = self.key[full], self.check[full], self.val[full]
            self._room(max((4 * n // 3).bit_length(), self.first_bits))
            self._place(*old)
        if n >= len(self.ptr):
            self.ptr = np.resize(self.ptr, n + n // 2 + 1)
        if used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, (used + len(flat)) * 3 // 2)
        val = np.arange(self.n, n, dtype=np.int32)
        self.ptr[self.n + 1 : n + 1] = used + np.cumsum(lens)
        self.flat[used : used + len(flat)] = flat
        self._place(h, c, val)
        self.n = n
        return val

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the words one after the other, how many ids each word has)."""
        a, b = self.ptr[number], self.ptr[number + 1]
        return self.flat[vec.gather(a, b)], b - a

    def numbers(self, h: np.ndarray, c: np.ndarray, ids_of) -> np.ndarray:
        """Numbers of all words; ``ids_of(rows)`` gives (lens, ids) of rows with new words."""
        h = np.where(h == 0, vec.U64(1), h)
        number = self.find(h, c)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            _, first, inverse = np.unique(h[miss] + c[miss] * vec.U64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
            rows = miss[first]
            number[miss] = self.add(h[rows], c[rows], *ids_of(rows))[inverse]
        return number

    def encode(self, h: np.ndarray, c: np.ndarray, ids_of) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the words one after the other, how many ids each word has)."""
        if self.n > self.limit:
            self.clear()
        return self.ids(self.numbers(h, c, ids_of))
