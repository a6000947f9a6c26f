"""Vectorised word work on Arrow string columns.

Texts stay what Arrow holds: one byte buffer and offsets. Words are found with a byte mask and
hashed with prefix sums of a polynomial modulo 2**64, so the cost is a few passes over the bytes
and no Python object per word. Two independent hashes make a 128-bit identity where one is not
enough. UTF-8 makes this exact: every byte of a non-ASCII code point is 0x80 or more.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL(None)
except OSError:  # no C library to ask
    _LIBC = None
#: Bytes hashed at a time: the eight-byte arrays over them stay in cache.
CHUNK = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_mask(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes outside the given inclusive ranges."""
    m = np.ones(256, bool)
    for a, b in excluded:
        m[a : b + 1] = False
    return m


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_mask([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (texts are in lower case by then)
ALNUM = byte_mask([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


class Hasher:
    """Polynomial hash of ranges of bytes (or other small numbers), by prefix sums modulo 2**64."""

    def __init__(self, seed: int, letters: int = 256):
        rng = np.random.default_rng([seed, letters])
        self.of_byte = rng.integers(1, 2**63, letters, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        self.base = int(rng.integers(1, 2**60)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.pow = self.inv = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            size = max(n, CHUNK + 1)
            for name, b in (("pow", self.base), ("inv", self.inverse)):
                a = np.full(size, U64(b))
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``data[starts:ends]``; equal byte strings have equal hashes wherever they lie."""
        n = len(data)
        self._grow(n + 1)
        c = np.empty(n + 1, U64)
        c[0] = 0
        np.cumsum(self.of_byte[data] * self.pow[:n], out=c[1:])
        h = (c[ends] - c[starts]) * self.inv[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of the 64-bit hash: all bits depend on all."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


_HASHERS: dict[tuple[int, int], Hasher] = {}


def hasher(seed: int = 1, letters: int = 256) -> Hasher:
    if (seed, letters) not in _HASHERS:
        _HASHERS[seed, letters] = Hasher(seed, letters)
    return _HASHERS[seed, letters]


def gather(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after the other."""
    size = ends - starts
    stop = np.cumsum(size)
    return np.repeat(starts - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


_CACHES: list[dict] = []


def cache() -> dict:
    """A worker's cache that outlives its tasks, until a task of another operator needs the room."""
    _CACHES.append({})
    return _CACHES[-1]


def drop_caches() -> None:
    for c in _CACHES:
        c.clear()


def tidy(run, keeps: bool = False):
    """``run`` (batches to batches), giving what it has freed back to the system when its task ends; it drops the
    worker's caches when it begins, unless it ``keeps`` them."""

    def tidied(batches):
        if not keeps:
            drop_caches()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes; a longer text comes alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a text's border ends a run."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = mask.copy()
    s[1:] &= ~mask[:-1]
    e = mask.copy()
    e[:-1] &= ~mask[1:]
    inner = offs[(offs > 0) & (offs < n)]
    s[inner] = mask[inner]
    e[inner - 1] = mask[inner - 1]
    return np.flatnonzero(s), np.flatnonzero(e) + 1


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: entry i counts those that begin before byte i."""
    c = np.empty(len(data) + 1, np.int64)
    c[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=c[1:])
    return c
