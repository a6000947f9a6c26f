"""A minimal acyclic automaton over words, numbered so that each word leads to its output ids.

Built from sorted words in one pass; states with equal futures are one state, so suffixes are
shared. Each edge carries how many words come before those through it, so the sum along a word's
path is its number, and the ids sit in one table by that number. The whole thing is one flat file
that readers memory-map (a file in memory: nothing is written to a local folder); lookups walk many words
at once.
"""

from __future__ import annotations

import mmap
import os

import numpy as np


def build(words: list[bytes], ids: list[np.ndarray]) -> bytes:
    """The automaton of distinct words as a flat file; ``ids[i]`` are the output of ``words[i]``."""
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, edges), children first

    def freeze(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # the open states of the last word
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            final, edges = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(final, edges)))

    for i in order:
        word = words[i]
        common = len(os.path.commonprefix([last, word]))
        close(common)
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(*path[0])
    words_below, keys, targets, skips = np.zeros(len(states), np.int64), [], [], []
    for s, (final, edges) in enumerate(states):
        seen = int(final)
        for label, t in edges:
            keys.append(s << 8 | label)
            targets.append(t)
            skips.append(seen)
            seen += int(words_below[t])
        words_below[s] = seen
    ends = np.cumsum([0] + [len(ids[i]) for i in order])
    parts = [np.array(keys, np.int64), np.array(ends, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.concatenate([ids[i] for i in order]).astype(np.int32) if order else np.zeros(0, np.int32), np.array([f for f, _ in states], np.uint8)]
    return np.array([root] + [len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A memory-mapped automaton."""

    def __init__(self, flat: bytes):
        if hasattr(os, "memfd_create"):
            with os.fdopen(os.memfd_create("lexicon"), "wb") as f:
                f.write(flat)
                f.flush()
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            self.map = mmap.mmap(-1, len(flat))
            self.map.write(flat)
        head = np.frombuffer(self.map, np.int64, 7)
        self.root, at = int(head[0]), 56
        arrays = []
        for n, kind in zip(head[1:].tolist(), (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8), strict=True):
            arrays.append(np.frombuffer(self.map, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.keys, self.ends, self.targets, self.skips, self.ids, self.final = arrays

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words outside the lexicon."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        alive = np.flatnonzero(size > 0) if len(self.keys) else np.zeros(0, np.int64)
        number[np.setdiff1d(np.arange(len(words)), alive)] = -1
        step = 0
        while len(alive):
            key = state[alive] << 8 | data[begin[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            number[alive[~ok]] = -1
            alive, at = alive[ok], at[ok]
            number[alive] += self.skips[at]
            state[alive] = self.targets[at]
            step += 1
            over = size[alive] == step
            done = alive[over]
            number[done[self.final[state[done]] == 0]] = -1
            alive = alive[~over]
        return number

    def output(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids, all ids) of the words with these numbers."""
        a, size = self.ends[number], self.ends[number + 1] - self.ends[number]
        end = np.cumsum(size)
        return size, self.ids[np.repeat(a - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)]
