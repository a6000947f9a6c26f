"""Maximum flow on arrays: push-relabel in which all active nodes push and rise together.

A network is a table of arcs sorted by tail. Each round every active node spreads its excess over its
admissible arcs at once (prefix sums over its arcs), and those that found none rise; heights are the
exact distances to the sink again after every few rounds (a breadth-first search, a level at a
time). No arc is admissible in both directions under the same heights, so the pushes of a round do not
collide. An image of 376 x 1242 pixels is a few hundred rounds of array operations.
"""

from __future__ import annotations

import numpy as np


class Arcs:
    """Edges (u, v, capacity, reverse capacity) as arcs sorted by tail."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, cap: np.ndarray, rev: np.ndarray):
        m = len(u)
        tail = np.concatenate([u, v])
        order = np.argsort(tail, kind="stable")
        place = np.empty(2 * m, np.int64)
        place[order] = np.arange(2 * m)
        self.tail, self.head = tail[order], np.concatenate([v, u])[order]
        self.cap = np.concatenate([cap, rev]).astype(float)[order]
        self.mate = place[(order + m) % max(2 * m, 1)]
        self.start = np.searchsorted(self.tail, np.arange(n + 1))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(arcs of the nodes one after the other, where each node's begin and end)."""
        a, size = self.start[nodes], self.start[nodes + 1] - self.start[nodes]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        return np.repeat(a - (stop - size), size) + np.arange(total), np.concatenate([[0], stop])


def _distances(arcs: Arcs, to_sink: np.ndarray, tiny: float) -> np.ndarray:
    """Residual distance of every node to the sink; nodes + 1 where there is no way."""
    n = len(to_sink)
    far = np.full(n, n + 1, np.int64)
    front, level = np.flatnonzero(to_sink > tiny), 1
    far[front] = 1
    while len(front):
        level += 1
        out, _ = arcs.of(front)
        into = arcs.head[out[arcs.cap[arcs.mate[out]] > tiny]]
        front = np.unique(into[far[into] > n])
        far[front] = level
    return far


def max_flow(source: np.ndarray, sink: np.ndarray, u: np.ndarray, v: np.ndarray, cap: np.ndarray, rev: np.ndarray, every: int = 24) -> tuple[float, np.ndarray]:
    """(flow, whether each node is on the sink side): nodes that can still reach the sink are, all others stay with
    the source. ``source`` and ``sink``: capacities of each node's links to them."""
    source, sink = np.asarray(source, float), np.asarray(sink, float)
    u, v = np.asarray(u, np.int64), np.asarray(v, np.int64)
    n = len(source)
    least = np.minimum(source, sink)
    excess, to_sink, flow = source - least, sink - least, float(least.sum())
    arcs = Arcs(n, u, v, np.asarray(cap, float), np.asarray(rev, float))
    tiny = 1e-13 * max(1.0, excess.max(initial=0.0), to_sink.max(initial=0.0), arcs.cap.max(initial=0.0))
    height, rounds = _distances(arcs, to_sink, tiny), 0
    while True:
        active = np.flatnonzero((excess > tiny) & (height <= n))
        if not len(active):
            break
        last = active[(height[active] == 1) & (to_sink[active] > tiny)]
        if len(last):
            d = np.minimum(excess[last], to_sink[last])
            excess[last] -= d
            to_sink[last] -= d
            flow += float(d.sum())
            active = active[excess[active] > tiny]
        out, edge = arcs.of(active)
        owner = np.repeat(np.arange(len(active)), np.diff(edge))
        good = np.flatnonzero((arcs.cap[out] > tiny) & (height[arcs.head[out]] + 1 == height[active][owner]))
        if len(good):
            a, o = out[good], owner[good]
            c = arcs.cap[a]
            before = np.cumsum(c) - c
            first = np.concatenate([[True], o[1:] != o[:-1]])
            before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(o))))
            push = np.clip(excess[active][o] - before, 0.0, c)
            arcs.cap[a] -= push
            arcs.cap[arcs.mate[a]] += push
            excess -= np.bincount(active[o], weights=push, minlength=n)
            excess += np.bincount(arcs.head[a], weights=push, minlength=n)
        rounds += 1
        if rounds % every == 0:
            height = _distances(arcs, to_sink, tiny)
            continue
        # nodes with excess left have no admissible arc any more: they rise to just above their lowest neighbour
        up = np.where(arcs.cap[out] > tiny, height[arcs.head[out]] + 1, n + 1)
        lowest = np.full(len(active), n + 1)
        has = np.flatnonzero(np.diff(edge))
        if len(has):
            lowest[has] = np.minimum.reduceat(up, edge[:-1][has])
        lowest = np.where(to_sink[active] > tiny, 1, lowest)
        rise = excess[active] > tiny
        height[active[rise]] = np.maximum(height[active[rise]], np.minimum(lowest[rise], n + 1))
    return flow, _distances(arcs, to_sink, tiny) <= n
