"""Random fields over one image, and the moves that lower their energy, each one cut of an array network.

A field has pixels with unary costs, an edge term (Potts, or truncated linear in the label numbers),
layers of segments, and prices for the presence of a label. A segment takes a label, or is free; its
elements are pixels or segments of the layer below, and it pays for those that disagree until it gives
up. Touching segments of a layer may pay for differing labels, half if one of them is free.

Labels count from 0, the free label of a segment is the number of classes. In the network of a move a
node on the sink side has changed. Element k has two marks: A (it takes the move's label) and B (it
gives up its old one); a pixel's are the same node, a segment that is free already has no B.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from tessera.operators.flow import max_flow

NONE = -1


def _array(x, kind=np.int64) -> np.ndarray:
    return np.asarray(x, kind)


@dataclass
class Layer:
    """Segments: memberships (segment, element, weight), costs of all labels and of the free one (last) per segment, the
    share of disagreement at which a segment gives up, and weights between touching segments (a, b, w)."""

    segment: np.ndarray
    element: np.ndarray
    weight: np.ndarray
    costs: np.ndarray
    truncation: float = 0.5
    touching: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    #: The layer that holds the elements; NONE: they are pixels.
    below: int = NONE

    def __post_init__(self):
        self.segment, self.element, self.weight = _array(self.segment), _array(self.element), _array(self.weight, float)
        self.costs = _array(self.costs, float).reshape(-1, np.shape(self.costs)[-1])
        a, b, w = self.touching
        self.touching = _array(a), _array(b), _array(w, float)
        self.total = np.bincount(self.segment, weights=self.weight, minlength=len(self.costs))

    @property
    def free(self) -> int:
        return self.costs.shape[1] - 1

    def slopes(self, label: np.ndarray) -> np.ndarray:
        """Price of a unit of disagreeing weight in each segment under its label."""
        k = np.arange(len(self.costs))
        return (self.costs[:, -1] - self.costs[k, label]) / np.maximum(self.total * self.truncation, 1e-300)

    def energies(self, chosen: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Costs of the segments, without those between them; ``labels``: of the elements."""
        k = np.arange(len(self.costs))
        against = np.bincount(self.segment, weights=self.weight * (labels[self.element] != chosen[self.segment]), minlength=len(k))
        return np.where(chosen == self.free, self.costs[:, -1], self.costs[k, chosen] + self.slopes(chosen) * against)

    def between(self, chosen: np.ndarray) -> float:
        a, b, w = self.touching
        x, y = chosen[a], chosen[b]
        half = (x == self.free) != (y == self.free)
        return float((w * np.where(x == y, 0.0, np.where(half, 0.5, 1.0))).sum())

    def dominant(self, labels: np.ndarray) -> np.ndarray:
        """For each segment the highest label whose weight exceeds W (1 - T), else the free one."""
        share = np.zeros((len(self.costs), self.free + 1))
        np.add.at(share, (self.segment, labels[self.element]), self.weight)
        won = share[:, : self.free] > (self.total * (1 - self.truncation))[:, None]
        return np.where(won.any(axis=1), self.free - 1 - won[:, ::-1].argmax(axis=1), self.free)


@dataclass
class Field:
    unary: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray
    layers: Sequence[Layer] = ()
    #: Price of each label that occurs at all.
    presence: np.ndarray | None = None
    #: Edges cost w min(|a - b|, truncation) if given, else w where labels differ.
    truncation: float | None = None

    def __post_init__(self):
        self.unary = _array(self.unary, float)
        self.unary = self.unary.reshape(len(self.unary), -1)
        self.u, self.v, self.w = _array(self.u), _array(self.v), _array(self.w, float)

    @property
    def classes(self) -> int:
        return self.unary.shape[1]

    def metric(self, a, b) -> np.ndarray:
        return np.where(a != b, 1.0, 0.0) if self.truncation is None else np.minimum(np.abs(a - b), self.truncation).astype(float)

    def start(self) -> State:
        s = State(np.zeros(len(self.unary), np.int64))
        for layer in self.layers:
            s.chosen.append(layer.dominant(s.of(layer.below)))
        return s

    def energy(self, s: State) -> float:
        x = s.labels
        out = self.unary[np.arange(len(x)), x].sum() + (self.w * self.metric(x[self.u], x[self.v])).sum()
        for layer, chosen in zip(self.layers, s.chosen, strict=True):
            out += layer.energies(chosen, s.of(layer.below)).sum() + layer.between(chosen)
        return float(out + (self.presence[np.unique(x)].sum() if self.presence is not None else 0.0))


@dataclass
class State:
    """Labels of the pixels and of each layer's segments."""

    labels: np.ndarray
    chosen: list[np.ndarray] = field(default_factory=list)

    def of(self, layer: int) -> np.ndarray:
        return self.labels if layer == NONE else self.chosen[layer]


class Network:
    """Nodes and edges of a move as they are put together."""

    def __init__(self):
        self.source, self.sink, self.edges, self.prices, self.n = [], [], [], [], 0

    def nodes(self, changed: np.ndarray, kept: np.ndarray) -> np.ndarray:
        """New nodes with the price of having changed, and of not."""
        self.source.append(np.asarray(changed, float))
        self.sink.append(np.asarray(kept, float))
        self.n += len(changed)
        return np.arange(self.n - len(changed), self.n)

    def keeping(self, node: np.ndarray, price: np.ndarray) -> None:
        """Adds to the price of nodes that do not change; NONE is left out."""
        self.prices.append((node[node >= 0], price[node >= 0]))

    def edge(self, u: np.ndarray, v: np.ndarray, only_v: np.ndarray | float = 0.0, only_u: np.ndarray | float = 0.0) -> None:
        """A price where v has changed and u has not, and one for the reverse."""
        self.edges.append((u, v, np.broadcast_to(only_v, u.shape).astype(float), np.broadcast_to(only_u, u.shape).astype(float)))

    def cut(self) -> np.ndarray:
        """Which nodes change at the least price (any that need not, do not)."""
        if not self.n:
            return np.zeros(0, bool)
        source, sink = np.concatenate(self.source), np.concatenate(self.sink)
        for node, price in self.prices:
            np.add.at(sink, node, price)
        shift = np.minimum(np.minimum(source, sink), 0.0)  # prices may be negative: both ends move alike
        source, sink = source - shift, sink - shift
        u, v, cap, rev = (np.concatenate([e[k] for e in self.edges]) if self.edges else np.zeros(0) for k in range(4))
        finite = source.sum() + sink.sum() + cap[np.isfinite(cap)].sum() + rev[np.isfinite(rev)].sum() + 1.0
        return max_flow(source, sink, u.astype(np.int64), v.astype(np.int64), np.where(np.isfinite(cap), cap, finite), np.where(np.isfinite(rev), rev, finite))[1]


def _pairs(net: Network, a: np.ndarray, b: np.ndarray, both_old: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> None:
    """An edge term by the prices of its states: both keep, only a changes, only b does (both change: nothing). Needs
    both_old <= only_a + only_b. Where one is NONE it has changed already."""
    both = (a >= 0) & (b >= 0)
    x, y, z = both_old[both], only_a[both], only_b[both]
    net.keeping(a[both], x - y)
    net.keeping(b[both], y)
    net.edge(a[both], b[both], only_v=y + z - x)
    net.keeping(a[~both], only_b[~both])
    net.keeping(b[~both], only_a[~both])


def expand(f: Field, s: State, alpha: int) -> State:
    """The best state in which any pixels change to ``alpha``, and segments take ``alpha``, keep their label or become
    free, while all else stays. Segments that have ``alpha`` keep it. With edges truncated linear likewise."""
    net, x = Network(), s.labels
    site = np.flatnonzero(x != alpha)
    node = np.full(len(x), NONE)
    node[site] = net.nodes(f.unary[site, alpha], f.unary[site, x[site]])
    live = (f.w > 0) & ((node[f.u] >= 0) | (node[f.v] >= 0))
    u, v, w = f.u[live], f.v[live], f.w[live]
    _pairs(net, node[u], node[v], w * f.metric(x[u], x[v]), w * f.metric(alpha, x[v]), w * f.metric(x[u], alpha))
    marks: list[tuple[np.ndarray, np.ndarray]] = []
    for layer, c in zip(f.layers, s.chosen, strict=True):
        old = s.of(layer.below)
        below_a, below_b = (node, node) if layer.below == NONE else marks[layer.below]
        n = len(c)
        moves, named = c != alpha, (c != alpha) & (c != layer.free)
        a, b = np.full(n, NONE), np.full(n, NONE)
        most = layer.costs[:, -1]
        # taking alpha costs its own cost and that of elements without it; else at most the free label's
        a[moves] = net.nodes(np.zeros(moves.sum()), (most - layer.costs[:, alpha])[moves])
        b[named] = net.nodes((most - layer.energies(c, old))[named], np.zeros(named.sum()))
        net.edge(a[named], b[named], only_u=np.inf)
        seg, element, weight = layer.segment, layer.element, layer.weight
        to_alpha = layer.slopes(np.full(n, alpha))[seg] * weight
        ea, eb = below_a[element], below_b[element]
        k = (c[seg] == alpha) & (ea >= 0)
        net.keeping(ea[k], to_alpha[k])
        k = moves[seg] & (ea >= 0)
        net.edge(a[seg[k]], ea[k], only_u=to_alpha[k])
        k = named[seg] & (old[element] == c[seg]) & (eb >= 0)
        net.edge(b[seg[k]], eb[k], only_v=(layer.slopes(np.where(c == alpha, layer.free, c))[seg] * weight)[k])
        p, q, t = layer.touching
        if len(p):
            half, same = t / 2, c[p] == c[q]
            both = (a[p] >= 0) & (a[q] >= 0)
            net.edge(a[p][both], a[q][both], half[both], half[both])
            net.keeping(a[p][~both], half[~both])
            net.keeping(a[q][~both], half[~both])
            together = same & (b[p] >= 0) & (b[q] >= 0)
            net.edge(b[p][together], b[q][together], half[together], half[together])
            net.keeping(b[p][~same], half[~same])
            net.keeping(b[q][~same], half[~same])
        marks.append((a, b))
    if f.presence is not None:
        there = np.unique(x[site])
        gone = np.full(f.classes, NONE)
        gone[there] = net.nodes(np.zeros(len(there)), f.presence[there])
        net.edge(node[site], gone[x[site]], only_v=np.inf)  # a label is gone only if all its pixels have changed
        if not (x == alpha).any():
            new = net.nodes(np.array([f.presence[alpha]]), np.zeros(1))
            net.edge(np.repeat(new, len(site)), node[site], only_v=np.inf)
    changed = net.cut()
    has = lambda m: (m >= 0) & changed[np.maximum(m, 0)] if len(changed) else np.zeros(len(m), bool)
    out = State(np.where(has(node), alpha, x))
    for layer, c, (a, b) in zip(f.layers, s.chosen, marks, strict=True):
        out.chosen.append(np.where(has(a), alpha, np.where(has(b), layer.free, c)))
    return out


def expand_range(f: Field, s: State, low: int, size: int) -> State:
    """A range move for truncated linear edges: any pixels take labels low ... low + size - 1, all others stay. Pixel i
    has a chain of ``size`` nodes; node k has changed if its new label is low + k or more, node 0 if it changes at
    all. Inside the range edges cost their label difference; towards a pixel that stays, a bound that is exact at
    ``low``. So the energy never rises, and does not do so by less than the cut says. Segment layers are not moved
    here: use it on fields without them."""
    net, x = Network(), s.labels
    n, size = len(x), min(size, f.classes - low)
    new = f.unary[:, low : low + size]
    chain = [net.nodes(new[:, 0], f.unary[np.arange(n), x])]
    for k in range(1, size):
        chain.append(net.nodes(new[:, k] - new[:, k - 1], np.zeros(n)))
        net.edge(chain[k - 1], chain[k], only_v=np.inf)
    live = f.w > 0
    u, v, w = f.u[live], f.v[live], f.w[live]
    _pairs(net, chain[0][u], chain[0][v], w * f.metric(x[u], x[v]), w * f.metric(low, x[v]), w * f.metric(x[u], low))
    for k in range(1, size):
        net.edge(chain[k][u], chain[k][v], w, w)
    changed = net.cut()
    steps = sum(changed[c].astype(np.int64) for c in chain)
    return State(np.where(steps > 0, low + steps - 1, x), list(s.chosen))


def solve(f: Field, sweeps: int = 4, size: int = 1, start: State | None = None) -> tuple[State, list[float]]:
    """(state, energies): moves to every label, or to every range of ``size`` labels, until a whole round changes
    nothing, ``sweeps`` rounds at most."""
    s = start or f.start()
    trail, still = [f.energy(s)], 0
    moves = f.classes if size == 1 else max(1, f.classes - size + 1)
    for _ in range(sweeps):
        for k in range(moves):
            new = expand(f, s, k) if size == 1 else expand_range(f, s, k, size)
            now = f.energy(new)
            if now < trail[-1] - 1e-9 * max(1.0, abs(trail[-1])):
                s, still = new, 0
                trail.append(now)
            still += 1
            if still >= moves:
                return s, trail
    return s, trail


@dataclass
class Joint:
    """Objects and sensor labels on the same pixels: an edge costs weight (1 + cross disparity delta) where objects
    differ, plus disparity delta, with delta = min(|m - m'|, most) of the sensor labels."""

    objects: np.ndarray
    sensor: np.ndarray
    u: np.ndarray
    v: np.ndarray
    weight: np.ndarray
    most: float
    disparity: float
    cross: float

    def delta(self, m: np.ndarray) -> np.ndarray:
        return np.minimum(np.abs(m[self.u] - m[self.v]), self.most).astype(float)

    def energy(self, o: np.ndarray, m: np.ndarray) -> float:
        k, d = np.arange(len(o)), self.delta(m)
        edges = np.where(o[self.u] != o[self.v], self.weight * (1 + self.cross * self.disparity * d), 0.0) + self.disparity * d
        return float(self.objects[k, o].sum() + self.sensor[k, m].sum() + edges.sum())


def solve_joint(j: Joint, sweeps: int = 4, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(object labels, sensor labels, energies): each domain is solved in turn with the other as it stands, the objects
    first without the coupling, until neither changes. Sensor labels move by ranges as long as the truncation."""
    m = np.zeros(len(j.sensor), np.int64)
    o, trail = None, []
    for _ in range(rounds):
        d = j.delta(m) if o is not None else np.zeros(len(j.u))
        f = Field(j.objects, j.u, j.v, j.weight * (1 + j.cross * j.disparity * d))
        new_o = solve(f, sweeps, start=State(o) if o is not None else None)[0].labels
        differ = new_o[j.u] != new_o[j.v]
        f = Field(j.sensor, j.u, j.v, j.disparity * (1 + j.cross * j.weight * differ), truncation=j.most)
        new_m = solve(f, sweeps, size=max(1, min(int(j.most) + 1, f.classes)), start=State(m))[0].labels
        trail.append(j.energy(new_o, new_m))
        if o is not None and (new_o == o).all() and (new_m == m).all():
            break
        o, m = new_o, new_m
    return o, m, trail
