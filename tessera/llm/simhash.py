"""SimHash near-deduplication with pivot distance tables.

Fingerprints are 64-bit majority votes of the XXH64 of all word shingles, computed over Arrow
buffers. Equal fingerprints collapse to one node (its smallest doc_id) before anything is joined, so
copies never meet as pairs. Nodes that differ in few bits agree on whole blocks of bits, so they
share a key in some table of kept blocks. The pivot distance table is computed once and stored with the
nodes: each node's Hamming distances to 16 reference fingerprints, four bits each (distances below 24
and above 39 count as those, which makes no difference larger). Within a key it discards pairs whose largest
coordinate difference exceeds the radius (triangle inequality), and the survivors are verified. Long runs
of a key emit a spanning forest, found by a search that removes what it has reached, in place of all
their pairs; runs past ``HOT_RUN`` are dealt out again on so many further blocks that a key leaves
``FREE_BITS`` bits open, so no run is longer than about 2**FREE_BITS distinct prints. Links become
components by alternating large-star and small-star steps; a node with very many links is joined by
broadcast.

Defined results: null or wordless text has fingerprint zero, linked like any other; a row without
doc_id joins no component (null); repeated rows are answered once each; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vec
from tessera.llm.shared import drop_path, join_heavy, keep, row_key, table, without

U64 = np.uint64
SEED = 42
RADIUS = 3
SHINGLE = 3
#: Reference fingerprints, and the least distance to one that is told apart.
PIVOTS, NEAREST = 16, 24
#: Runs up to this length compare all their pairs at once; past HOT_RUN they are dealt out again.
SHORT_RUN, HOT_RUN, FREE_BITS = 16, 4096, 12
#: XXH64's primes.
P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Shingles past this many bytes go to the xxhash library one by one.
LONG_BYTES = 4096


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64_same_length(read8, read4, data, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the ``n`` bytes at each of ``at``."""
    with np.errstate(over="ignore"):
        s, done = U64(seed), 0
        if n >= 32:
            v = [np.full(len(at), s + P1 + P2), np.full(len(at), s + P2), np.full(len(at), s), np.full(len(at), s - P1)]
            while done + 32 <= n:
                for k in range(4):
                    v[k] = _round(v[k], read8[at + done + 8 * k])
                done += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                h = (h ^ _round(np.zeros_like(x), x)) * P1 + P4
        else:
            h = np.full(len(at), s + P5)
        h += U64(n)
        while done + 8 <= n:
            h = _rotl(h ^ _round(np.zeros_like(h), read8[at + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= n:
            h = _rotl(h ^ (read4[at + done].astype(U64) * P1), 23) * P2 + P3
            done += 4
        while done < n:
            h = _rotl(h ^ (data[at + done].astype(U64) * P5), 11) * P1
            done += 1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        return h ^ (h >> U64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges, those of one length together."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    read8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    read4 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    out = np.empty(len(starts), U64)
    size = ends - starts
    order = np.argsort(np.minimum(size, LONG_BYTES + 1).astype(np.uint16), kind="stable")
    cut = np.searchsorted(size[order], np.arange(LONG_BYTES + 2))
    for n in np.flatnonzero(np.diff(cut)).tolist():
        rows = order[cut[n] : cut[n + 1]]
        out[rows] = xxh64_same_length(read8, read4, data, starts[rows], n, seed)
    if cut[-1] < len(order):
        import xxhash

        for k in order[cut[-1] :].tolist():
            out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return out


def simhash(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of texts (ASCII lower case, words between white space, joined by one space)."""
    d = vec.LOWER[data]
    m = vec.NOT_SPACE[d]
    s, e = vec.spans(m, offs)
    n_docs = len(offs) - 1
    fp = np.zeros(n_docs, U64)
    if not len(s):
        return fp
    first = np.concatenate([[0], np.searchsorted(s, offs[1:])])
    kept = m.copy()
    kept[1:] |= m[:-1]  # what follows each word becomes its one space
    d[~m] = 0x20
    new = np.cumsum(kept) - 1
    d, s, e = d[kept], new[s], new[e - 1] + 1
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(n_docs), count)
    begin = np.cumsum(count) - count
    at = first[doc] + np.arange(len(doc)) - begin[doc]
    h = xxh64(d, s[at], e[np.minimum(at + shingle, first[doc + 1]) - 1])
    full = np.flatnonzero(count)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ends = (begin + count)[full].tolist()
    votes = np.stack([bits[i:j].sum(axis=0, dtype=np.int32) for i, j in zip(begin[full].tolist(), ends, strict=True)])
    fp[full] = np.packbits(votes * 2 > count[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return fp


def _fingerprints(batches):
    for rb in batches:
        data, offs = vec.text_buffer(rb.column(1))
        fp = [simhash(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in vec.chunks(offs)]
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.concatenate(fp or [np.zeros(0, U64)]).view(np.int64)), rb.column(2)], names=["doc_id", "fp", "row"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"), row_key(id_col, text_col)).mapInArrow(vec.tidy(_fingerprints), "doc_id bigint, fp bigint, row bigint")


# --- candidate keys ------------------------------------------------------------------------------


def block_masks(bits: list[int], blocks: int, kept: int) -> list[int]:
    """Masks of every choice of ``kept`` out of ``blocks`` blocks of the given bit positions."""
    cut = [round(len(bits) * k / blocks) for k in range(blocks + 1)]
    one = [sum(1 << b for b in bits[cut[k] : cut[k + 1]]) for k in range(blocks)]
    return [sum(c) for c in combinations(one, kept)]


def level_masks(n: int, radius: int = RADIUS) -> list[int]:
    """First-level tables: enough kept blocks that random keys hold few of ``n`` nodes."""
    kept = next(k for k in range(1, 64) if n <= 1 << (64 * k // (radius + k)) or k == 5)
    return block_masks(list(range(64)), radius + max(2, kept), max(2, kept))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    return nodes.select(F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks))).alias("t", "key"), "fp", "pivots", "node")


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**63, n, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference fingerprint, packed four bits each into one number."""
    d = np.clip(np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int64) - NEAREST, 0, 15).astype(U64)
    return np.bitwise_or.reduce(d << (U64(4) * np.arange(len(pivots), dtype=U64)), axis=1) if len(fp) else np.zeros(0, U64)


def coordinates(packed: np.ndarray) -> np.ndarray:
    """Rows of distances from packed ones."""
    raw = np.ascontiguousarray(packed).view(np.uint8).reshape(len(packed), 8)
    return np.concatenate([raw & 15, raw >> 4], axis=1).astype(np.int8)


def _pivot_rows(batches):
    pivots = reference_fingerprints()
    for rb in batches:
        fp = rb.column(0).to_numpy(zero_copy_only=False).view(U64)
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(pivot_table(fp, pivots).view(np.int64))], names=["fp", "node", "pivots"])


def with_pivots(nodes: DataFrame) -> DataFrame:
    """``nodes`` (fp, node) with their stored distances to the pivots."""
    return keep(nodes.select("fp", "node").mapInArrow(_pivot_rows, "fp bigint, node bigint, pivots bigint"), "pivot-table")[0]


def run_pairs(run: np.ndarray, fp: np.ndarray, dist: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside short runs (rows sorted by run)."""
    a, b = [], []
    for gap in range(1, SHORT_RUN):
        i = np.flatnonzero(run[gap:] == run[:-gap])
        if not len(i):
            break
        i = i[np.abs(dist[i] - dist[i + gap]).max(axis=1) <= radius]
        i = i[np.bitwise_count(fp[i] ^ fp[i + gap]) <= radius]
        a.append(i)
        b.append(i + gap)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(a), cat(b)


def run_forest(fp: np.ndarray, dist: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one run."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.flatnonzero(np.abs(dist[left] - dist[x]).max(axis=1) <= radius)
            near = near[np.bitwise_count(fp[left[near]] ^ fp[x]) <= radius]
            if len(near):
                hit = left[near]
                a.append(np.full(len(hit), x))
                b.append(hit)
                queue += hit.tolist()
                left = np.delete(left, near)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(a), cat(b)


PAIR_SCHEMA = "a bigint, b bigint, t int, key bigint, fp bigint, pivots bigint"


def _pairs(radius: int, hot: int | None):
    """Rows sorted by (t, key) -> links (a, b), or rows of overlong runs to deal out again (b null)."""

    def out(a, b, t=None, key=None, fp=None, pivots=None):
        n = len(a)
        cols = [pa.array(a), pa.array(b) if b is not None else pa.nulls(n, pa.int64()), pa.array(t) if t is not None else pa.nulls(n, pa.int32()), *(pa.array(x) if x is not None else pa.nulls(n, pa.int64()) for x in (key, fp, pivots))]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "t", "key", "fp", "pivots"])

    def links(t, key, fp, pivots, node):
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(t)))
        run = np.repeat(np.arange(len(at)), size)
        u = fp.view(U64)
        short = np.flatnonzero((size[run] > 1) & (size[run] <= SHORT_RUN))
        if len(short):
            i, j = run_pairs(run[short], u[short], coordinates(pivots[short]), radius)
            if len(i):
                yield out(node[short[i]], node[short[j]])
        for k in np.flatnonzero(size > SHORT_RUN).tolist():
            r = slice(at[k], at[k] + size[k])
            if hot and size[k] > hot:
                yield out(node[r], None, t[r], key[r], fp[r], pivots[r])
            else:
                i, j = run_forest(u[r], coordinates(pivots[r]), radius)
                yield out(node[r][i], node[r][j])

    def run(batches):
        held, deferred = None, None
        for rb in batches:
            cols = [rb.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp", "pivots", "node")]
            if not len(cols[0]):
                continue
            if deferred is not None:  # the rest of a run that was too long already
                n = int(np.argmin(np.append((cols[0] == deferred[0]) & (cols[1] == deferred[1]), False)))
                if n:
                    yield out(cols[4][:n], None, *(c[:n] for c in cols[:4]))
                cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                deferred = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            t, key = cols[0], cols[1]
            last = int(np.argmin(np.append(((t == t[-1]) & (key == key[-1]))[::-1], False)))
            done, held = [c[: len(t) - last] for c in cols], [c[len(t) - last :] for c in cols]
            if len(done[0]):
                yield from links(*done)
            if hot and last > hot:
                yield out(held[4], None, *held[:4])
                deferred, held = (held[0][0], held[1][0]), None
        if held is not None:
            yield from links(*held)

    return run


def linked(nodes: DataFrame, n: int, radius: int = RADIUS, hot: int = HOT_RUN) -> list[tuple[DataFrame, str]]:
    """Links (a, b) between nodes within ``radius``: every such pair is connected through them."""
    nodes = with_pivots(nodes)
    masks = level_masks(n, radius)
    parts = lambda df: df.repartition("t", "key").sortWithinPartitions("t", "key")
    first, path = keep(parts(keyed(nodes, masks)).mapInArrow(_pairs(radius, hot), PAIR_SCHEMA), "simhash-links")
    found = [(first.where(F.col("b").isNotNull()).select("a", "b"), path)]
    again = first.where(F.col("b").isNull())
    if not again.isEmpty():
        sub = []
        for t, m in enumerate(masks):  # the bits that this table left free, in blocks of which ``radius`` hold few bits
            free = [b for b in range(64) if not m >> b & 1]
            blocks = max(2 * radius, -(-len(free) * radius // FREE_BITS))
            keys = F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m | s))) for s in block_masks(free, blocks, blocks - radius)))
            sub.append(F.when(F.col("t") == t, keys))
        finer = again.select(F.posexplode(F.coalesce(*sub)).alias("s", "key"), (F.col("t") * 1000).alias("base"), "fp", "pivots", F.col("a").alias("node")).select((F.col("base") + F.col("s")).cast("int").alias("t"), "key", "fp", "pivots", "node")
        more, path = keep(parts(finer).mapInArrow(_pairs(radius, None), PAIR_SCHEMA), "simhash-links2")
        found.append((more.select("a", "b"), path))
    return found


# --- components ----------------------------------------------------------------------------------


def _contract(batches):
    """Links of a partition -> stars on the smallest node of each local component."""
    up: dict[int, int] = {}

    def root(x):
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for rb in batches:
        for a, b in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
    for i in range(0, len(pairs), 10_000):
        part = np.array(pairs[i : i + 10_000], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component."""
    edges, path = keep(links.mapInArrow(_contract, "a bigint, b bigint").distinct(), "stars")
    seen = None
    while True:
        # Large star: every larger neighbour of u goes to the smallest node around u.
        both = edges.union(edges.select("b", "a"))
        least, path1 = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("links")), "star-least")
        large = join_heavy(both.where("b > a"), least, ["a"], "links", 2 * edges.count()).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # few: a node's least neighbours, of its larger ones' stars
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        nxt, nxt_path = keep(small, "stars")
        count = nxt.count()
        settled = count == seen and nxt.join(edges, ["a", "b"], "left_anti").isEmpty()
        for done in (path, path1):
            drop_path(edges.sparkSession, done)
        edges, path, seen = nxt, nxt_path, count
        if settled:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, fingerprint, component_id."""
    return _near(docs, id_col, text_col, radius).drop("row")


def _near(docs: DataFrame, id_col: str, text_col: str, radius: int = RADIUS) -> DataFrame:
    """The rows of near_groups with their row keys."""
    prints, _ = keep(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes, _ = keep(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    links = linked(nodes, nodes.count(), radius)
    every = links[0][0]
    for x, _ in links[1:]:
        every = every.union(x)
    roots = components(every)
    label = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("root"))
    component = F.when(F.col("doc_id").isNotNull(), F.col("root"))
    return prints.join(label, "fp", "left").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), component.alias("component_id"), "row")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id."""
    gone = _near(docs, id_col, text_col).where(F.col(id_col) != F.col("component_id"))
    return without(docs, gone, row_key(id_col, text_col))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
