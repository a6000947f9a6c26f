"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

Texts are read as Unicode code points, all told apart (a Latin capital is a mark and its small form),
and one symbol for a word that repeats the word before it. Counts of all four-symbol windows of all trusted text are gathered by key-sharded
aggregation; continuation counts, context sums and probabilities of all orders come from joins of
the count shards on contexts and suffixes. Neither the windows nor their table has a bound, so the
final join is a shuffle: texts are taken in segments, each asks once for the distinct windows and
contexts in it, keys meet the probabilities in shards by their leading bits, and the answers meet
the segment's texts. A document goes when its perplexity per symbol is above its language's upper
quantile over held-out trusted text, or what a word costs below the lower one over all trusted text (text
that repeats itself is too easy to foretell; the model's own training texts say how easy good text is). A short text strays farther from the mean than a long one, so quantiles are
taken of standardised deviations: the spread at each length is fitted to the language's held-out texts
(variance between texts, and variance per symbol or word divided by their number). A sample says little
of a quantile so far out that hardly any of its texts lies past it; so a bound is the sample's quantile or,
if that is wider, the normal tolerance bound that covers the quantile with ``CONFIDENCE`` given so many
texts. A language's bounds are no narrower than those over all languages' texts, and are those where it
has fewer than ``LEAST_TEXTS``.

Defined results: null or empty text has null perplexity and is not kept; a null language is one of
its own; a language without trusted text takes mean, spread and quantiles of all trusted text; where no
trusted text falls into the held-out share, all trusted text sets the quantiles; where the held-out texts
do not differ, their own mean is the spread; without any trusted text every document with text is kept;
several labels of a document count as trusted if any says so; texts of any length are scored whole;
repeated rows are answered once each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import vec
from tessera.llm.shared import keep, row_key, shuffle_parts, small_ids, table, without

ORDER, BITS = 4, 21
MASK = (1 << BITS) - 1
#: Code points (each plus one), START before a text, REPEAT, and CAPITAL before the small form of a Latin capital.
SYMBOLS, START, REPEAT, CAPITAL = 0x110003, 0, 0x110001, 0x110002
#: Bytes of text that ask for their windows together, and shards by leading bits of the key, at least.
SEGMENT_BYTES, SHARD_BITS = 6 << 20, 8
#: Levels of the quantiles of trusted text between which a document stays.
UPPER, LOWER = 0.9995, 0.0005
#: With what probability a tolerance bound covers its quantile.
CONFIDENCE = 0.95
#: Held-out texts that a language needs to have a spread and bounds of its own.
LEAST_TEXTS = 30
#: Every count gives up this much, so that nothing has probability zero.
LEAST_DISCOUNT = 0.05
#: One trusted document in HELD_OUT, by a hash of its id, sets quantiles and trains nothing.
HELD_OUT = 4


def code_points(data: np.ndarray) -> np.ndarray:
    """The code point that begins at each byte (of no meaning at the others)."""
    s = data.astype(np.int32)
    for least, lead, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        at = np.flatnonzero(data >= least)
        if not len(at):
            break
        cp = data[at].astype(np.int32) & lead
        for d in range(1, more + 1):
            cp = cp << 6 | data[np.minimum(at + d, len(data) - 1)] & 63
        s[at] = cp
    return s


def symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, offsets, words) of texts."""
    s = code_points(data) + 1
    kept = (data & 0xC0) != 0x80
    a, e = vec.spans(vec.NOT_SPACE[data], offs)
    if len(a) > 1:
        h = vec.hasher(1)(vec.LOWER[data], a, e)
        doc = np.searchsorted(offs, a, "right")
        again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
        if len(again):
            s[a[again]] = REPEAT
            step = np.zeros(len(data) + 1, np.int32)
            step[a[again] + 1] += 1
            step[e[again]] -= 1
            kept &= np.cumsum(step[:-1]) == 0
            kept[a[again]] = True
    size = kept.astype(np.int64)
    large = kept & ((s > 0x41) & (s <= 0x5B) | (s > 0xC0) & (s <= 0xDF) & (s != 0xD8))
    size[large] = 2
    count = np.concatenate([[0], np.cumsum(size)])
    s[large] += 32
    out = np.repeat(s, size)
    out[count[:-1][large]] = CAPITAL
    return out, count[offs], np.diff(np.searchsorted(a, offs))


def contexts(s: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The ORDER - 1 symbols before each symbol, the oldest in the highest bits; START before a text."""
    h = np.zeros(len(s), np.int64)
    where = np.arange(len(s)) - np.repeat(offs[:-1], np.diff(offs))
    for d in range(1, ORDER):
        before = np.zeros(len(s), np.int64)
        before[d:] = s[:-d]
        before[where < d] = START
        h |= before << (BITS * (d - 1))
    return h


def key_of(n: int | np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit key of windows of n symbols: ``w`` after the n - 1 symbols of ``h``."""
    n = np.asarray(n).astype(np.uint64)
    return vec.mix(vec.mix(h.astype(np.uint64) * vec.U64(4) + n) + w.astype(np.uint64) * vec.U64(0x9E3779B97F4A7C15))


#: The context without symbols.
EMPTY = key_of(0, np.zeros(1, np.int64), np.zeros(1, np.int64))


def context_key(n: int | np.ndarray, h: np.ndarray) -> np.ndarray:
    """Key of contexts of n symbols, as windows of that size."""
    return key_of(n, h >> BITS, h & MASK)


def distinct(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of all windows, positions with each window once, in the order of keys, their counts)."""
    key = key_of(ORDER, h, w)
    low = vec.U64((1 << max(1, len(key).bit_length())) - 1)
    pos = (key & ~low) | np.arange(len(key), dtype=np.uint64)
    pos.sort()
    pos = (pos & low).astype(np.int64)
    if len(pos):
        top = key[pos]
        if (top[1:] < top[:-1]).any():  # keys that share their leading bits
            pos = np.argsort(key, kind="stable")
            top = key[pos]
        at = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        return key, pos[at], np.diff(np.append(at, len(pos)))
    return key, pos, pos


def _chunks(data: np.ndarray, offs: np.ndarray):
    for i, j in vec.chunks(offs):
        s, o, words = symbols(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield i, j, contexts(s, o), s, o, words


def _distinct_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, symbols, counts) of the distinct windows of texts."""
    parts = []
    for _i, _j, h, s, _o, _w in _chunks(data, offs):
        key, pos, n = distinct(h, s)
        parts.append((key[pos], h[pos], s[pos], n))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z
    key, h, s, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
    return h[at], s[at], np.bincount(inverse, weights=n, minlength=len(at)).astype(np.int64)


def _count(batches):
    kept, size = [], 0

    def merged():
        h, w, c = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((w, h))
        h, w, c = h[order], w[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else order
        return h[at], w[at], np.add.reduceat(c, at) if len(at) else c

    for rb in batches:
        data, offs = vec.text_buffer(rb.column(0))
        for i, j in vec.chunks(offs, SEGMENT_BYTES):
            kept.append(_distinct_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
            size += len(kept[-1][0])
            if size > 4_000_000:
                yield from _rows(*merged())
                kept, size = [], 0
    if kept:
        yield from _rows(*merged())


def _rows(h, w, c):
    for i in range(0, len(h), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000]), pa.array(w[i : i + 50_000].astype(np.int32)), pa.array(c[i : i + 50_000])], names=["h", "w", "c"])


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = dict(counts.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect())
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    each = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
    return [min(max(k - (k + 1) * y * b / a, LEAST_DISCOUNT), float(k)) if a else 0.5 * k for k, a, b in each]


def _keyed(batches):
    for rb in batches:
        n, h, w = (rb.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
        k = np.where(n > 0, key_of(np.abs(n), h, w), context_key(np.abs(n) - 1, h))
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(k.view(np.int64)), rb.column(3)], names=["n", "k", "p"])


def fit(trusted: DataFrame, text_col: str = "text") -> DataFrame:
    """(n, k, p): the probability of every seen window of n symbols under its key, and, under -n, the share of
    what follows a context of n - 1 symbols that goes to the shorter windows."""
    part = trusted.select(F.col(text_col).cast("string")).mapInArrow(vec.tidy(_count), "h bigint, w int, c bigint")
    levels = {ORDER: keep(part.groupBy("h", "w").agg(F.sum("c").alias("c")), "window-counts")[0]}

    def suffix(n: int):
        """The context of the window of n - 1 symbols that ends one of n."""
        return F.col("h").bitwiseAND((1 << (BITS * (n - 2))) - 1)

    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer windows a window ends
        levels[n] = levels[n + 1].groupBy(suffix(n + 1).alias("h"), "w").agg(F.count("*").alias("c"))
        levels[n], _ = keep(levels[n], "window-counts")
    lower, out = None, []
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(levels[n])
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        c = levels[n].select("h", "w", "c", d.alias("d"))
        sums = c.groupBy("h").agg((F.sum("d") / F.sum("c")).alias("g"), F.sum("c").alias("all"))
        c = c.join(sums, "h").select("h", "w", ((F.col("c") - F.col("d")) / F.col("all")).alias("own"), "g")
        if lower is None:
            p = c.select("h", "w", (F.col("own") + F.col("g") / SYMBOLS).alias("p"))
        else:
            below = lower.select(F.col("h").alias("s"), "w", F.col("p").alias("q"))
            p = c.withColumn("s", suffix(n)).join(below, ["s", "w"]).select("h", "w", (F.col("own") + F.col("g") * F.col("q")).alias("p"))
        lower, _ = keep(p, "window-probabilities")
        out += [lower.select(F.lit(n).alias("n"), "h", "w", F.col("p").cast("float").alias("p")), sums.select(F.lit(-n).alias("n"), "h", F.lit(0).alias("w"), F.col("g").cast("float").alias("p"))]
    return functools.reduce(DataFrame.unionByName, out).mapInArrow(_keyed, "n int, k bigint, p float")


def dense(n: np.ndarray, k: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Natural-log probability of every symbol without its context."""
    at = k == EMPTY.view(np.int64)[0]
    share = p[at & (n == -1)]
    prob = np.full(SYMBOLS, (share[0] if len(share) else 1.0) / SYMBOLS)
    every = np.arange(SYMBOLS)
    key = key_of(1, np.zeros(SYMBOLS, np.int64), every).view(np.int64)
    order = np.argsort(key)
    one = n == 1
    prob[order[np.searchsorted(key[order], k[one])]] = p[one]
    return np.log(prob)


def _segments(rb):
    """(key, first row, end row, bytes, offsets) of the segments of a batch (id, language, text)."""
    data, offs = vec.text_buffer(rb.column(2))
    for i, j in vec.chunks(offs, SEGMENT_BYTES):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        said = hashlib.blake2b(d.tobytes(), digest_size=8)
        said.update(o.tobytes())
        said.update(str(rb.column(0).slice(i, j - i).to_pylist()).encode())
        yield int.from_bytes(said.digest(), "little", signed=True), i, j, d, o


def asked_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sorted distinct keys of all orders' windows and contexts."""
    keys = [EMPTY]
    for n in range(1, ORDER + 1):
        short = h & ((1 << (BITS * (n - 1))) - 1)
        keys.append(key_of(n, short, w))
        if n > 1:
            keys.append(context_key(n - 1, short))
    return np.unique(np.concatenate(keys))


def log_probabilities(h: np.ndarray, w: np.ndarray, keys: np.ndarray, p: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Of windows, from the answers (NaN: not seen) to their keys, which are sorted."""

    def look(values, key):
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        if (keys[at] != key).any():
            raise ValueError("the documents changed between two readings")
        return values[at].astype(np.float64)

    low = np.full(len(h), 1 / SYMBOLS)
    for n in range(1, ORDER + 1):
        short = h & ((1 << (BITS * (n - 1))) - 1)
        seen = look(p, key_of(n, short, w))
        share = look(g, context_key(n - 1, short) if n > 1 else np.full(len(h), EMPTY[0]))
        low = np.where(np.isnan(seen), np.where(np.isnan(share), 1.0, share) * low, seen)
    return np.log(low)


def _ask(bits: int):
    def run(batches):
        for rb in batches:
            for segment, _i, _j, d, o in _segments(rb):
                h, w, _ = _distinct_of(d, o)
                keys = asked_keys(h, w)
                shard = (keys >> vec.U64(64 - bits)).astype(np.int64)
                at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                parts = [keys[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(keys)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array([segment] * len(at), pa.int64()), pa.array(parts, pa.binary())], names=["shard", "segment", "keys"])

    return vec.tidy(run)


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    vec.drop_caches()
    n, k, p = (model.column(c).to_numpy() for c in ("n", "k", "p"))
    k = k.view(np.uint64)
    tables = []
    for mine in (n > 0, n < 0):
        order = np.argsort(k[mine])
        tables.append((k[mine][order], p[mine][order]))
    out = [[], []]
    for blob in asked.column("keys").to_pylist():
        keys = np.frombuffer(blob, np.uint64)
        for (known, value), to in zip(tables, out, strict=True):
            found = np.full(len(keys), np.nan, np.float32)
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                found[hit] = value[at[hit]]
            to.append(found.tobytes())
    vec.give_back()
    return pa.table([asked.column("segment"), asked.column("keys"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["segment", "keys", "p", "g"])


def _pack(batches):
    for rb in batches:
        for segment, i, j, d, o in _segments(rb):
            part = pa.compress(d.tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([rb.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([rb.column(1).slice(i, j - i).to_pylist()], pa.list_(pa.string())), pa.array([rb.column(3).slice(i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([o], pa.list_(pa.int64())), pa.array([part], pa.binary())], names=["segment", "ids", "langs", "rows", "offs", "text"])


def _score(packed: pa.Table, answers: pa.Table) -> pa.Table:
    vec.drop_caches()
    keys, p, g = (np.frombuffer(b"".join(answers.column(c).to_pylist()), t) for c, t in (("keys", np.uint64), ("p", np.float32), ("g", np.float32)))
    keys, at = np.unique(keys, return_index=True)
    p, g = p[at], g[at]
    out = []
    for r in range(packed.num_rows):
        offs = np.array(packed.column("offs")[r].as_py(), np.int64)
        data = np.frombuffer(pa.decompress(packed.column("text")[r].as_py(), int(offs[-1]), "zstd", asbytes=True), np.uint8)
        n = len(offs) - 1
        nll, size, words = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        chunks, known = [], []  # windows of each chunk by number, and each chunk's distinct ones
        for i, j, h, s, o, w in _chunks(data, offs):
            key, pos, _ = distinct(h, s)
            known.append((key[pos], h[pos], s[pos]))
            chunks.append((i, j, np.searchsorted(key[pos], key).astype(np.int32), o))
            size[i:j], words[i:j] = np.diff(o), w
        if known:  # the probability of a window is looked up once a segment
            every, at = np.unique(np.concatenate([k for k, *_ in known]), return_index=True)
            logp = log_probabilities(*(np.concatenate(c)[at] for c in list(zip(*known, strict=True))[1:]), keys, p, g)
            for (i, j, number, o), (key, *_) in zip(chunks, known, strict=True):
                each = logp[np.searchsorted(every, key)][number]
                nll[i:j] = -np.diff(np.concatenate([[0.0], np.cumsum(each)])[o])
        out.append(pa.table([packed.column("ids")[r].values, packed.column("langs")[r].values, pa.array(size), pa.array(words), pa.array(nll), packed.column("rows")[r].values], names=["doc_id", "lang", "n_symbols", "n_words", "nll", "row"]))
        del chunks, known
    vec.give_back()
    return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_symbols", pa.int64()), ("n_words", pa.int64()), ("nll", pa.float64()), ("row", pa.int64())]).empty_table()


def scores(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_symbols, n_words, nll, row): the negative log-likelihood of every text, in nats, and its row key."""
    bits = max(SHARD_BITS, shuffle_parts(docs.sparkSession).bit_length() + 1)
    rows = docs.select(F.col(id_col).cast("bigint"), F.col(lang_col).cast("string"), F.col(text_col).cast("string"), row_key(id_col, text_col))
    asked = rows.mapInArrow(_ask(bits), "shard int, segment bigint, keys binary")
    shards = model.select(F.shiftrightunsigned("k", 64 - bits).cast("int").alias("shard"), "n", "k", "p")
    answers = asked.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(_answer, "segment bigint, keys binary, p binary, g binary")
    packed = rows.mapInArrow(vec.tidy(_pack), "segment bigint, ids array<bigint>, langs array<string>, rows array<bigint>, offs array<bigint>, text binary")
    return packed.groupBy("segment").cogroup(answers.groupBy("segment")).applyInArrow(_score, "doc_id bigint, lang string, n_symbols bigint, n_words bigint, nll double, row bigint")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang, n_symbols, perplexity and its deviation, nats a word and their deviation, the language's
    bounds of both deviations, keep."""
    return _classified(docs, labels, id_col, text_col, lang_col).drop("row")


def tolerance(n: Column, level: float) -> Column:
    """Standard deviations from the mean of n texts (three at least) that cover the quantile ``level`` of a normal
    distribution with ``CONFIDENCE`` (one-sided, by the usual approximation)."""
    z, c = NormalDist().inv_cdf(level), NormalDist().inv_cdf(CONFIDENCE)
    n = F.greatest(n, F.lit(3))
    a, b = 1 - c * c / (2 * (n - 1)), z * z - c * c / n
    return (z + F.sqrt(F.greatest(z * z - a * b, F.lit(0.0)))) / a


def _classified(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The rows of classify with their row keys."""
    ids = labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("_trusted")).distinct()
    held = F.pmod(F.xxhash64("_trusted"), F.lit(HELD_OUT)) == 0
    seen = ids.where(~held)
    trusted = docs.join(small_ids(seen), docs[id_col] == seen["_trusted"], "left_semi")
    scored, _ = keep(scores(docs, fit(trusted, text_col), id_col, text_col, lang_col).withColumns({"symbols": F.greatest("n_symbols", F.lit(1)), "units": F.greatest("n_words", F.lit(1))}), "perplexity")
    of = lambda which: scored.where("n_symbols > 0").join(which, F.col("doc_id") == F.col("_trusted"), "left_semi")
    good = of(ids.where(held))
    if good.isEmpty():
        good = of(ids)
    good, _ = keep(good, "held-out")
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    axes = (("symbol", "symbols"), ("word", "units"))

    def by_language(rows: DataFrame, stats: list[Column]) -> DataFrame:
        """One row per language that has trusted text; few, as languages are."""
        out = rows.groupBy("lang").agg(*stats).withColumnRenamed("lang", "_lang")
        return keep(out.coalesce(1), "language-statistics")[0]

    # means, then the spread of deviations by length, then quantiles of standardised deviations
    means = [F.sum("nll") / F.sum(n) for _, n in axes]
    mean = by_language(good, [m.alias(f"mean_{a}") for m, (a, _) in zip(means, axes, strict=True)])
    all_mean = good.agg(*means).first()
    off = good.join(mean, same).drop("_lang")
    for a, n in axes:
        off = off.withColumn(f"u_{a}", F.pow(F.col("nll") / F.col(n) - F.col(f"mean_{a}"), 2)).withColumn(f"x_{a}", 1 / F.col(n))
    fits = [f.alias(f"{k}_{a}") for a, _ in axes for k, f in (("n", F.count("*")), ("u", F.avg(f"u_{a}")), ("x", F.avg(f"x_{a}")), ("slope", F.regr_slope(f"u_{a}", f"x_{a}")), ("level", F.regr_intercept(f"u_{a}", f"x_{a}")))]
    pooled = off.agg(*fits).first()
    fitted = by_language(off, fits)

    def variance(a: str, n: str) -> Column:
        """Of the deviation of a text of n units: by its language's fit, but by the pooled one at least where the language
        has few texts."""

        def line(u: Column, x: Column, slope: Column, level: Column) -> Column:
            """The fitted line, without its constant where that is negative, and without its slope where that is."""
            return F.when((slope >= 0) & (level >= 0), level + slope / F.col(n)).when(slope >= 0, u / x / F.col(n)).otherwise(u)

        kinds = ("u", "x", "slope", "level")
        pool, own = line(*(F.lit(pooled[f"{k}_{a}"]).cast("double") for k in kinds)), line(*(F.col(f"{k}_{a}") for k in kinds))
        both = F.when(F.coalesce(F.col(f"n_{a}"), F.lit(0)) >= LEAST_TEXTS, own).otherwise(F.greatest(own, pool))
        return F.when(both > 0, both).when(pool > 0, pool).otherwise(F.pow(F.col(f"mean_{a}"), 2))

    def deviations(rows: DataFrame) -> DataFrame:
        rows = rows.join(mean, same, "left").drop("_lang").join(fitted, same, "left").drop("_lang")
        for k, (a, n) in enumerate(axes):
            rows = rows.withColumn(f"mean_{a}", F.coalesce(f"mean_{a}", F.lit(all_mean[k]).cast("double")))
            rows = rows.withColumn(f"dev_{a}", (F.col("nll") / F.col(n) - F.col(f"mean_{a}")) / F.sqrt(variance(a, n)))
        return rows

    most = F.greatest(F.percentile_approx("dev_symbol", UPPER, 10_000), F.avg("dev_symbol") + tolerance(F.count("*"), UPPER) * F.stddev_pop("dev_symbol"))
    least = F.least(F.percentile_approx("dev_word", LOWER, 10_000), F.avg("dev_word") - tolerance(F.count("*"), 1 - LOWER) * F.stddev_pop("dev_word"))
    enough = lambda bound: F.when(F.count("*") >= LEAST_TEXTS, bound)
    strange, easy = deviations(good), deviations(of(ids))
    highest, overall_most = by_language(strange, [enough(most).alias("most")]), strange.agg(most).first()[0]
    lowest, overall_least = by_language(easy, [enough(least).alias("least")]), easy.agg(least).first()[0]
    out = deviations(scored).join(highest, same, "left").drop("_lang").join(lowest, same, "left")
    out = out.withColumn("most", F.greatest("most", F.lit(overall_most).cast("double"))).withColumn("least", F.least("least", F.lit(overall_least).cast("double")))
    has_text = F.col("n_symbols") > 0
    inside = F.coalesce((F.col("dev_symbol") <= F.col("most")) & (F.col("dev_word") >= F.col("least")), F.lit(True))
    shown = lambda c: F.when(has_text, c)
    return out.select(F.col("doc_id").alias(id_col), "lang", "n_symbols", shown(F.exp(F.col("nll") / F.col("n_symbols"))).alias("perplexity"), shown(F.col("dev_symbol")).alias("deviation"), F.col("most").alias("highest"), shown(F.col("nll") / F.col("units")).alias("word_nats"), shown(F.col("dev_word")).alias("word_deviation"), F.col("least").alias("lowest"), (has_text & inside).alias("keep"), "row")


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    return without(docs, _classified(docs, labels, id_col, text_col, lang_col).where(~F.col("keep")), row_key(id_col, text_col))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
