"""Each operator against a brute-force version, and its defined results on hard rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, decontam, exact_dedup, html_extract, lexicon, pii, pretoken, quality, secrets, simhash, tokenbin, vec

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, node bigint, _gone int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    hard = [None, "", " \n\t ", "x", "É À ß 漢字 \U0001f600", "a" * 5000, "word " * 3000, "\u00a0nbsp\u2028line", "it's we'll 'tis", "<|endoftext|> in <|startoftext|>text"]
    return base + hard + [base[0].upper(), base[1], base[1], base[2] + "!"]


def frame(spark, values=None):
    """Documents with extra columns whose names clash with those the operators use."""
    values = texts() if values is None else values
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", len(t or ""), 1, 2, 3) for i, t in enumerate(values)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- words ---------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=6))
def test_words_and_hashes_of_any_text(values):
    data, offs = vec.text_buffer(pa.array(values, pa.string()))
    s, e = vec.spans(vec.NOT_SPACE[data], offs)
    got = [data[a:b].tobytes() for a, b in zip(s, e, strict=True)]
    assert got == [w.encode() for t in values for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    h = vec.hasher(1)(data, s, e)
    assert len({(w, int(x)) for w, x in zip(got, h, strict=True)}) == len(set(got))


def test_pretokens_are_the_librarys():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    rng = random.Random(4)
    letters = list("ab'stmdrevl  \n\t.,!19é½²") + ["\U0001f600", "漢", "\u0301", "\x85", "\u2028"]
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    table = pretoken.class_table()
    points, at, _ = pretoken.decode(*vec.text_buffer(pa.array(values)))
    for split, pattern in ((pretoken.split_bytes, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), (pretoken.split_words, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        s, e = split(points, at, table)
        first = np.searchsorted(s, at)
        for k, t in enumerate(values):
            got = [points[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(s[first[k] : first[k + 1]], e[first[k] : first[k + 1]], strict=True)]
            assert got == [x for x, _ in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(t)]


def test_word_table_grows_and_finds():
    t, rng = pretoken.WordTable(bits=4), np.random.default_rng(2)
    h = rng.integers(1, 2**63, 500, dtype=np.int64).astype(np.uint64)
    for part in np.split(h, 10):
        ids, size = t.encode(part, part ^ np.uint64(7), lambda rows, part=part: (np.full(len(rows), 2), np.repeat(part[rows] % np.uint64(1000), 2).astype(np.int32)))
        assert (ids[::2] == (part % np.uint64(1000)).astype(int)).all() and (size == 2).all()
    assert (t.find(h, h ^ np.uint64(7)) == np.arange(500)[np.argsort(np.argsort(t.find(h, h ^ np.uint64(7))))]).all()
    assert (t.find(h, h) == -1).all()


# --- exact dedup ---------------------------------------------------------------------------------------


def test_exact_groups(spark):
    values = texts()
    got = by_id(exact_dedup.exact_groups(frame(spark, values)))
    groups = {}
    for i, t in enumerate(values):
        groups.setdefault(lower(t), []).append(i)
    for i, t in enumerate(values):
        g = groups[lower(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), i == max(g), hashlib.sha256(lower(t).encode()).hexdigest())
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    left = exact_dedup.drop_exact(frame(spark, values))
    assert left.count() == len(groups) and left.columns == frame(spark, values).columns


def test_exact_groups_of_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a"), (3, "A"), (3, "a"), (None, "z")], "doc_id bigint, text string")
    rows = exact_dedup.exact_groups(df).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in rows if r.text_sha256 == hashlib.sha256(b"a").hexdigest()) == [(False, 3, 3, True), (False, 3, 3, True), (True, 3, 3, False)]


def test_directory_splits_and_doubles():
    w = np.zeros(16, np.int64)
    w[3], w[12:] = 40, 5
    d = exact_dedup.Directory(w, 10)
    assert d.depth == 4 and [p << (4 - b) for p, b in d.buckets] == sorted(p << (4 - b) for p, b in d.buckets)
    assert len(d.slots) == 16 and d.bucket(3 << 60) != d.bucket(4 << 60) and len(set(d.slots.tolist())) == len(d.buckets)


def test_chains_keep_colliding_texts_apart():
    rows = [pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array([7, 7, 7, 8]), pa.array(["p", "q", "p", "r"]), pa.array([b"x", b"y", b"x", b"x"], pa.binary()), pa.array([1, 2, 5, 9]), pa.array([1, 2, 1, 1])], names=["bucket", "h", "text_sha256", "text", "keep_id", "n"])]
    out = [r for b in exact_dedup._owner(iter(rows)) for r in b.to_pylist()]
    assert sorted((r["h"], r["text_sha256"], r["keep_id"], r["group_size"]) for r in out) == [(7, "p", 5, 2), (7, "q", 2, 2)]


# --- simhash -------------------------------------------------------------------------------------------


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(min(1, len(w)), len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(values, radius=3):
    up = {i: i for i in values}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(values)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_groups(spark):
    values = texts()
    got = by_id(simhash.near_groups(frame(spark, values)))
    prints = {i: fingerprint(t) for i, t in enumerate(values)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == components(prints)
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.drop_near(frame(spark, values)).count() == len(set(components(prints).values()))


def test_near_groups_of_null_and_repeated_ids(spark):
    rows = [(None, "one two three four"), (7, "ONE two three four"), (7, "one two three four"), (4, "something else here at all"), (4, None), (9, ""), (None, None)]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    prints = [fingerprint(t) for _, t in rows]
    assert sorted((r.doc_id or 0, r.fingerprint) for r in got) == sorted((i or 0, f"{p:016x}") for (i, _), p in zip(rows, prints, strict=True))
    assert {(r.fingerprint, r.doc_id): r.component_id for r in got} == {(f"{p:016x}", i): None if i is None else min(j for (j, _), q in zip(rows, prints, strict=True) if q == p and j is not None) for (i, _), p in zip(rows, prints, strict=True)}


@pytest.mark.parametrize("hot", [4096, 20])
def test_links_connect_what_lies_near(spark, hot):
    """A dense cluster, chains of three bits, and strangers; small ``hot`` deals long runs out again."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {0: centre}
    while len(prints) < 150:
        p = centre
        for b in rng.sample(range(64), rng.randint(1, 5)):
            p ^= 1 << b
        prints[len(prints)] = p
    walk = rng.getrandbits(64)
    for _ in range(40):
        for b in rng.sample(range(64), 3):
            walk ^= 1 << b
        prints[len(prints)] = walk
    for _ in range(200):
        prints[len(prints)] = rng.getrandbits(64)
    unique = {p: i for i, p in sorted(prints.items(), reverse=True)}
    prints = {i: p for p, i in unique.items()}
    nodes = spark.createDataFrame([(simhash.signed(p), i) for i, p in prints.items()], "fp bigint, node bigint")
    links = simhash.linked(nodes, len(prints), hot=hot)
    every = links[0][0]
    for x, _ in links[1:]:
        every = every.union(x)
    assert all(bin(prints[r.a] ^ prints[r.b]).count("1") <= 3 for r in every.collect())
    roots = {i: i for i in prints} | {r.node: r.root for r in simhash.components(every).collect()}
    assert roots == components(prints)


def test_masks_cover_every_choice_of_three_bits():
    for n in (10, 10**8, 10**10):
        masks = simhash.level_masks(n)
        rng = random.Random(n)
        for _ in range(200):
            change = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not change & m for m in masks)


def test_pivot_coordinates_never_discard_a_link():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, 50, dtype=np.int64).astype(np.uint64)
    near = fp ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64))
    pivots = simhash.reference_fingerprints()
    a, b = (simhash.coordinates(simhash.pivot_table(x, pivots)) for x in (fp, near))
    assert a.shape == (50, simhash.PIVOTS) and np.abs(a - b).max() <= 2
    plain = [[min(max(bin(int(x) ^ int(p)).count("1") - simhash.NEAREST, 0), 15) for p in pivots] for x in fp]
    assert sorted(map(sorted, plain)) == sorted(map(sorted, a.tolist()))


def test_hubs_and_heavy_groups_by_broadcast(spark, monkeypatch):
    from tessera.llm import shared

    monkeypatch.setattr(shared, "HEAVY", 10**9)
    rows = spark.range(9000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 5500, 2).otherwise(F.col("id")).alias("k"), "id")
    groups, _ = shared.keep(rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 8000"), "groups")
    got = {r.id: r.n for r in shared.join_heavy(rows, groups, ["k"], "n", 9000).collect()}
    assert got == {i: 4000 if i < 4000 else 1500 if i < 5500 else None if i == 8000 else 1 for i in range(9000)}
    star = spark.range(1, 3000).select(F.lit(5_000).alias("a"), F.col("id").alias("b"))
    assert {(r.node, r.root) for r in simhash.components(star.repartition(7)).collect()} == {(i, 1) for i in [*range(2, 3000), 5000]}


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from tessera.llm import shared

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x:7077"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(ValueError, match="share no folder"):
            shared.shared_dir(session)


def test_xxh64_of_all_lengths():
    data = np.frombuffer(bytes(range(256)) * 40, np.uint8)
    s = np.arange(120)
    e = s + np.concatenate([np.arange(100), [200, 1000, 4096, 4097, 5000], np.arange(15)])
    assert [int(x) for x in simhash.xxh64(data, s, e)] == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(s, e, strict=True)]


# --- decontamination -----------------------------------------------------------------------------------


def contamination(docs, items, n=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for i, t in items:
        w = find(lower(t))
        for k in range(max(min(1, len(w)), len(w) - n + 1)):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, who = find(lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    who |= {i for i in found if i is not None}
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(map(str, who))).encode()).hexdigest(), bool(hit))
    return out


def bench_items():
    base = texts()
    return [(1, " ".join(base[0].split()[:14])), (10, " ".join(base[3].split()[2:30])), (2, None), (3, ""), (4, "漢字"), (5, "alpha"), (6, "word " * 12), (7, base[0]), (None, "nbsp")]


def test_decontamination(spark, monkeypatch):
    values, items = texts(), bench_items()
    expected = contamination(enumerate(values), items)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {i: tuple(r)[1:] for i, r in by_id(decontam.decontaminate(frame(spark, values), bench)).items()}
    assert got == expected
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 40)  # several blocks give the same
    got = {i: tuple(r)[1:] for i, r in by_id(decontam.decontaminate(frame(spark, values), bench)).items()}
    assert got == expected
    assert decontam.decontaminate(empty(spark), bench).count() == 0
    none = by_id(decontam.decontaminate(frame(spark, values), spark.createDataFrame([], "item_id bigint, text string")))
    assert len(none) == len(values) and not any(r.contaminated for r in none.values())
    assert decontam.drop_contaminated(frame(spark, values), bench).count() == sum(not e[4] for e in expected.values())


def test_proximity(spark):
    docs = frame(spark, ["alpha one beta two gamma", "gamma beta alpha", "alpha beta far far far far far far far gamma"])
    index = decontam.build_index(docs)
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    found = decontam.search(index, bench, slop=2)
    assert found.agg(F.sum("n_near")).first()[0] == 2 and not any(r.starts for r in found.collect())


def test_proximity_by_document(spark, monkeypatch):
    """Every document's matches against brute force; neighbours' words are not joined across the border."""
    rng = random.Random(8)
    values = ["beta far alpha", "gamma beta", "gamma x alpha beta", None, ""] + [" ".join(rng.choice(WORDS[:5]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    items = [(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "beta alpha beta gamma"), (None, "epsilon beta"), (4, "nowhere")]

    def expected(text, slop):
        w, out = (text or "").split(), set()
        for item, t in items:
            terms, most = set(t.split()), len(t.split()) + slop
            fits = {(i, j) for i in range(len(w)) for j in range(i + 1, min(len(w), i + most) + 1) if terms <= set(w[i:j])}
            out |= {(item, i, j) for i, j in fits if not any((i, j) != f and i <= f[0] and f[1] <= j for f in fits)}
        return out

    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontam.BLOCK_BYTES, 20):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", limit)
        got = by_id(decontam.decontaminate(frame(spark, values).coalesce(1), bench, slop=1))
        for i, t in enumerate(values):
            want = sorted(expected(t, 1), key=lambda x: (x[0] is not None, x))
            assert got[i].near == ",".join(f"{'' if a is None else a}:{b}:{c}" for a, b, c in want) and got[i].n_near == len({x[1:] for x in want})


def test_inverted_lists_with_clashing_leading_bits():
    h1 = np.array([5, 4, 5, 6, 4], np.uint64)  # all share their leading bits
    terms, checks, counts, pos = decontam.invert(h1, h1)
    assert terms.tolist() == [4, 5, 6] and counts.tolist() == [2, 2, 1] and pos.tolist() == [1, 4, 0, 2, 3]
    assert decontam.unpack(counts.astype(np.int64), decontam.pack(counts, pos)).tolist() == pos.tolist()


# --- quality -------------------------------------------------------------------------------------------


def test_probabilities_sum_to_one(spark):
    model = quality.fit(frame(spark)).toPandas()
    logp = quality.dense(*(model[c].to_numpy() for c in ("n", "k", "p")))
    p = np.exp(logp.astype(np.float64)).reshape(-1, quality.SYMBOLS).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)


def kneser_ney(streams, order, symbols):
    """A plain dictionary version: probability function of (history, symbol)."""
    from collections import Counter, defaultdict

    grams = Counter(tuple(([0] * (order - 1) + list(s))[i : i + order]) for s in streams for i in range(len(s)))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    tables = {}
    for n, counts in levels.items():
        c = Counter(min(v, 5) for v in counts.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = [min(max(k - (k + 1) * y * c[k + 1] / c[k], quality.LEAST_DISCOUNT), k) if c[k] else 0.5 * k for k in (1, 2, 3)]
        total, cut = defaultdict(float), defaultdict(float)
        for g, v in counts.items():
            total[g[:-1]] += v
            cut[g[:-1]] += d[min(v, 3) - 1]
        tables[n] = counts, d, total, cut

    def prob(h, w, n=order):
        if n == 0:
            return 1 / symbols
        counts, d, total, cut = tables[n]
        h = h[len(h) - (n - 1) :] if n > 1 else ()
        low = prob(h, w, n - 1) if n > 1 else 1 / symbols
        if not total.get(h):
            return low
        v = counts.get((*h, w), 0)
        return (v - d[min(v, 3) - 1] if v else 0) / total[h] + cut[h] / total[h] * low

    return prob


def test_scores_equal_a_plain_model(spark):
    values = texts()[:34] + ["new words here", "ALL CAPS!!"]
    model = quality.fit(frame(spark, values[:30]))
    got = {r.doc_id: r for r in quality.scores(frame(spark, values), model).collect()}

    def stream(t):
        s, o, _ = quality.symbols(*vec.text_buffer(pa.array([t or ""])))
        return s.tolist()

    prob = kneser_ney([stream(t) for t in values[:30]], quality.ORDER, quality.SYMBOLS)
    for i, t in enumerate(values):
        s = [0, 0, 0, *stream(t)]
        nll = -sum(np.log(prob(tuple(s[k - 3 : k]), s[k])) for k in range(3, len(s)))
        assert got[i].nll == pytest.approx(nll, rel=1e-3, abs=1e-3)


def test_classifier_on_hard_rows(spark):
    values = texts()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(0, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = by_id(quality.classify(frame(spark, values), labels))
    assert len(got) == len(values) and got[30].perplexity is None and not got[30].keep and not got[31].keep
    assert all(got[i].keep for i in range(30))
    none = by_id(quality.classify(frame(spark, values), labels.where("quality = 5")))
    assert all(r.keep == (r.n_symbols > 0) for r in none.values())
    assert quality.classify(empty(spark), labels).count() == 0


def test_decisions_against_plain_numbers(spark):
    """Means, spreads, quantiles and verdicts once more, from the scores of the documents."""
    rng = random.Random(3)
    say = lambda n, junk: " ".join("".join(rng.choice("qxzjkvw") for _ in range(7)) if rng.random() < junk else rng.choice(WORDS) for _ in range(n))
    rows = [(i, say(rng.randint(1, 120), rng.choice([0, 0, 0, 0, 0.02, 0.5])), rng.choice(["en", "de", None, "xx"]) if i > 260 else rng.choice(["en", "de", None])) for i in range(300)]
    rows += [(300, "alpha " * 200, "en"), (301, "", "en"), (302, None, None), (303, "qzx", "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(240)], "doc_id bigint, quality int")
    held = {r.doc_id for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) == 0).collect()}
    scored = {r.doc_id: r for r in quality.scores(docs, quality.fit(docs.where(~F.col("doc_id").isin(held) & (F.col("doc_id") < 240)))).collect()}
    good = [r for r in scored.values() if r.doc_id in held and r.n_symbols]
    langs = {r.lang for r in good}
    axes = {"symbol": lambda r: max(r.n_symbols, 1), "word": lambda r: max(r.n_words, 1)}
    mean = {(a, k): sum(r.nll for r in good if k in (r.lang, "all")) / sum(n(r) for r in good if k in (r.lang, "all")) for a, n in axes.items() for k in [*langs, "all"]}

    def fit(a, k):
        u = np.array([(r.nll / axes[a](r) - mean[a, r.lang]) ** 2 for r in good if k in (r.lang, "all")])
        x = np.array([1 / axes[a](r) for r in good if k in (r.lang, "all")])
        slope, level = np.polyfit(x, u, 1)
        return len(u), (lambda n: level + slope / n if slope >= 0 and level >= 0 else u.mean() / x.mean() / n if slope >= 0 else u.mean())

    fits = {(a, k): fit(a, k) for a in axes for k in [*langs, "all"]}

    def deviation(r, a):
        n, pool = axes[a](r), fits[a, "all"][1](axes[a](r))
        own = fits.get((a, r.lang), (0, lambda n: pool))
        v = own[1](n) if own[0] >= quality.LEAST_TEXTS else max(own[1](n), pool)
        return (r.nll / n - mean.get((a, r.lang), mean[a, "all"])) / v**0.5

    from statistics import NormalDist

    def bounds(rows, a, sign):
        """The outermost deviation (the level asks for it in so few), or the tolerance bound."""
        out = {}
        for k in [*langs, "all"]:
            d = np.array([sign * deviation(r, a) for r in rows if k in (r.lang, "all")])
            z, c, n = NormalDist().inv_cdf(quality.UPPER), NormalDist().inv_cdf(quality.CONFIDENCE), len(d)
            x, y = 1 - c * c / (2 * (n - 1)), z * z - c * c / n
            if n >= quality.LEAST_TEXTS or k == "all":
                out[k] = sign * max(d.max(), d.mean() + (z + (z * z - x * y) ** 0.5) / x * d.std())
        return out

    most, least = bounds(good, "symbol", 1), bounds([r for r in scored.values() if r.doc_id < 240 and r.n_symbols], "word", -1)
    got = by_id(quality.classify(docs, labels))
    assert len(got) == 304 and len({r.keep for r in got.values()}) == 2
    for i, r in scored.items():
        if r.n_symbols:
            high, low = deviation(r, "symbol"), deviation(r, "word")
            assert got[i].deviation == pytest.approx(high, rel=1e-6, abs=1e-6) and got[i].word_deviation == pytest.approx(low, rel=1e-6, abs=1e-6)
            assert got[i].keep == (high <= max(most.get(r.lang, -9), most["all"]) + 1e-9 and low >= min(least.get(r.lang, 9), least["all"]) - 1e-9)
        else:
            assert not got[i].keep and got[i].perplexity is None


def test_trusted_text_outside_the_held_out_share(spark):
    labels = spark.range(100).withColumnRenamed("id", "doc_id").where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) != 0).limit(12).withColumn("quality", F.lit(1))
    ids = [r.doc_id for r in labels.collect()]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(40)), "en") for i in ids] + [(500, "zzqx %%%% $$$$ " * 10, "en"), (501, " ".join(WORDS), "en")]
    got = by_id(quality.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), labels))
    assert not got[500].keep and all(got[i].keep for i in ids)


def test_classifier_on_held_out_labels(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.keep.mean() > 0.9 and (not len(bad) or bad.keep.mean() < 0.3)


def test_letters_of_all_scripts_are_told_apart(spark):
    values = ["это простой русский текст о погоде и о море " * 3, "ѵто пыостой ыфсспьй фепсф о цободе п о шоые " * 3, "\u4e00\u4e8c\u4e09", "\u4e8c\u4e00\u4e09", "\U0001f600a\u00e9Z\u00c9"]
    s, o, _ = quality.symbols(*vec.text_buffer(pa.array(values[2:])))
    marked = [[x for c in t for x in ([quality.CAPITAL, ord(c.lower()) + 1] if c in "Z\u00c9" else [ord(c) + 1])] for t in values[2:]]
    assert [s[a:b].tolist() for a, b in zip(o, o[1:])] == marked
    got = by_id(quality.scores(frame(spark, values), quality.fit(frame(spark, [values[0], values[2]]))))
    assert got[1].nll / got[1].n_symbols > 3 * got[0].nll / got[0].n_symbols and got[3].nll > got[2].nll


# --- secrets -------------------------------------------------------------------------------------------


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab_.-=:>/+!@%&*~^<|#,;()[]{}\"' \t\n\x0b$é漢1\u00a0"), max_size=12))
def test_the_prefilter_takes_every_text_with_a_pair(text):
    if secrets.PAIR.search(text):
        assert pa.compute.match_substring_regex(pa.array([text]), secrets.PAIR_MAYBE)[0].as_py()


def test_unquoted_values_that_start_with_a_sign(spark):
    values = [f"db_pwd = {c}Xk29fj2LQz8wT1" for c in "/+!@%&*-.~^<|é漢"] + ["credential: !aB3xK92fjQ", "db_pwd. = aXk29fj2LQz8wT1"]
    got = by_id(secrets.scan_secrets(frame(spark, values)))
    assert {i: r.spans for i, r in got.items()} == {i: secrets.scan(t)[4] for i, t in enumerate(values)} and all(r.spans for r in got.values())


# --- BPE ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def byte_tokens():
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_round_trip(spark, byte_tokens):
    path, tok = byte_tokens
    values = texts()
    got = by_id(bpe.round_trip(frame(spark, values), path))
    for i, t in enumerate(values):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    coded = bpe.encode(frame(spark, values), path)
    assert {r.doc_id: r.text for r in bpe.decode_ids(coded, path).collect()} == {i: t or "" for i, t in enumerate(values)}
    assert bpe.round_trip(empty(spark), path).count() == 0


def test_any_number_of_special_strings(byte_tokens):
    path, tok = byte_tokens
    rng = random.Random(6)
    values = ["<|endoftext|>" * 1100, "a <|endof<|endoftext|>text|> b", None, "", *("".join(rng.choice(["<|endoftext|>", " a", "b c", "<|endo"]) for _ in range(rng.randrange(20))) for _ in range(100))]
    codec = bpe.Codec(bpe.Merges(path), pretoken.class_table(), None)
    assert [x for part in codec.encode(pa.array(values)) for x in part.to_pylist()] == [tok.encode(t or "", add_special_tokens=False).ids for t in values]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), min_size=1, max_size=12, unique=True))
def test_lexicon_finds_its_words_and_no_others(words):
    half = words[: max(1, len(words) // 2)]
    lex = lexicon.Lexicon(lexicon.build(half, [np.array([i, i + 1], np.int32) for i in range(len(half))]))
    number = lex.find([*words, b"", half[0] + b"\x00", half[0][:-1]])
    known = set(half)
    assert [n >= 0 for n in number.tolist()] == [w in known for w in [*words, b"", half[0] + b"\x00", half[0][:-1]]]
    lens, ids = lex.output(number[: len(half)])
    assert lens.tolist() == [2] * len(half) and ids[::2].tolist() == list(range(len(half)))


def test_suffixes_are_shared():
    words = [a + b"ending" for a in (b"a", b"b", b"c", b"d")]
    lex = lexicon.Lexicon(lexicon.build(words, [np.array([1], np.int32)] * 4))
    assert len(lex.final) == 8 and len(lexicon.Lexicon(lexicon.build([], [])).find([b"x"])) == 1


def test_long_words_merge_like_short_ones(byte_tokens):
    path, tok = byte_tokens
    m = bpe.Merges(path)
    for w in ("a" * 300, "thethe" * 60, "ab" * 200 + "c"):
        assert m.merge([w.encode()])[1].tolist() == tok.encode(w, add_special_tokens=False).ids
        assert m.merge_long(w[:50].encode()).tolist() == m.merge([w[:50].encode()])[1].tolist()


# --- token files ---------------------------------------------------------------------------------------


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000))
def test_blocks_decode_from_every_checkpoint(ids):
    ids = np.array(ids * 60, np.int64)
    fr = tokenbin.Frequencies(np.bincount(ids, minlength=400))
    b = tokenbin.encode_block(ids, fr)
    marks = len(b["steps"])
    assert marks == -(-len(ids) // (tokenbin.LANES * tokenbin.CHECKPOINT))
    for m in range(marks):
        assert (tokenbin.decode_stretch(b, m, marks, len(ids), fr) == ids[b["steps"][m] * tokenbin.LANES :]).all()


def test_stretches_cover_every_text():
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.choice([1, 50, 5000, 400_000]) for _ in range(rng.randint(1, 40))]
        n, step = sum(sizes), tokenbin.LANES * tokenbin.CHECKPOINT
        steps = [k * tokenbin.CHECKPOINT for k in range(-(-n // step))]
        begin = np.cumsum(sizes) - sizes
        for k, stop in enumerate(tokenbin.stretches(steps, n, sizes)):
            mine = [i for i, x in enumerate(begin) if k * step <= x < (k + 1) * step]
            assert stop == (max(-(-(begin[i] + sizes[i]) // step) for i in mine) if mine else k)


def test_damage_is_noticed(spark, tmp_path):
    path = tokenbin.write_tokens(frame(spark, ["one two three " * 40_000, None, "four"]), tokenbin.tokenizer_path("word_bpe_49k.json"), 1, path=f"file://{tmp_path}/good")
    fixed = ("frequencies", "header")
    schema = spark.read.parquet(f"{path}/blocks").schema
    flip = lambda x: bytes([x[0] ^ 1]) + x[1:]
    for c in schema.names:
        bad = [r.asDict() for r in spark.read.parquet(f"{path}/blocks").collect()]
        x = bad[0][c]
        bad[0][c] = flip(x) if isinstance(x, bytearray | bytes) else x + 1 if isinstance(x, int) else [x[0] + 1, *x[1:]]
        at = f"file://{tmp_path}/{c}"
        spark.createDataFrame([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r.values()) for r in bad], schema).write.parquet(f"{at}/blocks")
        for f in fixed:
            spark.read.parquet(f"{path}/{f}").write.parquet(f"{at}/{f}")
        with pytest.raises(Exception, match="checksum|missing|frequencies|ARRAY_INDEX"):
            tokenbin.read_tokens(spark, at).collect()
    spark.read.parquet(f"{path}/frequencies").where("id <> 1").write.parquet(f"file://{tmp_path}/f/frequencies")
    for f in ("blocks", "header"):
        spark.read.parquet(f"{path}/{f}").write.parquet(f"file://{tmp_path}/f/{f}")
    with pytest.raises(ValueError, match="frequencies"):
        tokenbin.read_tokens(spark, f"file://{tmp_path}/f")


def test_frequencies_keep_rare_symbols():
    counts = np.ones(40_000, np.int64)
    counts[0] = 10**12
    f = tokenbin.Frequencies(counts).freq
    assert f.sum() == 1 << tokenbin.SCALE and f.min() == 1


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenbin, "PART_BYTES", 4000)
    path = tokenbin.tokenizer_path("word_bpe_49k.json")
    tok, values = Tokenizer.from_file(path), [*texts(), "“curly” — quotes… and ﬁ Ａ Σας Å e\u0301 한글 \u1100\u1161 İI \u212b \x1c\x85\u3000end", "the long one " * 60_000, "after it"]
    at, files = 0, tokenbin.write_tokens(frame(spark, values), path, 1)
    assert spark.read.parquet(f"{files}/blocks").select("part").distinct().count() > 2
    got, ids_of, dealt = (by_id(tokenbin.read_tokens(spark, files, **kw)) for kw in ({"digest": True}, {}, {"tasks": 3}))
    for i, t in enumerate(values):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert tuple(got[i])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and list(ids_of[i].ids) == list(dealt[i].ids) == ids
        at += len(ids)
    assert tokenbin.read_tokens(spark, tokenbin.write_tokens(empty(spark), path, 1)).count() == 0


def test_token_files_of_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenbin, "PART_BYTES", 500)
    path = tokenbin.tokenizer_path("word_bpe_49k.json")
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 7, i]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    files = tokenbin.write_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), path, 1)
    got = sorted(tokenbin.read_tokens(spark, files).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order) and len(order) == 300
    again = sorted(tokenbin.read_tokens(spark, tokenbin.write_tokens(spark.createDataFrame(rows[::-1], "doc_id bigint, text string"), path, 1)).collect(), key=lambda r: r.start)
    assert got == again
    sizes = [r.n for r in spark.read.parquet(f"{files}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < sum(sizes) / 5


# --- rows without an id, and ids that repeat -------------------------------------------------------------


def test_decisions_take_effect_on_their_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    rows = lambda *r: spark.createDataFrame(r, "doc_id bigint, text string, lang string")
    left = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    docs = rows((None, passage, "en"), (None, "clean", "en"), (3, passage, "en"), (3, "clean too", "en"))
    assert left(decontam.drop_contaminated(docs, bench)) == [(0, "clean"), (3, "clean too")]
    docs = rows((None, "Copy", "en"), (7, "copy", "en"), (3, "copy", "en"), (3, "alone", "en"))
    assert left(exact_dedup.drop_exact(docs)) == [(3, "alone"), (7, "copy")]
    docs = rows((1, passage, "en"), (3, passage.upper(), "en"), (3, "something else entirely here", "en"))
    assert left(simhash.drop_near(docs)) == [(1, passage), (3, "something else entirely here")]
    docs = rows((None, "", "en"), (None, "text", "en"), (3, "", "en"), (3, "more", "en"))
    assert left(quality.drop_low_quality(docs, spark.createDataFrame([], "doc_id bigint, quality int"))) == [(0, "text"), (3, "more")]


# --- secrets -------------------------------------------------------------------------------------------


def test_base_spans_equal_the_patterns(spark):
    values = [*texts(), 'token = "0123456789abcdef0123"', "PASSWORD:abc", "API_KEY = 'ABCDEFGHIJKL' passwd=short secret: aaaaaaaaaaaa", "AKIA" + "B" * 14 + " AKIAB", "é é deadbeefdeadbeef0", 'toKen="İtoken=abcdefghijklmn'.replace("İ", "i")]
    got = by_id(secrets.scan_secrets(frame(spark, values)))
    assign = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in enumerate(values):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        spelled = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert set(filter(None, spelled.split(","))) <= set(got[i].spans.split(","))
    assert secrets.scan_secrets(empty(spark)).count() == 0


def lexed(text):
    return [text[int(s) : int(e)] for kind, s, e in (x.split(":") for x in filter(None, secrets.scan(text)[4].split(","))) if kind == "lexed"]


@pytest.mark.parametrize("text", ["a" * 10**6 + "\npwd = x", "a b" * 400_000 + " pwd: x", "x = 1 " + '"\\"' * 300_000, 'a="' + "'" * 10**6, "a = 1\n" + "x = x + x\n" * 50_000, "k = 'qW3eR5tY7'\n" + "pwd = pwd + k\n" * 50_000, "a = b = " * 100_000 + "'x'", "a=1" + "+b" * 400_000, "pwd " + " " * 10**6 + "= x"])
def test_secrets_take_time_in_proportion(text):
    import time

    t = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - t < 5


def test_joined_constants():
    assert lexed('k = "abcDEF123456xyz9"\nclient_secret = k+"suffix99"') == lexed('k = "abcDEF123456xyz9"\nclient_secret = k + "suffix99"') == ["abcDEF123456xyz9", "suffix99"]
    assert lexed('k = "abcDEF12"\nj = "3456xyz9"\nclient_secret = $k+j') == ["abcDEF12", "3456xyz9"]
    assert lexed("x = 'aB3dE5fG7'\n" + "x = x + x\n" * 2000 + "db_pwd = x") == ["aB3dE5fG7"]
    assert lexed("my_pwd: str = b'aB3dE5fG7h'\nn = dbPwd = 'Zq9$kkL2mm'") == ["aB3dE5fG7h", "Zq9$kkL2mm"]
    assert lexed("db_pwd = " + "x" * 40 + "\ndb_pwd = your_" + "a1" * 20) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "db_pwd", "title", "client_secret"]), st.lists(st.sampled_from(["a", "b", "c", "'aB3dE5fG7'", '"zz9Qw2"', "'two words'", "'changeme'", "'é漢x7Yk2'"]), min_size=1, max_size=3)), max_size=8))
def test_constants_against_plain_strings(program):
    """Values as whole strings, by a few lines that know the program and not its syntax."""
    text, held, want = "", {}, set()
    for name, terms in program:
        text += f"{name} = "
        value, spans = "", []
        for k, t in enumerate(terms):
            text += " + " if k else ""
            if t[0] in "'\"":
                spans.append((len(text) + 1, len(text) + len(t) - 1))
                value += t[1:-1]
            elif t in held:
                value, spans = value + held[t][0], spans + held[t][1]
            else:
                spans.append((len(text), len(text) + len(t)))
                value += t
            text += t
        text += "\n"
        held[name] = value, spans
        raw = value.encode()
        share = [raw.count(x) / len(raw) for x in set(raw)]
        kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        score = min(len(value), 24) / 24 + min(-sum(p * np.log2(p) for p in share), 4) / 4 + 0.25 * kinds + (0.75 if re.search("[0-9]", value) else -0.5)
        if name in ("db_pwd", "client_secret") and len(value) >= 6 and value != "changeme" and " " not in value and 3 + score >= secrets.LEAST_SCORE:
            want.update(spans)
    base = secrets.base_spans(text)
    assert [(s, e) for s, _, e in secrets.lexed_spans(text, base)] == sorted((s, e) for s, e in want if not any(a <= s and e <= b for a, _, b in base))


def test_constants_reach_sensitive_names():
    text = 'k = "abcDEF123456xyz9"\nclient_secret = k\ncfg["db_password"] = "p4ssW0rd!zz"\ntitle = "abcDEF123456xyz8"\npassword = "changeme"\nurl: http://x'
    lexed = [text[int(s) : int(e)] for kind, s, e in (x.split(":") for x in secrets.scan(text)[4].split(",")) if kind == "lexed"]
    assert lexed == ["abcDEF123456xyz9", "p4ssW0rd!zz"]


# --- chat ------------------------------------------------------------------------------------------------


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")


def test_best_branches_and_odd_trees(spark):
    rows = [(None, 1, None, "user", "no tree", 0.0), (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "u", 5.0), (2, 1, 9, "user", None, 0.0), (3, 1, 2, "user", "c", 1.0), (3, 2, 1, "user", "c", 1.0), (4, 1, None, None, "n", None)] + [(5, k, k - 1 if k else None, "user", str(k), 0.0) for k in range(40)]
    out = {(r.tree, r["rank"]): r for r in chat.format_paths(tree(spark, rows), 2).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert {(t, k): r.leaf for (t, k), r in out.items()} == {(1, 1): 4, (1, 2): 3, (2, 1): 1, (4, 1): 1, (5, 1): 39}
    assert [t.text for t in out[5, 1].turns] == [str(k) for k in range(40)]
    r = out[1, 1]
    assert [r.formatted[a:b] for a, b in r.loss] == ["a"]


def test_empty_and_repeated_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, node bigint"
    assert chat.format_paths(chat.chains(spark.createDataFrame([], schema))).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a", 9), (1, 0, "user", "a", 9), (1, None, "user", None, 9), (2, 0, "user", "b" * 50_000, 9)], schema)
    out = {r.tree: r.formatted for r in chat.format_paths(chat.chains(twice)).collect()}
    assert out[1] == "### user:  </turn>\n" + "### user: a </turn>\n" * 2 and len(out[2]) == 50_000 + 19


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.text("user\\:#<", max_size=6), st.text("\\#<>/tun: A\n", max_size=14)), min_size=1, max_size=8))
def test_any_text_reads_back(spark, turns):
    out = chat.format_paths(tree(spark, [(1, i + 1, i or None, r, t, 0.0) for i, (r, t) in enumerate(turns)])).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [(x.role, x.text) for x in out.t] == turns


# --- html ------------------------------------------------------------------------------------------------


def test_main_text(spark):
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><!-- ad --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>\n para<br>here.<p>Second</p><form><p>mail</p></form><ul><li>one</li></ul></article><section id="comments"><p>Great post indeed</p></section><footer>&copy;</footer></body></html>'
    rows = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "plain text", "x"), (5, "u", "<p>a</p>" * 3000, "x")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(rows).collect()}
    assert got[1].text == "Title & more\nFirst bold para here.\nSecond\none" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[4].text == "plain text" and got[5].n_chars == 5999
    assert html_extract.extract(rows.limit(0)).count() == 0


ARTICLE = "<h1>The title</h1><p>" + "word and more words here " * 20 + "</p>"


@pytest.mark.parametrize("wrap", ['<div class="site has-sidebar">%s</div>', '<div class="post search-engines">%s</div>', '<div data-title="The hidden coast">%s</div>', '<div data-id="comments">%s</div>', '<svg>%s', '<form id="whole-page">%s</form>', "<table class=layout>%s</table>", '<div title="a > b" id=main>%s</div>', "<SECTION CLASS='no-comments'>%s</SECTION>", '<div class="related">%s</div>'])
def test_articles_are_not_lost_by_the_names_around_them(wrap):
    page = "<html><body><nav><a>Home</a> <a>About</a></nav>" + wrap % ARTICLE + '<div id="comments"><p>reader says hello to all</p></div><aside class=ads>buy</aside><footer>foot</footer></body></html>'
    want = "The title\n" + ("word and more words here " * 20).strip()
    pages = [page, "<nav>x</nav><main>" + ARTICLE + "</main><footer>y</footer>"] * 4
    counts = [tuple(r.values()) for rb in html_extract._count([pa.record_batch([pa.array(pages)], names=["html"])]) for r in rb.to_pylist()]
    assert html_extract.main_text(page, {}).endswith(want.split("\n")[1]) and "reader" not in html_extract.main_text(page, {})
    weights = {(k, key): (-0.5 if k == "tag" else (1.0 if a > b else -2.0)) for k, key, a, b in counts if k != "name"}
    assert html_extract.main_text(page, weights) == want


@pytest.mark.parametrize("part", ["<a ", "<svg>", "<div>", "<script>", "<![CDATA[", "<!--", '<a b="', '<a b=">" ', "</", "<!", "&amp", "<div class='comments nav'>", "</section><div>", "<a b='\">", "<svg "])
def test_pages_take_time_in_proportion(part):
    import time

    t = time.perf_counter()
    html_extract.main_text(part * 100_000, {})
    assert time.perf_counter() - t < 8


def test_pages_against_their_construction(spark):
    """Pages put together from an article and what does not belong to it."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for i in range(60):
        blocks = [say(rng.randint(15, 40)) for _ in range(rng.randint(2, 5))]
        junk = ['<div class="ad-slot"><p>%s</p></div>', '<aside><p>%s</p></aside>', '<div class="share-buttons"><a>%s</a></div>', "<form><label>%s</label></form>", "<script>var a = '%s';</script>", "<!-- <p>%s</p> -->", '<p style="display: none"></p><div hidden>%s</div>', '<div class="newsletterSignup">%s</div>', "<svg><text>%s</text></svg>"]
        body = "".join(f"<p>{b.replace(' ', rng.choice([' ', chr(10), '&nbsp;']), 2)}" + ("</p>" if rng.random() < 0.7 else "") + (rng.choice(junk) % say(4) if rng.random() < 0.5 else "") for b in blocks)
        before = f'<head><title>{say(3)}</title></head><header class="site-header"><h2>{say(2)}</h2></header><nav><ul><li><a href="x">{say(1)}</a></li></ul></nav><div role="alert">{say(8)}</div>'
        after = f'<section id="comments"><h3>{say(2)}</h3><p>{say(50)}</p></section><div class="related-posts"><a>{say(6)}</a></div><footer>{say(5)}</footer>'
        mark = rng.choice([("<article>", "</article>"), ('<main class="x">', "</main>"), ('<div class="post-content">', "</div>")])
        rows.append((i, "u", f"<html>{before}<body>{mark[0]}<h1>title &eacute; {i}</h1>{body}{mark[1]}{after}</body></html>"))
        want[i] = "\n".join([f"title é {i}", *blocks])
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_region_is_the_largest_sum():
    rng = random.Random(8)
    for _ in range(200):
        found = [("tag", f"t{rng.randrange(3)}", "", False) if rng.random() < 0.5 else ("block", f"b{rng.randrange(3)}", "w " * rng.randint(1, 4), False) for _ in range(12)]
        w = {("tag", f"t{k}"): -rng.random() for k in range(3)} | {("block", f"b{k}"): rng.uniform(-1, 1) for k in range(3)}
        score = [w[k, key] * (len(t.split()) if k == "block" else 1) for k, key, t, _ in found]
        a, b = html_extract.region(found, w)
        best = max([0.0] + [sum(score[i : j + 1]) for i in range(12) for j in range(i, 12)])
        assert (sum(score[a : b + 1]) if b >= 0 else 0.0) == pytest.approx(best)


# --- personal data ---------------------------------------------------------------------------------------


PRIVATE = [
    "mail a.b12@mail7.example.com, +1 (706) 555-3138 4111 1111 1111 1111; 4111111111111112",
    "1.2.3.4 256.1.1.1 10.0.0.255. 2020-02-29 2021-02-29 31/12/1999 12.5.2001 1850-03-04 12/31/1999 02/29/2004 04/30/2011 07/13/1988",
    "ssn 123-45-6789 000-12-3456 GB82 WEST 1234 5698 7654 32 DE89370400440532013000 (415) 555-2671",
    None,
    "",
    "no data 12345",
    "again 4111 1111 1111 1111 and 1.2.3.4",
]


def test_pseudonyms_keep_form_and_turn_back(spark):
    out = pii.pseudonymize(frame(spark, PRIVATE), "key")
    got = by_id(out)
    assert [got[i].n_private for i in range(7)] == [3, 10, 4, 0, 0, 0, 2]
    assert got[3].text is None and got[4].text == "" and got[5].text == PRIVATE[5]
    for secret in ("a.b12@", "555-3138", "4111 1111 1111 1111", "1999", "123-45-6789", "WEST", "555-2671"):
        assert not any(secret in (r.text or "") for r in got.values())
    assert "256.1.1.1" in got[1].text and "2021-02-29" in got[1].text and "000-12-3456" in got[2].text and "4111111111111112" in got[0].text
    assert " ".join(got[6].text.split()[1:5]) == got[0].text.split(";")[0][-19:]  # equal values stay linked
    back = by_id(pii.pseudonymize(out.select("doc_id", "text"), "key", inverse=True))
    assert [back[i].text for i in range(7)] == PRIVATE
    again = by_id(pii.pseudonymize(out.select("doc_id", "text"), "key"))
    assert [again[i].kinds for i in range(7)] == [got[i].kinds for i in range(7)]  # pseudonyms are valid values
    assert pii.pseudonymize(empty(spark), "key").count() == 0


def moved_plainly(values, radix, kind, key):
    """The network once more, on Python numbers."""
    sha = lambda *parts: hashlib.sha512("|".join(map(str, parts)).encode()).hexdigest()
    if len(values) == 1:
        return [sorted(range(radix[0]), key=lambda x: sha(key, kind, "table", radix[0], x))[values[0]]]
    half = len(values) // 2
    sides, radices = [values[:half], values[half:]], [radix[:half], radix[half:]]
    for i in range(pii.ROUNDS):
        to = 1 - i % 2 if i % 2 else 1
        x, other = sides[to], sides[1 - to]
        said = sha(key, kind, len(x), i, ",".join(map(str, other)))
        words = "".join(sha(said, b) for b in range((len(x) - 1) // 16 + 1))
        sides[to] = [(v + int(words[8 * j : 8 * j + 8], 16)) % r for j, (v, r) in enumerate(zip(x, radices[to], strict=True))]
    return sides[0] + sides[1]


def test_feistel_against_plain_numbers(spark):
    rng = random.Random(9)
    rows = []
    for n in (1, 2, 3, 5, 16, 33, 80):
        for _ in range(6):
            radix = [rng.choice([2, 8, 9, 10, 26, 256]) for _ in range(n)]
            rows.append(([rng.randrange(r) for r in radix], radix))
    out = spark.createDataFrame(rows, "v array<bigint>, r array<bigint>").select("v", "r", pii.feistel(F.col("v"), F.col("r"), "t", "k").alias("m")).collect()
    assert len(out) == 42 and all(r.m == moved_plainly(r.v, r.r, "t", "k") for r in out)


def test_no_difference_of_symbols_survives(spark):
    rng = random.Random(2)
    values = ["".join(rng.choice("0123456789") for _ in range(20)) for _ in range(300)]
    move = lambda vs: spark.createDataFrame([(v,) for v in vs], "v string").select("v", pii.by_class(F.col("v"), "x", "k", False).alias("m")).collect()
    got = move(values)
    for a, b in ((0, 8), (1, 9), (10, 18), (0, 1), (3, 13)):
        assert sum((int(r.v[a]) - int(r.v[b]) - int(r.m[a]) + int(r.m[b])) % 10 == 0 for r in got) < 60
    one = move([f"{c}.-" for c in "abcdefghijklmnopqrstuvwxyz"])
    assert len({r.m for r in one}) == 26 and len({(ord(r.m[0]) - ord(r.v[0])) % 26 for r in one}) > 8


def test_long_values_and_missing_keys(spark):
    text = "a" * 50_000 + "@x.com " + "q@" + "aa." * 20_000 + "com " + "1 " * 50_000 + "x 4111 1111 1111 1111"
    out = pii.pseudonymize(frame(spark, [text]), "key")
    row = out.first()
    assert row.n_private == 3 and row.text != text
    assert pii.pseudonymize(out.select("doc_id", "text"), "key", inverse=True).first().text == text
    for bad in ("", None):
        with pytest.raises(ValueError, match="key"):
            pii.pseudonymize(frame(spark, [text]), bad)
    with pytest.raises(ValueError, match="key"):
        pii.configured_key(spark)


def test_feistel_is_a_permutation(spark):
    every = spark.range(7 * 5 * 3).select(F.array((F.col("id") % 7), F.floor(F.col("id") / 7) % 5, F.floor(F.col("id") / 35)).cast("array<bigint>").alias("v"))
    radix = F.array(*(F.lit(r).cast("bigint") for r in (7, 5, 3)))
    moved = every.select("v", pii.feistel(F.col("v"), radix, "t", "k").alias("m"))
    assert moved.select("m").distinct().count() == 105 and moved.where("v <> m").count() > 80
    assert moved.where(pii.feistel(F.col("m"), radix, "t", "k", inverse=True) != F.col("v")).count() == 0
