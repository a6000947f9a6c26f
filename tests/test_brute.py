"""Queries that SQL cannot express, against plain versions of what they compute."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog import graphs as CG
from tessera.catalog import learning as CL
from tessera.catalog import regions as CR
from tessera.functions import imaging as I
from tessera.operators import fields
from tessera.operators import learning as L
from tessera.operators import regions as R
from tessera.operators import stencil as S
from tessera.sources import binary as B
from tessera.sources import models as MF
from tessera.sources import sinks as K
from tessera.sources import tables as T


def images(df, *values):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, {})[r.x, r.y] = tuple(r[v] for v in values) if len(values) > 1 else r[values[0]]
    return out


@pytest.fixture(scope="module")
def vectors(spark, small):
    rows = A.vectors(spark, small).orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.features for r in rows]), np.array([r.label for r in rows])


def lloyd(x, means, rounds, change=0.01):
    before = None
    for _ in range(rounds):
        near = ((x[:, None] - means[None]) ** 2).sum(axis=2).round(9).argmin(axis=1)
        kept = [k for k in range(len(means)) if (near == k).any()]
        means = np.array([x[near == k].mean(axis=0) for k in kept])
        if before is not None and (near != before).sum() <= change * len(x):
            break
        before = near
    return means


def test_kmeans(spark, small, vectors):
    _, x, label = vectors
    want = lloyd(x, np.array([x[label == k].mean(axis=0) for k in range(10)]), 5)
    got = CL.kmeans_fit(spark, small).orderBy("cluster", "dim").collect()
    assert np.allclose(np.array([r["m"] for r in got]).reshape(want.shape), want)


def test_codebooks(spark, small, vectors, tmp_path):
    ids, x, _ = vectors
    v = A.vectors(spark, small)
    book = L.Codebook.train(v, 8, rounds=5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    first = L.first_centroids(v.withColumn("features", L.scaled(F.col("features"), book.mean, book.std)), 8).orderBy("cluster").collect()
    starts = np.array([r["mean"] for r in first])
    assert all(np.abs(z - s).max(axis=1).min() < 1e-9 for s in starts)  # rows of the data
    means = lloyd(z, starts, 5)
    words = {r.vec_id: r.word for r in CL.codebook_words(spark, small).collect()}
    near = ((z[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
    pairs = set(zip(near.tolist(), (words[i] for i in ids), strict=True))
    assert len(words) == len(ids) and len(pairs) == len(set(near.tolist()))  # the same clusters
    book.save(f"file://{tmp_path}/book")
    again = L.Codebook.load(spark, f"file://{tmp_path}/book").words(v)
    assert {r.vec_id: r.word for r in again.collect()} == words
    assert L.nearest(v.limit(0), book.centroids).count() == 0


def test_sampled_pixels(spark, small):
    px = A.labelled(spark, small)
    keep = {r.cls: r for r in R.class_weights(px, 2, 0.3).collect()}
    hashed = px.withColumn("u", F.pmod(F.xxhash64("image_id", "pixel", F.lit(0)), F.lit(1_000_000))).collect()
    want = {(r.image_id, r.pixel): keep[r.gt - 1].weight for r in hashed if r.gt and r.u / 1e6 < keep[r.gt - 1].keep}
    assert {(r.image_id, r.pixel): r.weight for r in CR.sampled_pixels(spark, small).collect()} == want


def test_grid_superpixels(spark, small):
    got = images(CR.slic_superpixels(spark, small), "cx", "cy")
    for image, px in images(A.raster(spark, small), "v").items():
        groups = {}
        for (x, y), v in px.items():
            groups.setdefault((x // 5, y // 5), []).append((x, y, v))
        centres = {c: np.mean(m, axis=0) for c, m in groups.items()}

        def assign(centres=centres, px=px):
            out = {}
            for (x, y), v in px.items():
                near = [(x // 5 + i, y // 5 + j) for j in (-1, 0, 1) for i in (-1, 0, 1) if (x // 5 + i, y // 5 + j) in centres]
                out[x, y] = min(near, key=lambda c: (round(4 * ((x - centres[c][0]) ** 2 + (y - centres[c][1]) ** 2) + (v - centres[c][2]) ** 2, 9), c[1], c[0]))
            return out

        for _ in range(2):
            to = assign()
            for c in centres:
                mine = [(*p, px[p]) for p, k in to.items() if k == c]
                centres[c] = np.mean(mine, axis=0) if mine else np.zeros(3)
        assert got[image] == assign()


def modes(px, space, colour):
    """Each pixel on its own, over all pixels of the image."""
    points = np.array([(x / space, y / space, v / colour) for (x, y), v in px.items()])
    weight = np.where(points[:, 2] * colour > 80, 4.0, 1.0)
    out = {}
    for k, p in enumerate(px):
        at = points[k].copy()
        for _ in range(100):
            near = (((points[:, :2] - at[:2]) ** 2).sum(axis=1) < 1) & (weight * (points[:, 2] - at[2]) ** 2 < 1)
            if not near.any():
                break
            new = points[near].mean(axis=0).round(12)
            moved = ((new - at) ** 2).sum()
            at = new
            if moved < 0.01:
                break
        out[p] = at[2] * colour
    return out


def test_mean_shift(spark, small):
    got = images(CR.mean_shift(spark, small), "v")
    for image, px in images(A.raster(spark, small), "v").items():
        want = modes(px, 4.0, 100.0)
        assert set(got[image]) == set(want) and all(got[image][p] == pytest.approx(v) for p, v in want.items())


def flooded(px, alike, steps):
    root = {}
    for p in sorted(px, key=lambda p: (p[1], p[0])):
        if p not in root:
            todo, root[p] = [p], p
            while todo:
                q = todo.pop()
                for dx, dy in steps:
                    n = q[0] + dx, q[1] + dy
                    if n in px and n not in root and alike(px[q], px[n]):
                        root[n] = p
                        todo.append(n)
    return root


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def absorbed(root, px, least):
    """Segments under ``least`` pixels join the nearest touching one until none can."""
    root = dict(root)
    while True:
        members = {}
        for p, s in root.items():
            members.setdefault(s, []).append(p)
        mean = {s: np.mean([px[p] for p in m]) for s, m in members.items()}
        order = {s: k for k, s in enumerate(sorted(members))}
        to = {}
        for s, m in members.items():
            if len(m) < least:
                around = {root[x + dx, y + dy] for x, y in m for dx, dy in FOUR if (x + dx, y + dy) in root} - {s}
                around = [t for t in around if len(members[t]) >= least or order[t] < order[s]]
                if around:
                    to[s] = min(around, key=lambda t: (abs(mean[t] - mean[s]), order[t]))
        if not to:
            return root
        root = {p: to.get(s, s) for p, s in root.items()}


def partition(labels):
    groups = {}
    for p, s in labels.items():
        groups.setdefault(s, set()).add(p)
    return {frozenset(g) for g in groups.values()}


def test_absorbed_regions(spark, small):
    got = images(CR.absorb_small_regions(spark, small), "seg_id")
    for image, px in images(CR.flat(spark, small), "v").items():
        named = {p: r[1] * 100_000 + r[0] for p, r in flooded(px, lambda a, b: abs(a - b) < 1, FOUR).items()}
        assert partition(got[image]) == partition(absorbed(named, px, 4))


def test_mean_shift_segments(spark, small):
    got = images(CR.mean_shift_segments(spark, small), "seg_id")
    for image, px in images(A.raster(spark, small), "v").items():
        mode = modes(px, 4.0, 100.0)
        root = {p: (r[1] << 24) + r[0] for p, r in flooded(mode, lambda a, b: abs(a - b) < 1, EIGHT).items()}
        mean = {s: np.mean([mode[p] for p in root if root[p] == s]) for s in set(root.values())}
        up = {s: s for s in mean}

        def find(s, up=up):
            while up[s] != s:
                s = up[s]
            return s

        for p in root:
            for dx, dy in ((1, 0), (0, 1)):
                q = p[0] + dx, p[1] + dy
                if q in root and root[p] != root[q]:
                    a, b = sorted((root[p], root[q]))
                    if (4 if mean[a] > 80 else 1) * ((mean[a] - mean[b]) / 100) ** 2 < 0.25:
                        x, y = sorted((find(a), find(b)))
                        up[y] = x
        merged = {p: find(s) for p, s in root.items()}
        assert partition(got[image]) == partition(absorbed(merged, mode, 4))


def problem(spark, small, image):
    """One image's field as arrays, by plain loops over its pixels."""
    px = images(A.raster(spark, small), "v")[image]
    order = sorted(px, key=lambda p: (p[1], p[0]))
    number = {p: k for k, p in enumerate(order)}
    edges = [(number[p], number[q], 2 / (dx * dx + dy * dy) ** 0.5) for p in order for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)) if (q := (p[0] + dx, p[1] + dy)) in number]
    return px, order, number, edges


def test_solvers_give_the_energy_of_their_labels(spark, small):
    for query, classes, price in ((CG.range_moves, 10, lambda v, k: abs(v - 100 * k - 50) / 100), (CG.segment_layers, 3, lambda v, k: (v / 100, abs(v - 500) / 100, (1000 - v) / 100)[k])):
        rows = query(spark, small).collect()
        assert len(rows) == A.raster(spark, small).count() and {r.label for r in rows} <= set(range(classes))
        for image in {r.image_id for r in rows}:
            px, order, number, edges = problem(spark, small, image)
            mine = {r.node: r for r in rows if r.image_id == image}
            labels = [mine[y * 50 + x].label for x, y in order]
            assert set(mine) == {y * 50 + x for x, y in order} and len({r.energy for r in mine.values()}) == 1
            energy = sum(price(px[p], c) for p, c in zip(order, labels, strict=True))
            if query is CG.range_moves:
                energy += sum(w / 8 * min(abs(labels[u] - labels[v]), 3) for u, v, w in edges)
                assert next(iter(mine.values())).energy == pytest.approx(energy)
            else:  # segments cost at least nothing, labels that occur their price
                energy += sum(w for u, v, w in edges if labels[u] != labels[v]) + sum((5.0, 20.0, 5.0)[c] for c in set(labels))
                assert next(iter(mine.values())).energy >= energy - 1e-6


def test_joint_query(spark, small):
    rows = CG.joint_moves(spark, small).collect()
    for image in {r.image_id for r in rows}:
        px, order, number, edges = problem(spark, small, image)
        mine = {r.node: r for r in rows if r.image_id == image}
        o, m = ([mine[y * 50 + x][c] for x, y in order] for c in ("object", "sensor"))
        energy = sum((px[p] / 250, (1000 - px[p]) / 250)[a] + abs(px[p] / 200 - b) for p, a, b in zip(order, o, m, strict=True))
        for u, v, w in edges:
            delta = min(abs(m[u] - m[v]), 2.0)
            energy += (w / 4 * (1 + 0.5 * 0.25 * delta) if o[u] != o[v] else 0.0) + 0.25 * delta
        assert next(iter(mine.values())).energy == pytest.approx(energy)


def test_missing_nodes_are_refused(spark):
    unary = spark.createDataFrame([("a", 1, [0.0, 1.0]), ("a", 2, [1.0, 0.0])], "image_id string, node bigint, costs array<double>")
    edges = spark.createDataFrame([("a", 1, 9, 1.0)], "image_id string, u bigint, v bigint, w double")
    with pytest.raises(Exception, match="names a node"):
        CG.G.label_images(unary, edges).collect()
    assert {r.label for r in CG.G.label_images(unary, edges.limit(0)).collect()} == {0, 1}


def accuracy(scores, label):
    return float((scores.argmax(axis=1) == label).mean())


def test_linear_learners_tell_labels_apart(spark, small, vectors):
    _, x, label = vectors
    share = max(np.bincount(label)) / len(label)
    for query, mapped in ((CL.linear_train, x), (CL.kernel_svm_train, None)):
        rows = query(spark, small).orderBy("cls").collect()
        w, b = np.array([r.w for r in rows]), np.array([r.bias for r in rows])
        if mapped is None:
            v = A.vectors(spark, small).select("vec_id", L.mapped(F.col("features"), I.chi2, 3, 0.5).alias("m")).orderBy("vec_id").collect()
            mapped = np.array([r.m for r in v])
        assert accuracy(mapped @ w.T + b, label) > share + 0.1


def test_trees_tell_labels_apart(spark, small, vectors, tmp_path):
    from pyspark.ml.functions import array_to_vector

    v = A.vectors(spark, small)
    shares = {r.feature: r.importance for r in CL.forest_train(spark, small).collect()}
    assert sum(shares.values()) == pytest.approx(1) and set(shares) == set(range(64))
    binary = v.withColumn("label", (F.col("label") < 5).cast("int"))
    model = L.train_gbt(binary, rounds=12, feature_fraction=0.9, patience=3, rate=0.3)
    assert 1 <= model.getNumTrees <= 12 and all(t.depth <= 5 for t in model.trees)
    out = model.transform(binary.withColumn("features", array_to_vector("features")))
    right = out.where("prediction = label").count()
    assert right > 0.7 * out.count()
    K.save_model(model, f"file://{tmp_path}/gbt")
    again = K.save_answers(K.load_model(f"file://{tmp_path}/gbt"), binary, ["vec_id"], f"file://{tmp_path}/answers")
    first = K.save_answers(model, binary, ["vec_id"], f"file://{tmp_path}/first")
    assert {(r.vec_id, r.p) for r in again.collect()} == {(r.vec_id, r.p) for r in first.collect()}
    assert "Tree 0" in "".join(r.value for r in spark.read.text(f"file://{tmp_path}/gbt/text").collect())


def test_early_stop():
    assert L.enough([5, 4, 3, 3.5, 3.4, 3.3, 1], 3) == 3 and L.enough([3, 2, 1], 5) == 3 and L.enough([1, 2, 3], 1) == 1


def test_boosting_over_many_rounds(spark, small, vectors, monkeypatch):
    """Margins stored now and then, against weights that are kept from round to round."""
    monkeypatch.setattr(L, "STORE_ROUNDS", 2)
    ids, x, label = vectors
    x, label = x[:200, :6], label[:200] % 3
    rows = spark.createDataFrame([(i, [float(f) for f in a], int(c)) for i, a, c in zip(ids, x, label, strict=False)], "id bigint, features array<double>, target int")
    thresholds = L.thetas(-0.2, 0.1, 4)
    model = L.train_boosting(rows, 3, thresholds, 6)
    z, w = np.where(label[:, None] == np.arange(3), 1.0, -1.0), np.ones((len(x), 3))
    assert len(model) == 6
    for m in model:
        sums = [{"feature": f, "t": t, "cls": c, "p": w[:, c].sum(), "q": w[at, c].sum(), "r": (w * z)[:, c].sum(), "u": (w * z)[at, c].sum()} for f in range(6) for t in thresholds for c in range(3) for at in [x[:, f] >= t]]
        best = L.best_stump(sums, 3)
        assert (m["feature"], m["theta"], m["sharing_mask"]) == (best["feature"], best["theta"], best["sharing_mask"]) and m["error"] == pytest.approx(best["error"])
        w = w * np.exp(-z * L._answers(x, [best], 3))


def test_forest_files(spark):
    nodes = [(t, n, n % 2, 0.5 * n + t) for t in range(2) for n in range(3)]
    leaves = [(t, k, c, 0.25 * k + c) for t in range(2) for k in range(4) for c in range(2)]
    back = MF.forest(spark, MF.pack_forest(nodes, leaves), 2, 2)
    assert sorted(map(tuple, back[0].collect())) == nodes and sorted(map(tuple, back[1].collect())) == leaves


def test_kernel_machine_files(spark):
    rows = [(c, [c + 0.5 * k for k in range(12)], -1.0 * c) for c in range(3)]
    blob = MF.pack_linear(rows, maps=4)
    assert blob[:4] == b"\x03\0\0\0" and sorted(map(tuple, MF.linear(spark, blob, 3, maps=4).collect())) == rows


def test_words_and_empty_exports(spark, tmp_path):
    words = spark.createDataFrame([("a", 0, 0, 3), ("b", 1, 0, 4)], "image_id string, y int, x int, word int")
    K.save_words(words, f"file://{tmp_path}/words")
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/words").select("image_id", "y", "x", "word").collect()} == {("a", 0, 0, 3), ("b", 1, 0, 4)}
    none = words.select("image_id", F.col("y").alias("seg_id"), F.col("x").alias("pixel")).limit(0)
    assert K.pack_segments(none).count() == 0 and B.segments(K.pack_segments(none)).count() == 0
    palette = spark.createDataFrame([(3, 9, 8, 7)], "label int, r int, g int, b int")
    coloured = K.encode_labels(words.withColumnRenamed("word", "label"), palette).collect()
    assert {(r.image_id, r.r, r.g, r.b) for r in coloured} == {("a", 9, 8, 7), ("b", 0, 0, 0)}
    assert T.SEGMENT != T.DENSE and sorted(T.SEGMENT) == sorted(T.DENSE)


def test_nested_layers_by_table(spark):
    """Two layers as tables give the labels of the same field as arrays."""
    rng = np.random.default_rng(3)
    unary = rng.random((6, 3)).round(3)
    edges = list(itertools.combinations(range(6), 2))
    ids = [10, 20, 30, 40, 50, 60]
    nodes = spark.createDataFrame([("a", n, u.tolist()) for n, u in zip(ids, unary, strict=True)], "image_id string, node bigint, costs array<double>")
    links = spark.createDataFrame([("a", ids[u], ids[v], 0.1) for u, v in edges], "image_id string, u bigint, v bigint, w double")
    members = [(0, 7, n, 1.0) for n in ids[:3]] + [(0, 9, n, 1.0) for n in ids[3:]] + [(1, 1, 7, 3.0), (1, 1, 9, 3.0)]
    segments = spark.createDataFrame([("a", *m) for m in members], "image_id string, layer int, seg_id bigint, node bigint, weight double")
    costs = spark.createDataFrame([("a", layer, s, [0.0, 0.0, 0.1, 2.0]) for layer, s in ((0, 7), (0, 9), (1, 1))], "image_id string, layer int, seg_id bigint, costs array<double>")
    touching = spark.createDataFrame([("a", 0, 7, 9, 0.5)], "image_id string, layer int, a bigint, b bigint, w double")
    out = CG.G.label_images(nodes, links, segments, costs, touching=touching, nested=True, presence=[0.1, 0.2, 0.3]).orderBy("node").collect()
    low = fields.Layer([0, 0, 0, 1, 1, 1], range(6), [1.0] * 6, [[0.0, 0.0, 0.1, 2.0]] * 2, 0.5, ([0], [1], [0.5]))
    high = fields.Layer([0, 0], [0, 1], [3.0, 3.0], [[0.0, 0.0, 0.1, 2.0]], 0.5, below=0)
    f = fields.Field(unary, [u for u, _ in edges], [v for _, v in edges], [0.1] * len(edges), [low, high], np.array([0.1, 0.2, 0.3]))
    state, trail = fields.solve(f)
    assert [r.label for r in out] == state.labels.tolist() and out[0].energy == pytest.approx(trail[-1])


def test_window_of_a_convolution(spark, small):
    px = A.raster(spark, small)
    whole = S.convolve(px, I.gaussian(1.0), "y", 11)
    part = S.convolve_window(px, I.gaussian(1.0), "y", (3, 2, 5, 6), 11)
    assert images(part, "v") == images(whole.where("x BETWEEN 3 AND 7 AND y BETWEEN 2 AND 7"), "v")
