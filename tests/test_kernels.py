"""Hand-computed cases and properties of the kernels."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import imaging as I
from tessera.operators import fields as M_
from tessera.operators.flow import max_flow
from tessera.operators import learning as L
from tessera.operators import metrics as M
from tessera.operators import raster as R
from tessera.operators import regions as S
from tessera.operators import stencil as C
from tessera.sources import binary as B
from tessera.sources import tables as T


def flow_of(n, terminals, edges):
    a = np.array(edges, float).reshape(-1, 4)
    t = np.array(terminals, float).reshape(n, 2)
    flow, side = max_flow(t[:, 0], t[:, 1], a[:, 0].astype(int), a[:, 1].astype(int), a[:, 2], a[:, 3])
    return flow, side.tolist()


def test_two_node_cut():
    assert flow_of(2, [(5, 0), (0, 4)], [(0, 1, 3, 0)]) == (3, [False, True])
    assert flow_of(1, [(2, 2)], []) == (2, [False]) and flow_of(0, [], []) == (0, [])


def _cut(n, terminals, edges, side):
    out = sum(s for (s, _), on in zip(terminals, side, strict=True) if on) + sum(t for (_, t), on in zip(terminals, side, strict=True) if not on)
    return out + sum(c for u, v, c, _ in edges if not side[u] and side[v]) + sum(r for u, v, _, r in edges if side[u] and not side[v])


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_flow_equals_least_cut(data):
    n = data.draw(st.integers(1, 7))
    cap = data.draw(st.sampled_from([st.integers(0, 9), st.floats(0, 5)]))
    terminals = [(data.draw(cap), data.draw(cap)) for _ in range(n)]
    edges = [(u, v, data.draw(cap), data.draw(cap)) for u, v in itertools.combinations(range(n), 2)]
    flow, side = flow_of(n, terminals, edges)
    cuts = {on: _cut(n, terminals, edges, on) for on in itertools.product([False, True], repeat=n)}
    assert flow == pytest.approx(min(cuts.values())) and _cut(n, terminals, edges, side) == pytest.approx(flow)


def _moves(f, s, alpha):
    """All states that an expansion move may reach."""
    options = [{alpha, int(c)} for c in s.labels]
    for layer, c in zip(f.layers, s.chosen, strict=True):
        options += [{alpha} if k == alpha else {alpha, int(k), layer.free} for k in c]
    for t in itertools.product(*options):
        out, at = M_.State(np.array(t[: len(s.labels)])), len(s.labels)
        for c in s.chosen:
            out.chosen.append(np.array(t[at : at + len(c)], dtype=int))
            at += len(c)
        yield out


@pytest.mark.parametrize("kind", ["pixels", "segments", "touching", "nested", "presence"])
def test_expansion_moves_are_the_best_moves(kind):
    rng = random.Random(kind)
    r = rng.random
    for k in range(30):
        layers = []
        if kind != "pixels":
            near = ([0], [1], [r()]) if kind in ("touching", "nested") else ([], [], [])
            layers.append(M_.Layer([0, 0, 1, 1, 1], [0, 1, 1, 2, 3], [r() + 0.1 for _ in range(5)], [[r() for _ in range(3)] + [1 + r()] for _ in range(2)], rng.choice([0.3, 0.5]), near))
        if kind == "nested":
            layers.append(M_.Layer([0, 0], [0, 1], [1.0, 2.0], [[r() for _ in range(3)] + [1 + r()]], 0.5, below=0))
        u, v = zip(*itertools.combinations(range(4), 2), strict=True)
        f = M_.Field([[2 * r() for _ in range(3)] for _ in range(4)], u, v, [0.6 * r() for _ in u], layers, np.array([2 * r() for _ in range(3)]) if kind == "presence" else None, 1.5 if k % 2 else None)
        s = M_.State(np.array([rng.randrange(3) for _ in range(4)]), [np.array([rng.randrange(4) for _ in layer.costs]) for layer in layers])
        alpha = rng.randrange(3)
        assert f.energy(M_.expand(f, s, alpha)) == pytest.approx(min(f.energy(t) for t in _moves(f, s, alpha)))
        _, trail = M_.solve(f)
        assert all(b <= a for a, b in zip(trail, trail[1:]))


def test_energies_by_hand():
    layer = M_.Layer([0] * 4, [0, 1, 2, 3], [1.0] * 4, [[0.0, 0.0, 4.0]], 0.5)
    against = [layer.energies(np.array([0]), np.array([0] * (4 - k) + [1] * k))[0] for k in (0, 1, 2)]
    assert against == [0.0, 2.0, 4.0] and layer.energies(np.array([2]), np.array([0, 1, 0, 1]))[0] == 4.0
    assert layer.dominant(np.array([0, 0, 0, 1]))[0] == 0 and layer.dominant(np.array([0, 0, 1, 1]))[0] == 2
    f = M_.Field([[1, 2, 3], [4, 5, 6]], [0], [1], [2.0], presence=np.array([10.0, 20, 40]))
    assert f.energy(M_.State(np.array([0, 0]))) == 15 and f.energy(M_.State(np.array([0, 2]))) == 1 + 6 + 2 + 50
    f.truncation = 1.5
    assert f.energy(M_.State(np.array([0, 2]))) == 1 + 6 + 3 + 50


def test_two_labels_are_solved_exactly():
    rng = random.Random(3)
    for _ in range(20):
        f = M_.Field([[rng.random() * 4, rng.random() * 4] for _ in range(5)], range(4), range(1, 5), [1.0] * 4)
        s, _ = M_.solve(f)
        assert f.energy(s) == pytest.approx(min(f.energy(M_.State(np.array(c))) for c in itertools.product(range(2), repeat=5)))


def test_range_moves_never_raise_the_energy_and_find_more_than_single_labels():
    rng = random.Random(4)
    worse, gap = 0, 0.0
    for k in range(60):
        u, v = zip(*itertools.combinations(range(4), 2), strict=True)
        f = M_.Field([[rng.random() * 3 for _ in range(6)] for _ in range(4)], u, v, [rng.random() for _ in u], truncation=rng.choice([1, 2, 2.5, 3]))
        s = M_.State(np.array([rng.randrange(6) for _ in range(4)]))
        low, size = rng.randrange(6), rng.choice([1, 2, 3])
        new = M_.expand_range(f, s, low, size)
        assert f.energy(new) <= f.energy(s) + 1e-9 and all(a == b or low <= b < low + size for a, b in zip(s.labels, new.labels, strict=True))
        if size == 1:
            assert f.energy(new) == pytest.approx(f.energy(M_.expand(f, s, low)))
        best = min(f.energy(M_.State(np.array(c))) for c in itertools.product(range(6), repeat=4))
        found = M_.solve(f, size=3)[1][-1]
        gap = max(gap, found / best)
        worse += found > M_.solve(f)[1][-1] + 1e-9
    assert gap < 1.3 and worse < 10


def test_joint_moves_settle_and_two_by_two_is_near_the_best():
    rng = random.Random(7)
    for _ in range(30):
        r = lambda n: np.array([[2 * rng.random() for _ in range(n)] for _ in range(3)])
        j = M_.Joint(r(2), r(4), np.array([0, 1]), np.array([1, 2]), np.array([rng.random(), rng.random()]), 2.0, 0.5, 0.5)
        o, m, trail = M_.solve_joint(j)
        assert trail[-1] == pytest.approx(j.energy(o, m)) and all(b <= a + 1e-9 for a, b in zip(trail[1:], trail[2:]))
        best = min(j.energy(np.array(a), np.array(b)) for a in itertools.product(range(2), repeat=3) for b in itertools.product(range(4), repeat=3))
        assert trail[-1] <= 1.5 * best + 1e-9


def test_a_whole_frame_is_solved():
    """376 x 1242 pixels, 1.9 million edges: one cut equals the price of its sides."""
    h, w = 376, 1242
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:h, 0:w]
    node, u, v, cap = y * w + x, [], [], []
    for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)):
        ok = (x + dx >= 0) & (x + dx < w) & (y + dy < h)
        u.append(node[ok])
        v.append(node[ok] + dy * w + dx)
        cap.append(np.full(ok.sum(), 2 / np.hypot(dx, dy)))
    u, v, cap = map(np.concatenate, (u, v, cap))
    source, sink = (rng.exponential(3.0, h * w) for _ in range(2))
    flow, side = max_flow(source, sink, u, v, cap, cap)
    assert flow == pytest.approx(source[side].sum() + sink[~side].sum() + cap[side[u] != side[v]].sum())


def image(spark, values, name="a"):
    return spark.createDataFrame([(name, x, y, float(v)) for y, row in enumerate(values) for x, v in enumerate(row)], "image_id string, x int, y int, v double")


def grid(df, value, w, h):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


RAMP = [[x + 10 * y for x in range(5)] for y in range(5)]


def test_integral_image_corners_are_direct_sums(spark):
    px = image(spark, RAMP)
    table = C.integral(px)
    assert grid(table, "s", 5, 5)[4, 4] == np.sum(RAMP)
    shapes = spark.createDataFrame([(0, -1, -1, 3, 3)], "shape_id int, dx int, dy int, w int, h int")
    sums = grid(C.rectangle_sums(table, px, shapes, 5, 5), "total", 5, 5)
    a = np.array(RAMP)
    assert sums[2, 2] == a[1:4, 1:4].sum() and sums[0, 0] == a[:2, :2].sum()


def test_gradient_of_a_ramp(spark):
    g = C.gradient(image(spark, RAMP))
    assert grid(g, "dx", 5, 5)[2, 2] == 1 and grid(g, "dy", 5, 5)[2, 2] == 10
    assert grid(g, "dx", 5, 5)[2, 4] == 0 and grid(g, "dy", 5, 5)[4, 2] == 0
    assert grid(C.gradient(image(spark, RAMP), central=True), "dx", 5, 5)[2, 2] == 2


def test_constant_image_and_the_far_border(spark):
    px = image(spark, [[3] * 7] * 7)
    right = grid(C.convolve(px, I.gaussian(1.0), "x", legacy_edge=False), "v", 7, 7)
    assert np.allclose(right, 3)
    legacy = grid(C.convolve(px, I.gaussian(1.0), "x"), "v", 7, 7)
    assert np.allclose(legacy[:, :4], 3) and (legacy[:, 4:] < 3).all()


def test_taps():
    assert sum(I.gaussian(2.0)) == pytest.approx(1) and len(I.gaussian(2.0)) == 13
    assert sum(I.gaussian_curvature(1.0)) == pytest.approx(0, abs=1e-12)
    assert len({n for n, *_ in I.texton_bank()}) == 17


def test_negative_columns_truncate_to_zero(spark):
    df = spark.createDataFrame([(0, 1, 10.0, 4.0, 0.0, 0.0)], "frame int, idx long, x double, y double, z double, refl double")
    m = [[0.0, -1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
    assert [(r.u, r.v) for r in R.project_points(df, m, 5, 5).collect()] == [(0, 0)]


def test_last_point_of_a_cell_survives(spark):
    df = spark.createDataFrame([(1, 0, 0, float(i), 0.0, 0.0, 0.0) for i in (1, 3, 2)], "frame int, u int, v int, idx double, x double, y double, z double").withColumnRenamed("idx", "k").selectExpr("frame", "u", "v", "cast(k as bigint) idx", "x", "y", "z", "k refl")
    assert [r.idx for r in R.last_per_cell(df, "frame", "u", "v").collect()] == [3]


def test_plane_and_line_neighbourhoods(spark):
    flat = [(0, x, y, x * 0.1, y * 0.1, 0.0) for x in range(5) for y in range(4)]
    px = spark.createDataFrame(flat, "frame int, u int, v int, x double, y double, z double")
    pairs = R.neighbours(px, 10.0, 8)
    shape = R.shape_features(R.scatter(pairs)).collect()
    assert len(shape) == 20 and all(s.height_var == 0 for s in shape)
    assert all(r.max_hdiff == 0 for r in R.height_range(pairs).collect())
    line = spark.createDataFrame([(0, k, 0, k * 0.1, 0.0, 0.0) for k in range(5)], "frame int, u int, v int, x double, y double, z double")
    assert all(s.curvature == pytest.approx(1) for s in R.shape_features(R.scatter(R.neighbours(line, 10.0, 8))).collect())


def test_curvature_is_the_largest_eigenvalue_share(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 3))
    m = a @ a.T
    row = [(0, 0, 0, 5, *(float(m[i, j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))))]
    df = spark.createDataFrame(row, "frame int, u int, v int, n long, sxx double, sxy double, sxz double, syy double, syz double, szz double")
    e = np.linalg.eigvalsh(m)
    assert R.shape_features(df).first().curvature == pytest.approx(e[-1] / e.sum())


def test_curve_by_hand(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, gt int")
    c = {r.k: r for r in M.pr_curve(df, steps=10).collect()}
    assert [(c[k].fn, c[k].fp) for k in (0, 4, 5)] == [(0, 2), (0, 1), (1, 0)]


def test_void_and_empty_classes(spark):
    px = spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "gt int, pred int")
    m = {r.cls: r for r in M.class_metrics(M.confusion(px), 3).collect()}
    assert m[1].gt_n == 2 and m[1].recall == 0.5 and m[3].recall == 0 and m[3].iou == 0
    assert M.summary(M.class_metrics(M.confusion(px), 3)).first().average == pytest.approx(0.5 / 3)


def test_two_blobs(spark):
    px = image(spark, [[0, 0, 9, 9]] * 3)
    seg = S.merge_modes(px)
    assert len({r.seg for r in seg.collect()}) == 2
    members = seg.withColumnRenamed("seg", "seg_id")
    assert S.adjacency(members).count() == 2
    assert [r.length for r in S.boundary_length(members, 4, 3).collect()] == [2]


def test_mean_shift_keeps_two_levels():
    xy = np.array([(x, y) for y in range(3) for x in range(6)], float)
    v = np.where(xy[:, :1] < 3, 10.0, 60.0)
    out = S.shift_modes(xy, v, 4.0, 10.0)
    assert np.allclose(out, v)


def test_highest_value_falls_into_the_last_bucket(spark):
    df = spark.createDataFrame([(0.0,), (9.99,), (10.0,)], "v double")
    assert [r[0] for r in df.select(I.lattice_cell(df.v, 0.0, 10.0, 5)).collect()] == [0, 4, 4]


def test_stump_takes_the_upper_branch_at_its_threshold(spark):
    v = spark.createDataFrame([(1, [0.5])], "vec_id int, features array<double>")
    m = spark.createDataFrame([(0, 0, 0.5, 2.0, 1.0, 1, [0.0])], "round int, feature int, theta double, a double, b double, sharing_mask int, k array<double>")
    assert L.boost_scores(v, m, 1).first().score == 3.0


def test_boosting_separates_a_plain_case(spark):
    rows = spark.createDataFrame([(i, [float(i % 3)], i % 3) for i in range(30)], "id int, features array<double>, target int")
    model = L.train_boosting(rows, 3, [0.5, 1.5], 4)
    assert model[0]["feature"] == 0 and all(0 < m["sharing_mask"] < 7 for m in model)


def test_png_and_binary_layouts(spark):
    img = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    assert (B.read_png(B.write_png(img)) == img).all()
    df = spark.createDataFrame([("f", bytearray(B.pack_segments([[1, 2], [], [7]])))], "stem string, content binary")
    assert [(r.seg_id, r.pixel) for r in B.segments(df).collect()] == [(0, 1), (0, 2), (2, 7)]
    cost = np.array([2, 1, 2], "<i4").tobytes() + np.array([1, 2, 3, 4], "<f8").tobytes()
    df = spark.createDataFrame([("f", bytearray(cost))], "stem string, content binary")
    assert [(r.y, r.x, r.scores) for r in B.dense_costs(df).collect()] == [(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0])]


def test_calibration_errors(spark):
    df = spark.createDataFrame([("f", "P0: 1 2"), ("f", "# no"), ("f", "")], "frame_id string, value string")
    assert T.parse_calibration(df, "frame_id").first()["values"] == [1.0, 2.0]
    with pytest.raises(Exception, match="lacks"):
        T.require(T.parse_calibration(df, "frame_id"), "frame_id", ["P2"]).collect()
    bad = spark.createDataFrame([("f", "P0 1 2")], "frame_id string, value string")
    with pytest.raises(Exception, match="without one colon"):
        T.parse_calibration(bad, "frame_id").collect()


def test_model_files(spark):
    import struct

    from tessera.sources import models

    stumps = [(0, 3, 0.5, 1.0, -1.0, 5, [0.1, 0.2, 0.3]), (1, 1, -2.0, 0.5, 0.25, 2, [0.0, 0.0, 1.0])]
    assert [tuple(r) for r in models.boosting(spark, models.pack_boosting(stumps), 3).collect()] == stumps
    lin = struct.pack("<i6d", 2, 1, 2, 3, 4, 0.5, -0.5)
    assert [tuple(r) for r in models.linear(spark, lin, 2).collect()] == [(0, [1.0, 2.0], 0.5), (1, [3.0, 4.0], -0.5)]
    tree = struct.pack("<i4d1d1i", 1, 0.9, 0.1, 0.2, 0.8, 0.0, 0)
    nodes, leaves = models.forest(spark, tree, 2, 1)
    v = spark.createDataFrame([(1, [0.5])], "vec_id int, features array<double>")
    got = {r.cls: r.score for r in L.forest_scores(v, nodes, leaves, 1).collect()}
    assert got[0] == pytest.approx(np.log(0.2)) and got[1] == pytest.approx(np.log(0.8))
    means = struct.pack("<2i4d", 2, 2, 0, 0, 1, 1)
    assert [r["mean"] for r in models.kmeans(spark, means).orderBy("cluster").collect()] == [[0.0, 0.0], [1.0, 1.0]]
