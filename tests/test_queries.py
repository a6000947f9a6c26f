"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="session")
def views(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, small, views, name):
    ours = catalog.queries()[name](spark, small).toPandas()
    theirs = views.execute(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_solvers_take_whole_images(spark, small):
    """Every pixel has an answer, the flow equals the cut it is given with, and the energy is that of the labels."""
    from tessera import adapters as A
    from tessera.catalog import graphs

    px = {(r.image_id, r.y * 50 + r.x): r.v for r in A.raster(spark, small).collect()}
    near = [(i, n, n + dy * 50 + dx, 2 / (dx * dx + dy * dy) ** 0.5) for i, n in px for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1)) if 0 <= n % 50 + dx < 50 and (i, n + dy * 50 + dx) in px]
    price = lambda k: (px[k] / 100, abs(px[k] - 500) / 100, (1000 - px[k]) / 100)
    cut = {(r.image_id, r.node): r for r in graphs.max_flow(spark, small).collect()}
    assert set(cut) == set(px)
    for image in {i for i, _ in px}:
        ends = sum(price(k)[0 if r.on_sink else 2] for k, r in cut.items() if k[0] == image)
        across = sum(w for i, u, v, w in near if i == image and cut[i, u].on_sink != cut[i, v].on_sink)
        assert {round(r.flow, 6) for k, r in cut.items() if k[0] == image} == {round(ends + across, 6)}
    for query in (graphs.alpha_expansion, graphs.alpha_expansion_segments):
        got = {(r.image_id, r.node): r for r in query(spark, small).collect()}
        assert set(got) == set(px)
        for image in {i for i, _ in px}:
            plain = sum(price(k)[r.label] for k, r in got.items() if k[0] == image) + sum(w for i, u, v, w in near if i == image and got[i, u].label != got[i, v].label)
            energy = {r.energy for k, r in got.items() if k[0] == image}
            assert len(energy) == 1 and (min(energy) == pytest.approx(plain) if query is graphs.alpha_expansion else min(energy) >= plain - 1e-6)


def test_training_takes_all_rows_labels_and_features(spark, small):
    import numpy as np

    from tessera import adapters as A
    from tessera.catalog import learning
    from tessera.operators import learning as L

    v = A.vectors(spark, small).collect()
    x, label = np.array([r.features for r in v]), np.array([r.label for r in v])
    z = np.where(label[:, None] == np.arange(10), 1.0, -1.0)
    sums = [{"feature": f, "t": t, "cls": c, "p": float(len(v)), "q": float((at := x[:, f] >= t).sum()), "r": z[:, c].sum(), "u": z[at, c].sum()} for f in range(x.shape[1]) for t in L.thetas(-0.3, 0.1, 5) for c in range(10)]
    best = L.best_stump(sums, 10)
    first = learning.boost_train(spark, small).orderBy("round").first()
    assert (first.feature, first.theta, first.sharing_mask) == (best["feature"], best["theta"], best["sharing_mask"])
    assert first.error == pytest.approx(best["error"])
    assert [r.cls for r in learning.linear_train(spark, small).orderBy("cls").collect()] == list(range(10))
    assert {(r.cls, r.feature) for r in learning.gbt_train(spark, small).collect()} == {(c, f) for c in range(10) for f in range(64)}


def test_every_pixel_has_a_word_of_fitted_centres(spark, small):
    from tessera import adapters as A
    from tessera.catalog import filters

    px = {f"{r.image_id}/{r.x}/{r.y}" for r in A.rgb(spark, small).collect()}
    got = filters.colour_sift_words(spark, small).collect()
    assert len(got) == len(px) and {r.key for r in got} == px and len({r.word for r in got}) > 1
