"""Queries of clustering and learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.evaluation import rounded
from tessera.catalog.registry import Registry
from tessera.functions import imaging as I
from tessera.operators import learning as L
from tessera.sources import models as M

QUERIES = Registry()
VEC = A.sql("vec") + ", e AS (SELECT vec_id, label, unnest(features) AS f, CAST(generate_subscripts(features, 1) - 1 AS INT) AS dim FROM vec)"
CENTRES = VEC + ", c AS (SELECT label AS cluster, dim, avg(f) AS m FROM e GROUP BY 1, 2)"
NEAR = CENTRES + ", d AS (SELECT vec_id, cluster, round(sum((f - m) * (f - m)), 9) AS dist FROM e JOIN c USING (dim) GROUP BY 1, 2), n AS (SELECT vec_id, cluster, dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) AS rn FROM d) WHERE rn = 1)"


def centroids(spark, d):
    dims = L.dimensions(A.vectors(spark, d), "label").groupBy(F.col("label").alias("cluster"), "dim").agg(F.avg("f").alias("f"))
    return dims.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "f"))), lambda t: t["f"]).alias("mean"))


@QUERIES.add(VEC + ", s AS (SELECT dim, avg(f) AS m, stddev_pop(f) AS s FROM e GROUP BY 1) SELECT vec_id, dim, round((f - m) / s, 6) + 0.0 AS z FROM e JOIN s USING (dim)")
def zscore(spark, d):
    v = A.vectors(spark, d)
    mean, std = L.scaler_arrays(L.scaler(v))
    z = v.select("vec_id", F.posexplode(L.scaled(F.col("features"), mean, std)).alias("dim", "z"))
    return z.withColumn("z", F.round("z", 6) + F.lit(0.0))


@QUERIES.add(NEAR + " SELECT vec_id, cluster, round(dist, 6) AS dist FROM n")
def nearest_centroid(spark, d):
    return rounded(L.nearest(A.vectors(spark, d), centroids(spark, d)), "dist", digits=6)


@QUERIES.add(NEAR + " SELECT cluster, dim, round(avg(f), 9) AS m FROM n JOIN e USING (vec_id) GROUP BY 1, 2")
def kmeans_update(spark, d):
    v = A.vectors(spark, d)
    means = L.cluster_means(v, L.nearest(v, centroids(spark, d)))
    return rounded(means.select("cluster", F.posexplode("mean").alias("dim", "m")), "m")


ROUNDS = 5


def _lloyd_sql() -> str:
    """All rounds one after the other; the answer is that of the first in which few vectors moved, or of the last."""
    parts = [CENTRES.replace(", c AS (", ", c0 AS (")]
    for k in range(1, ROUNDS + 1):
        parts.append(f"d{k} AS (SELECT vec_id, cluster, round(sum((f - m) * (f - m)), 9) AS dist FROM e JOIN c{k - 1} USING (dim) GROUP BY 1, 2)")
        parts.append(f"n{k} AS MATERIALIZED (SELECT vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster) AS rn FROM d{k}) WHERE rn = 1)")
        parts.append(f"c{k} AS MATERIALIZED (SELECT cluster, dim, avg(f) AS m FROM n{k} JOIN e USING (vec_id) GROUP BY 1, 2)")
    still = " UNION ALL ".join(f"SELECT {k} AS k WHERE (SELECT count(*) FROM n{k} a JOIN n{k - 1} b USING (vec_id) WHERE a.cluster <> b.cluster) <= 0.01 * (SELECT count(*) FROM vec)" for k in range(2, ROUNDS + 1))
    parts.append(f"last AS (SELECT coalesce(min(k), {ROUNDS}) AS k FROM ({still}))")
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM c{k}" for k in range(1, ROUNDS + 1))
    return ",\n".join(parts) + f" SELECT cluster, dim, round(m, 9) AS m FROM ({every}) JOIN last USING (k)"


@QUERIES.add(_lloyd_sql())
def kmeans_fit(spark, d):
    found = L.kmeans(A.vectors(spark, d), centroids(spark, d), rounds=ROUNDS)
    return rounded(found.select("cluster", F.posexplode("mean").alias("dim", "m")), "m")


@QUERIES.add(A.sql("raster") + ", b AS (SELECT image_id, x, y, greatest(0, least(4, CAST(floor(x * 5 / 49.0) AS INT))) AS i, greatest(0, least(3, CAST(floor(y * 4 / 10.0) AS INT))) AS j FROM raster) SELECT image_id, x, y, i * 4 + j AS bucket FROM b")
def lattice_bucket(spark, d):
    cells = [I.lattice_cell(F.col("x"), 0.0, 49.0, 5), I.lattice_cell(F.col("y"), 0.0, 10.0, 4)]
    return A.raster(spark, d).select("image_id", "x", "y", I.lattice_bucket(cells, [5, 4]).alias("bucket"))


@QUERIES.add(CENTRES + ", w AS (SELECT cluster AS cls, dim, m AS w FROM c WHERE cluster < 3) SELECT vec_id, cls, round(sum(f * w) + 0.25 * cls, 6) + 0.0 AS score FROM e JOIN w USING (dim) GROUP BY 1, 2")
def linear_score(spark, d):
    models = centroids(spark, d).where("cluster < 3").select(F.col("cluster").alias("cls"), F.col("mean").alias("w"), (F.col("cluster") * 0.25).cast("double").alias("bias"))
    return L.linear_scores(A.vectors(spark, d), models).withColumn("score", F.round("score", 6) + F.lit(0.0))


@QUERIES.add(CENTRES + " SELECT vec_id, cluster AS cls, round(sum(f * m) + 0.25 * cluster, 6) + 0.0 AS score FROM e JOIN c USING (dim) GROUP BY 1, 2")
def linear_score_all(spark, d):
    """The models of all classes."""
    models = centroids(spark, d).select(F.col("cluster").alias("cls"), F.col("mean").alias("w"), (F.col("cluster") * 0.25).cast("double").alias("bias"))
    return L.linear_scores(A.vectors(spark, d), models).withColumn("score", F.round("score", 6) + F.lit(0.0))


def _sech(w: float) -> str:
    return f"(2 / (exp(pi() * {w}) + exp(-pi() * {w})))"


_MAP = [f"sqrt(abs({_sech(0.0)} * x))"]
for _i in range(1, 5):
    _j = (_i + 1) // 2
    _MAP.append(f"sqrt(abs(2 * x * 0.5 * {_sech(_j * 0.5)})) * {'cos' if _i % 2 else 'sin'}({_j * 0.5} * x)")


@QUERIES.add(A.sql("scored") + ", s AS (SELECT category, event_id, score AS x FROM scored)" + "".join(f" {'UNION ALL' if k else ''} SELECT category, event_id, {k} AS i, round({t}, 9) + 0.0 AS v FROM s" for k, t in enumerate(_MAP)))
def kernel_map(spark, d):
    m = I.kernel_map(F.col("score"), I.chi2, 5, 0.5)
    return A.scored(spark, d).select("category", "event_id", F.posexplode(m).alias("i", "v")).withColumn("v", F.round("v", 9) + F.lit(0.0))


@QUERIES.add("""WITH w AS (SELECT CAST(unnest(range(8)) AS INT) AS k), o AS (SELECT k, k * 0.5 AS w FROM w)
SELECT k, 'hellinger' AS kernel, CASE WHEN k = 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS v FROM o UNION ALL SELECT k, 'chi2', round(2 / (exp(pi() * w) + exp(-pi() * w)), 12) FROM o
UNION ALL SELECT k, 'intersection', round(2 / (pi() * (1 + 4 * w * w)), 12) FROM o UNION ALL SELECT k, 'jensen_shannon', round(4 / (ln(4) * (exp(pi() * w) + exp(-pi() * w)) * pi() * (1 + 4 * w * w)), 12) FROM o""")
def kernel_spectra(spark, d):
    rows = [(k, name, f(k * 0.5)) for name, f in I.SPECTRA.items() for k in range(8)]
    return rounded(spark.createDataFrame(rows, "k int, kernel string, v double"), "v", digits=12)


THETAS = [0.1, 0.2, 0.3, 0.5, 0.8]
_T = "t AS (SELECT CAST(unnest([0.1, 0.2, 0.3, 0.5, 0.8]) AS DOUBLE) AS t)"
EX = A.sql("scored") + f", {_T}, x AS (SELECT category AS cls, score AS f, 1.0 + event_id % 3 AS w, CASE WHEN gt = 1 THEN 1.0 ELSE -1.0 END AS z FROM scored)"


@QUERIES.add(EX + " SELECT cls, t, CAST(sum(w) AS DOUBLE) AS p, CAST(sum(CASE WHEN f >= t THEN w ELSE 0 END) AS DOUBLE) AS q, CAST(sum(w * z) AS DOUBLE) AS r, CAST(sum(CASE WHEN f >= t THEN w * z ELSE 0 END) AS DOUBLE) AS u FROM x CROSS JOIN t GROUP BY 1, 2")
def boost_sums(spark, d):
    x = A.scored(spark, d).select(F.col("category").alias("cls"), F.col("score").alias("f"), (1.0 + F.col("event_id") % 3).alias("w"), F.when(F.col("gt") == 1, 1.0).otherwise(-1.0).alias("z"))
    return L.boost_sums(x, THETAS)


#: A model of two shared stumps (fixed values): round, feature, theta, a, b, sharing mask, k.
STUMPS = [(0, 3, 0.01, 1.5, -0.5, 5, [0.1, 0.2, 0.3]), (1, 10, -0.05, -0.75, 0.25, 3, [0.0, 0.5, -0.5])]
_ANSWERS = " + ".join(f"CASE WHEN ({m} >> cls) & 1 = 1 THEN CASE WHEN features[{f + 1}] >= {t} THEN {a + b} ELSE {b} END ELSE [{', '.join(map(str, k))}][cls + 1] END" for _, f, t, a, b, m, k in STUMPS)


@QUERIES.add(A.sql("vec") + f" SELECT vec_id, cls, round(CAST({_ANSWERS} AS DOUBLE), 9) + 0.0 AS score FROM vec, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS cls)")
def boost_score(spark, d):
    stumps = spark.createDataFrame(STUMPS, "round int, feature int, theta double, a double, b double, sharing_mask int, k array<double>")
    return L.boost_scores(A.vectors(spark, d), stumps, 3).withColumn("score", F.round("score", 9) + F.lit(0.0))


def classes(rows, label="label") -> int:
    return rows.agg(F.max(label)).first()[0] + 1


@QUERIES.add()
def boost_train(spark, d):
    rows = A.vectors(spark, d).select(F.col("vec_id").alias("id"), "features", F.col("label").alias("target"))
    model = L.train_boosting(rows, classes(rows, "target"), L.thetas(-0.3, 0.1, 5), 3)
    return spark.createDataFrame([(i, m["feature"], m["theta"], m["a"], m["b"], m["sharing_mask"], m["error"]) for i, m in enumerate(model)], "round int, feature int, theta double, a double, b double, sharing_mask int, error double")


@QUERIES.add(A.sql("scored") + f""", {_T}, s AS (SELECT t, score >= t AS side, gt, count(*) AS n FROM scored CROSS JOIN t GROUP BY 1, 2, 3),
p AS (SELECT *, sum(n) OVER (PARTITION BY t, side) AS total FROM s) SELECT t, round(CAST(-sum(n * ln(CAST(n AS DOUBLE) / total)) AS DOUBLE), 6) AS score FROM p GROUP BY 1""")
def entropy_split(spark, d):
    return rounded(L.entropy_splits(A.scored(spark, d), THETAS, "score", "gt"), "score", digits=6)


#: A complete tree of depth 2: (node, feature, theta), and the leaves' probabilities (fixed values).
TREE, LEAVES = [(0, 0, 0.0), (1, 5, 0.02), (2, 7, -0.01)], [0.9, 0.4, 0.0, 0.7]


@QUERIES.add(A.sql("vec") + """, a AS (SELECT vec_id, features, CAST(features[1] >= 0.0 AS INT) AS i0 FROM vec),
b AS (SELECT vec_id, i0 + 2 * CAST(CASE WHEN i0 = 0 THEN features[6] >= 0.02 ELSE features[8] >= -0.01 END AS INT) AS leaf FROM a)
SELECT vec_id, 0 AS cls, CASE leaf WHEN 0 THEN round(ln(0.9), 9) WHEN 1 THEN round(ln(0.4), 9) WHEN 2 THEN -1e50 ELSE round(ln(0.7), 9) END AS score FROM b""")
def tree_walk(spark, d):
    nodes = spark.createDataFrame([(0, *n) for n in TREE], "tree int, node int, feature int, theta double")
    leaves = spark.createDataFrame([(0, k, 0, p) for k, p in enumerate(LEAVES)], "tree int, leaf int, cls int, prob double")
    out = L.forest_scores(A.vectors(spark, d), nodes, leaves, 2)
    return out.withColumn("score", F.when(F.col("score") < -1e40, F.col("score")).otherwise(F.round("score", 9)))


@QUERIES.add(A.sql("points") + " SELECT frame, count(*) AS n FROM points WHERE frame % 2 = 1 GROUP BY 1")
def split_parity(spark, d):
    return L.parity(A.points(spark, d), "frame", odd=True).groupBy("frame").agg(F.count("*").alias("n"))


@QUERIES.add()
def linear_train(spark, d):
    model = L.train_linear(A.vectors(spark, d), epochs=5)
    return spark.createDataFrame([(k, [float(x) for x in m.coefficients], float(m.intercept)) for k, m in enumerate(model.models)], "cls int, w array<double>, bias double")


@QUERIES.add()
def forest_train(spark, d):
    model = L.train_forest(A.vectors(spark, d), trees=3, depth=3)
    return spark.createDataFrame([(i, w) for i, w in L.importances(model)], "feature int, importance double")


@QUERIES.add()
def gbt_train(spark, d):
    """Trees of every label against the rest."""
    v = A.vectors(spark, d).withColumn("w", F.lit(1.0))
    found = [(k, *t) for k in range(classes(v)) for t in L.importances(L.train_gbt(v.withColumn("label", (F.col("label") == k).cast("int")), weight="w", rounds=3))]
    return spark.createDataFrame(found, "cls int, feature int, importance double")


@QUERIES.add()
def codebook_words(spark, d):
    """Random starts, z-scores, clusters and the word of every vector."""
    v = A.vectors(spark, d)
    return L.Codebook.train(v, 8, rounds=5).words(v)


_DIM = "(1 + dim % 3)"


@QUERIES.add(VEC + f", s AS (SELECT vec_id, dim, CAST(f AS DOUBLE) AS x FROM e), t AS (SELECT vec_id, {_DIM} * (" + " + ".join(f"{k + 1} * ({m})" for k, m in enumerate(_MAP)) + ") AS v FROM s) SELECT vec_id, cls, round(CAST(sum(v) / 10 AS DOUBLE) * (cls + 1) + 0.5 * cls, 6) + 0.0 AS score FROM t, (SELECT CAST(unnest([0, 1]) AS INT) AS cls) GROUP BY 1, 2")
def kernel_svm_score(spark, d):
    """Two fixed models on the kernel maps of all features."""
    w = [(1 + k // 5 % 3) * (k % 5 + 1) / 10 for k in range(5 * 64)]
    models = spark.createDataFrame([(c, [x * (c + 1) for x in w], 0.5 * c) for c in range(2)], "cls int, w array<double>, bias double")
    return L.kernel_svm_scores(A.vectors(spark, d), models, I.chi2).withColumn("score", F.round("score", 6) + F.lit(0.0))


@QUERIES.add()
def kernel_svm_train(spark, d):
    model = L.train_kernel_svm(A.vectors(spark, d), I.chi2, count=3, epochs=5)
    return spark.createDataFrame([(k, [float(x) for x in m.coefficients], float(m.intercept)) for k, m in enumerate(model.models)], "cls int, w array<double>, bias double")


@QUERIES.add(CENTRES + " SELECT cluster, dim, round(m, 9) AS m FROM c")
def kmeans_roundtrip(spark, d):
    """Centres written as a model file and read again."""
    blob = M.pack_kmeans([(r["cluster"], r["mean"]) for r in centroids(spark, d).collect()])
    return rounded(M.kmeans(spark, blob).select("cluster", F.posexplode("mean").alias("dim", "m")), "m")


@QUERIES.add(CENTRES + " SELECT cluster AS cls, dim, round(m, 9) AS w, CAST(0.25 * cluster AS DOUBLE) AS bias FROM c")
def linear_roundtrip(spark, d):
    """Linear models written as a model file and read again."""
    rows = [(r["cluster"], r["mean"], 0.25 * r["cluster"]) for r in centroids(spark, d).collect()]
    back = M.linear(spark, M.pack_linear(rows), len(rows))
    return rounded(back.select("cls", F.posexplode("w").alias("dim", "w"), "bias"), "w")
