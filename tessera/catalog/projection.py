"""Queries of projection, rasters, neighbourhoods, colours and warps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.evaluation import rounded
from tessera.catalog.registry import Registry
from tessera.functions import geometry as G
from tessera.functions import imaging as I
from tessera.operators import raster as R
from tessera.sources import binary as B
from tessera.sources import tables as T

QUERIES = Registry()

#: Calibration of the demonstration scan (fixed values): camera, rectification, sensor to camera.
P2 = [[60.0, 0.0, 32.0, 4.0], [0.0, 60.0, 24.0, 2.0], [0.0, 0.0, 1.0, 0.5]]
R0 = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
TR = [[0.0, -1.0, 0.0, 0.0], [0.0, 0.0, -1.0, 0.0], [1.0, 0.0, 0.0, 0.0]]
W_, H_ = 64, 48
FUSED = G.fuse(P2, R0, TR)


def _line(row):
    return " + ".join([f"CAST({row[0]} AS DOUBLE) * x", f"CAST({row[1]} AS DOUBLE) * y", f"CAST({row[2]} AS DOUBLE) * z", f"CAST({row[3]} AS DOUBLE)"])


PROJECTED = A.sql("points") + f""",
shot AS (SELECT *, CAST(trunc(({_line(FUSED[0])}) / ({_line(FUSED[2])})) AS INT) AS u, CAST(trunc(({_line(FUSED[1])}) / ({_line(FUSED[2])})) AS INT) AS v FROM points WHERE x > 5 AND x < 80),
proj AS (SELECT * FROM shot WHERE u >= 0 AND u < {W_} AND v >= 0 AND v < {H_}),
cells AS (SELECT frame, u, v, max(idx) AS idx, arg_max(x, idx) AS x, arg_max(y, idx) AS y, arg_max(z, idx) AS z, arg_max(refl, idx) AS refl FROM proj GROUP BY 1, 2, 3)"""


def projected(spark, d):
    return R.project_points(A.points(spark, d), FUSED, W_, H_)


def pixels(spark, d):
    return R.last_per_cell(projected(spark, d), "frame", "u", "v")


@QUERIES.add(PROJECTED + " SELECT frame, idx, u, v, refl FROM proj")
def project_points(spark, d):
    return projected(spark, d).select("frame", "idx", "u", "v", "refl")


@QUERIES.add(PROJECTED + " SELECT frame, u, v, idx, x, y, round(z, 9) AS z, refl FROM cells")
def last_value_per_cell(spark, d):
    return rounded(pixels(spark, d), "z")


@QUERIES.add(A.sql("points") + """ SELECT DISTINCT frame, gx, gy FROM (SELECT frame, CAST(trunc(400 - y / CAST(0.2 AS DOUBLE)) AS INT) AS gx, CAST(trunc(400 - x / CAST(0.2 AS DOUBLE)) AS INT) AS gy FROM points)
WHERE gx >= 0 AND gx < 800 AND gy >= 0 AND gy < 800""")
def occupancy_grid(spark, d):
    return R.occupancy(A.points(spark, d))


@QUERIES.add(PROJECTED + """,
calib AS (SELECT DISTINCT frame, 'calib_' || frame AS calib FROM points),
truth AS (SELECT frame, count(*) AS n_points FROM points GROUP BY 1)
SELECT c.frame, k.calib, t.n_points, count(*) AS n_valid, round(avg(refl), 6) AS mean_refl FROM cells c JOIN calib k USING (frame) JOIN truth t USING (frame) GROUP BY 1, 2, 3""")
def frame_join(spark, d):
    """Scan, calibration, valid pixels and truth meet on the frame; the small sides are left to the
    optimizer's size check."""
    pts = A.points(spark, d)
    calib = pts.select("frame").distinct().withColumn("calib", F.concat(F.lit("calib_"), F.col("frame").cast("string")))
    truth = pts.groupBy("frame").agg(F.count("*").alias("n_points"))
    joined = T.join_frames(pixels(spark, d), calib, truth)
    return joined.groupBy("frame", "calib", "n_points").agg(F.count("*").alias("n_valid"), F.round(F.avg("refl"), 6).alias("mean_refl"))


RADIUS, TILE = 3.0, 8
PAIRS = PROJECTED + f""",
pairs AS (SELECT a.frame, a.u, a.v, b.u AS n_u, b.v AS n_v, b.x AS nx, b.y AS ny, b.z AS nz,
 sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist FROM cells a JOIN cells b ON a.frame = b.frame
 AND abs(a.u - b.u) <= (a.v // 100 + 1) * 5 AND abs(a.v - b.v) <= (a.v // 100 + 1) * 5
 WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= {RADIUS})"""


def pairs(spark, d):
    return R.neighbours(pixels(spark, d), RADIUS, TILE)


@QUERIES.add(PAIRS + " SELECT frame, u, v, n_u, n_v, round(dist, 9) AS dist FROM pairs")
def range_self_join(spark, d):
    return rounded(pairs(spark, d).select("frame", "u", "v", "n_u", "n_v", "dist"), "dist")


@QUERIES.add(PAIRS + " SELECT frame, u, v, count(*) AS n, round(max(nz) - min(nz), 9) AS max_hdiff FROM pairs GROUP BY 1, 2, 3 HAVING count(*) > 1")
def height_range(spark, d):
    return rounded(R.height_range(pairs(spark, d)), "max_hdiff")


SCATTER = PAIRS + """,
means AS (SELECT frame, u, v, count(*) AS n, avg(dist) AS mu, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz FROM pairs GROUP BY 1, 2, 3 HAVING count(*) > 1),
centred AS (SELECT p.frame, p.u, p.v, n, CASE WHEN mu = 0 THEN 1.0 WHEN dist >= mu THEN exp(-(dist / mu) * (dist / mu)) ELSE 1.0 END AS w, nx - mx AS x, ny - my AS y, nz - mz AS z FROM pairs p JOIN means m ON p.frame = m.frame AND p.u = m.u AND p.v = m.v)
SELECT frame, u, v, n, round(sum(w * x * x), 6) AS sxx, round(sum(w * x * y), 6) AS sxy, round(sum(w * x * z), 6) AS sxz, round(sum(w * y * y), 6) AS syy, round(sum(w * y * z), 6) AS syz, round(sum(w * z * z), 6) AS szz FROM centred GROUP BY 1, 2, 3, 4"""


def clean_zero(df, *names, digits=6):
    """Rounded, with -0.0 as 0.0."""
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


@QUERIES.add(SCATTER.replace("round(sum(w * x * y), 6)", "round(sum(w * x * y), 6) + 0.0").replace("round(sum(w * x * z), 6)", "round(sum(w * x * z), 6) + 0.0").replace("round(sum(w * y * z), 6)", "round(sum(w * y * z), 6) + 0.0"))
def scatter_matrix(spark, d):
    return clean_zero(R.scatter(pairs(spark, d)), "sxx", "sxy", "sxz", "syy", "syz", "szz")


SHAPES = SCATTER.replace("SELECT frame, u, v, n, round", ", s AS (SELECT frame, u, v, n, round") .replace("round(sum(", "(sum(").replace("), 6)", "))") + """),
q AS (SELECT *, (sxx + syy + szz) / 3 AS q FROM s),
p AS (SELECT *, sqrt(((sxx - q) * (sxx - q) + (syy - q) * (syy - q) + (szz - q) * (szz - q) + 2 * (sxy * sxy + sxz * sxz + syz * syz)) / 6) AS p,
 (sxx - q) * ((syy - q) * (szz - q) - syz * syz) - sxy * (sxy * (szz - q) - syz * sxz) + sxz * (sxy * syz - (syy - q) * sxz) AS det FROM q),
r AS (SELECT *, greatest(-1.0, least(1.0, CASE WHEN p = 0 THEN 1.0 ELSE det / 2 / (p * p * p) END)) AS r FROM p)
SELECT frame, u, v, round(CASE WHEN q = 0 THEN 0.0 ELSE (q + 2 * p * cos(acos(r) / 3)) / (3 * q) END, 6) AS curvature, round(szz, 6) AS height_var, n AS weight FROM r"""


@QUERIES.add(SHAPES)
def shape_features(spark, d):
    return rounded(R.shape_features(R.scatter(pairs(spark, d))), "curvature", "height_var", digits=6)


@QUERIES.add(A.sql("rgb") + " SELECT image_id, x, y, round((r - g) / sqrt(2), 9) AS o1, round((r + g - 2 * b) / sqrt(6), 9) AS o2, round((r + g + b) / sqrt(3), 9) AS o3 FROM rgb")
def opponent_colour(spark, d):
    o = I.opponent(F.col("r"), F.col("g"), F.col("b"))
    return rounded(A.rgb(spark, d).select("image_id", "x", "y", *(c.alias(f"o{k + 1}") for k, c in enumerate(o))), "o1", "o2", "o3")


def _linear_sql(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.04045 * 255 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)"


SPACES = A.sql("rgb") + f""",
lin AS (SELECT image_id, x, y, CAST({_linear_sql("r")} AS DOUBLE) AS lr, CAST({_linear_sql("g")} AS DOUBLE) AS lg, CAST({_linear_sql("b")} AS DOUBLE) AS lb FROM rgb),
xyz AS (SELECT image_id, x, y, {", ".join(f"{r[0]} * lr + {r[1]} * lg + {r[2]} * lb AS c{n}" for r, n in zip(I.XYZ, "xyz", strict=True))} FROM lin),
f AS (SELECT *, {", ".join(f"CASE WHEN c{n} / {w} > 216.0 / 24389 THEN cbrt(c{n} / {w}) ELSE (c{n} / {w} * (24389.0 / 27) + 16) / 116 END AS f{n}" for n, w in zip("xyz", I.WHITE, strict=True))} FROM xyz)
SELECT image_id, x, y, round(116 * fy - 16, 6) + 0.0 AS l, round(500 * (fx - fy), 6) + 0.0 AS a, round(200 * (fy - fz), 6) + 0.0 AS b,
round(CASE WHEN cx + 15 * cy + 3 * cz = 0 THEN 0 ELSE 13 * (116 * fy - 16) * (4 * cx / (cx + 15 * cy + 3 * cz) - {4 * I.WHITE[0] / (I.WHITE[0] + 15 + 3 * I.WHITE[2])!r}) END, 6) + 0.0 AS u,
round(CASE WHEN cx + 15 * cy + 3 * cz = 0 THEN 0 ELSE 13 * (116 * fy - 16) * (9 * cy / (cx + 15 * cy + 3 * cz) - {9 / (I.WHITE[0] + 15 + 3 * I.WHITE[2])!r}) END, 6) + 0.0 AS v FROM f"""


@QUERIES.add(SPACES)
def colour_spaces(spark, d):
    rgb = [F.col(c) for c in "rgb"]
    (l, a, b), (_, u, v) = I.lab(*rgb), I.luv(*rgb)
    return clean_zero(A.rgb(spark, d).select("image_id", "x", "y", l.alias("l"), a.alias("a"), b.alias("b"), u.alias("u"), v.alias("v")), *"labuv")


@QUERIES.add(A.sql("rgb") + " SELECT image_id, x, y, round(greatest(0.0, least(1.0, 1.0 - (CAST(abs(r - 128) AS DOUBLE) / 128 + CAST(abs(g - 128) AS DOUBLE) / 128 + CAST(abs(b - 128) AS DOUBLE) / 128) / 3)), 9) AS conf FROM rgb")
def colour_confidence(spark, d):
    return rounded(A.rgb(spark, d).select("image_id", "x", "y", I.confidence(F.col("r"), F.col("g"), F.col("b")).alias("conf")), "conf")


@QUERIES.add(A.sql("scored") + " SELECT category, event_id, CAST(floor(score * 255) AS INT) AS cut, CAST(greatest(0.0, least(255.0, round_even(score * 255, 0))) AS INT) AS rounded FROM scored")
def quantize_u8(spark, d):
    return A.scored(spark, d).select("category", "event_id", I.to_u8(F.col("score")).alias("cut"), I.to_u8(F.col("score"), rounding=True).alias("rounded"))


@QUERIES.add(A.sql("scored") + " SELECT category, event_id, CASE WHEN score > 0.5 THEN 'green' ELSE 'red' END AS colour FROM scored")
def threshold_color(spark, d):
    return A.scored(spark, d).select("category", "event_id", I.threshold_colour(F.col("score")).alias("colour"))


@QUERIES.add(A.sql("rgb") + " SELECT image_id, x, y, CAST(b > 0 AS INT) AS road, CAST(r > 0 AS INT) AS valid FROM rgb")
def label_binarize(spark, d):
    return B.ground_truth(A.rgb(spark, d).withColumn("bands", F.array("r", "g", "b"))).select("image_id", "x", "y", "road", "valid")


BEV = G.BirdsEye(1.0, (-10.0, 10.0), (6.0, 26.0))
#: Ground plane to image (fixed values), and back.
TO_IMAGE = [[2.0, 0.5, 12.0], [0.0, 0.25, 1.0], [0.0, 0.05, 1.0]]
TO_GROUND = np.linalg.inv(TO_IMAGE).tolist()


@QUERIES.add(A.sql("points") + " SELECT frame, idx, round((y + 10.0) / 1.0, 9) AS col, round(20.0 - (x - 6.0) / 1.0, 9) AS row_, round(y / 1.0 * 1.0 - 10.0, 9) AS mx, round((20.0 - x) * 1.0 + 6.0, 9) AS mz FROM points")
def bev_index(spark, d):
    col, row = BEV.to_pixel(F.col("y"), F.col("x"))
    mx, mz = BEV.to_metric(F.col("y"), F.col("x"))
    return rounded(A.points(spark, d).select("frame", "idx", col.alias("col"), row.alias("row_"), mx.alias("mx"), mz.alias("mz")), "col", "row_", "mx", "mz")


def _plane_sql(m, x, z):
    t = [f"(CAST({r[0]} AS DOUBLE) * ({x}) + CAST({r[1]} AS DOUBLE) * ({z}) + CAST({r[2]} AS DOUBLE))" for r in m]
    return f"{t[0]} / {t[2]}", f"{t[1]} / {t[2]}"


_U, _V = _plane_sql(TO_IMAGE, "y", "x")


@QUERIES.add(A.sql("points") + f" SELECT frame, idx, round(u, 6) AS u, round(v, 6) AS v FROM (SELECT frame, idx, {_U} AS u, {_V} AS v FROM points WHERE x > 0) WHERE u >= 1 AND u <= 50 AND v >= 1 AND v <= 11")
def homography(spark, d):
    u, v = G.plane(TO_IMAGE, F.col("y"), F.col("x"))
    return rounded(A.points(spark, d).where("x > 0").select("frame", "idx", u.alias("u"), v.alias("v")).where("u >= 1 AND u <= 50 AND v >= 1 AND v <= 11"), "u", "v", digits=6)


_CU, _CV = _plane_sql(TO_IMAGE, "col * CAST(1.0 AS DOUBLE) + (-9.5)", "CAST(25.5 AS DOUBLE) - row_ * CAST(1.0 AS DOUBLE)")
WARPED = A.sql("raster") + f""",
cells AS (SELECT CAST(id % 20 AS INT) AS col, CAST(id // 20 AS INT) AS row_ FROM (SELECT unnest(range(400)) AS id)),
lut AS (SELECT col, row_, CAST(trunc(u) AS INT) - 1 AS x, CAST(trunc(v) AS INT) - 1 AS y FROM (SELECT col, row_, {_CU} AS u, {_CV} AS v FROM cells) WHERE u >= 1 AND u <= 50 AND v >= 1 AND v <= 11),
bev AS (SELECT f.image_id, c.col, c.row_, coalesce(r.v, 0) AS v FROM (SELECT DISTINCT image_id FROM raster) f CROSS JOIN cells c LEFT JOIN lut l ON c.col = l.col AND c.row_ = l.row_ LEFT JOIN raster r ON r.image_id = f.image_id AND r.x = l.x AND r.y = l.y)"""


@QUERIES.add(WARPED + " SELECT image_id, col, row_, v FROM bev")
def bev_lut_join(spark, d):
    return R.warp(A.raster(spark, d), BEV, TO_IMAGE, 50, 11, "v").withColumnRenamed("row", "row_")


_GX, _GZ = _plane_sql(TO_GROUND, "x + CAST(1.0 AS DOUBLE)", "y + CAST(1.0 AS DOUBLE)")


@QUERIES.add(WARPED + f""",
px AS (SELECT CAST(id % 50 AS INT) AS x, CAST(id // 50 AS INT) AS y FROM (SELECT unnest(range(550)) AS id)),
ground AS (SELECT x, y, {_GX} AS gx, {_GZ} AS gz FROM px),
back AS (SELECT x, y, TRY_CAST(round_even((gx + 10.0) / 1.0, 0) AS INT) AS c, TRY_CAST(round_even(20.0 - (gz - 6.0) / 1.0, 0) AS INT) AS r FROM ground WHERE abs(gx) < 1e6 AND abs(gz) < 1e6)
SELECT b.image_id, k.x, k.y, b.v FROM back k JOIN bev b ON b.col = k.c - 1 AND b.row_ = k.r - 1 WHERE k.c BETWEEN 1 AND 20 AND k.r BETWEEN 1 AND 20""")
def bev_reverse(spark, d):
    view = R.warp(A.raster(spark, d), BEV, TO_IMAGE, 50, 11, "v")
    return R.unwarp(view, BEV, TO_GROUND, 50, 11, "v")
