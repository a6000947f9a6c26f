"""Queries of the stencil operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.evaluation import rounded
from tessera.catalog.registry import Registry
from tessera.functions import imaging as I
from tessera.operators import stencil as S

QUERIES = Registry()
W_, H_ = A.WIDTH, A.HEIGHT
GAUSS = I.gaussian(1.0)


def _taps_sql(name: str, taps) -> str:
    c = len(taps) // 2
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({k - c}, CAST({t!r} AS DOUBLE))' for k, t in enumerate(taps))}) t(off, tap))"


def _pass(out: str, src: str, taps: str, axis: str, most: int, centre: int) -> str:
    """A convolution as a join on clamped coordinates."""
    place = f"greatest(0, least({most}, p.{axis} + t.off))"
    x, y = (place, "p.y") if axis == "x" else ("p.x", place)
    return f"{out} AS (SELECT p.image_id, p.x, p.y, sum(CASE WHEN t.off = {centre} AND p.{axis} + t.off > {most} THEN 0.0 ELSE t.tap * q.v END) AS v FROM {src} p CROSS JOIN {taps} t JOIN {src} q ON q.image_id = p.image_id AND q.x = {x} AND q.y = {y} GROUP BY 1, 2, 3)"


@QUERIES.add(f"{A.sql('raster')}, {_taps_sql('g', GAUSS)}, {_pass('c', 'raster', 'g', 'x', W_ - 1, 3)} SELECT image_id, x, y, round(v, 6) AS v FROM c")
def convolve_x(spark, d):
    return rounded(S.convolve(A.raster(spark, d), GAUSS, "x", W_), "v", digits=6)


@QUERIES.add(f"{A.sql('raster')}, {_taps_sql('g', GAUSS)}, {_pass('c', 'raster', 'g', 'x', W_ - 1, 3)} SELECT image_id, x, y, round(v, 6) AS v FROM c WHERE x BETWEEN 20 AND 49 AND y BETWEEN 2 AND 8")
def convolve_window(spark, d):
    return rounded(S.convolve_window(A.raster(spark, d), GAUSS, "x", (20, 2, 30, 7), W_), "v", digits=6)


@QUERIES.add(f"{A.sql('raster')}, {_taps_sql('g', GAUSS)}, {_pass('c', 'raster', 'g', 'y', H_ - 1, 3)} SELECT image_id, x, y, round(v, 6) AS v FROM c")
def convolve_y(spark, d):
    return rounded(S.convolve(A.raster(spark, d), GAUSS, "y", H_), "v", digits=6)


@QUERIES.add(f"{A.sql('raster')}, {_taps_sql('g', GAUSS)}, {_taps_sql('e', I.gaussian_slope(1.0))}, {_pass('a', 'raster', 'e', 'x', W_ - 1, 3)}, {_pass('c', 'a', 'g', 'y', H_ - 1, 3)} SELECT image_id, x, y, round(v, 6) + 0.0 AS v FROM c")
def convolve_xy(spark, d):
    out = S.separable(A.raster(spark, d), I.gaussian_slope(1.0), GAUSS, (W_, H_))
    return out.withColumn("v", F.round("v", 6) + F.lit(0.0))


LOG = f"""{A.sql('raster')}, {_taps_sql('g', GAUSS)}, {_taps_sql('e', I.gaussian_curvature(1.0))}, {_pass('a1', 'raster', 'e', 'x', W_ - 1, 3)}, {_pass('c1', 'a1', 'g', 'y', H_ - 1, 3)},
{_pass('a2', 'raster', 'g', 'x', W_ - 1, 3)}, {_pass('c2', 'a2', 'e', 'y', H_ - 1, 3)}
SELECT image_id, x, y, round(c1.v + c2.v, 6) + 0.0 AS v FROM c1 JOIN c2 USING (image_id, x, y)"""


@QUERIES.add(LOG)
def laplacian(spark, d):
    return S.laplacian(A.raster(spark, d), 1.0, (W_, H_)).withColumn("v", F.round("v", 6) + F.lit(0.0))


_G = "exp(-CAST(k * k AS DOUBLE) / (2 * s * s))"


@QUERIES.add(f"""WITH sig AS (SELECT CAST(unnest([1.0, 2.0, 4.0]) AS DOUBLE) AS s), p AS (SELECT s, CAST(unnest(range(-CAST(floor(3 * s) AS INT), CAST(floor(3 * s) AS INT) + 1)) AS INT) AS k FROM sig),
raw AS (SELECT s, k, {_G} AS g, -k * {_G} / (sqrt(2 * pi()) * s * s * s) AS d1, (k * k - s * s) * {_G} / (sqrt(2 * pi()) * s * s * s * s * s) AS d2 FROM p)
SELECT s AS sigma, k, round(g / sum(g) OVER (PARTITION BY s), 12) AS gauss, round(d1, 12) + 0.0 AS slope, round(d2 - avg(d2) OVER (PARTITION BY s), 12) + 0.0 AS curve FROM raw""")
def gaussian_taps(spark, d):
    rows = [(s, k - int(3 * s), *t) for s in (1.0, 2.0, 4.0) for k, t in enumerate(zip(I.gaussian(s), I.gaussian_slope(s), I.gaussian_curvature(s), strict=True))]
    df = spark.createDataFrame(rows, "sigma double, k int, gauss double, slope double, curve double")
    return df.withColumns({c: F.round(c, 12) + F.lit(0.0) for c in ("gauss", "slope", "curve")})


def _bank_sql() -> str:
    """Every one-band filter of the bank as two passes; those of one name are summed."""
    views, parts = [A.sql("raster")], []
    for k, (name, band, tx, ty) in enumerate(I.texton_bank(0.5)):
        if not band:
            views += [_taps_sql(f"tx{k}", tx), _taps_sql(f"ty{k}", ty), _pass(f"a{k}", "raster", f"tx{k}", "x", W_ - 1, len(tx) // 2), _pass(f"b{k}", f"a{k}", f"ty{k}", "y", H_ - 1, len(ty) // 2)]
            parts.append(f"SELECT image_id, x, y, '{name}' AS name, v FROM b{k}")
    return ",\n".join(views) + f" SELECT image_id, x, y, name, round(sum(v), 6) + 0.0 AS response FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3, 4"


@QUERIES.add(_bank_sql())
def texton_bank(spark, d):
    return S.texton_responses(A.raster(spark, d), 0.5, (W_, H_)).withColumn("response", F.round("response", 6) + F.lit(0.0))


GRAD = A.sql("raster") + """,
g AS (SELECT image_id, x, y, coalesce(lead(v) OVER (PARTITION BY image_id, y ORDER BY x), v) - v AS dx, coalesce(lead(v) OVER (PARTITION BY image_id, x ORDER BY y), v) - v AS dy FROM raster),
a AS (SELECT *, sqrt(dx * dx + dy * dy) AS mag, (CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END) * (8 / pi()) AS ang FROM g),
b AS (SELECT image_id, x, y, CAST(floor(ang) AS INT) % 8 AS bin, (floor(ang) + 1 - ang) * mag AS mass FROM a UNION ALL SELECT image_id, x, y, (CAST(floor(ang) AS INT) + 1) % 8, (ang - floor(ang)) * mag FROM a)"""


@QUERIES.add(GRAD + " SELECT image_id, x, y, bin, round(mass, 6) AS mass FROM b")
def gradient_bins(spark, d):
    return rounded(S.gradient_bins(A.raster(spark, d), 8), "mass", digits=6)


@QUERIES.add(A.sql("vec") + """, e AS (SELECT vec_id, unnest(features) AS f, generate_subscripts(features, 1) AS dim FROM vec)
SELECT vec_id, CAST(dim - 1 AS INT) AS dim, round(f / sqrt(sum(f * f) OVER (PARTITION BY vec_id)), 9) AS f FROM e""")
def l2_normalise(spark, d):
    unit = A.vectors(spark, d).select("vec_id", F.posexplode(I.l2_unit(F.col("features"))).alias("dim", "f"))
    return rounded(unit, "f")


@QUERIES.add(A.sql("raster") + f""",
o AS (SELECT dx, dy, CAST((dy + 1) * 3 + dx + 1 AS INT) AS k FROM (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dx), (SELECT CAST(unnest([-1, 0, 1]) AS INT) AS dy))
SELECT p.image_id, p.x, p.y, CAST(sum(CASE WHEN q.v > p.v THEN 1 << o.k ELSE 0 END) AS INT) AS code FROM raster p CROSS JOIN o JOIN raster q ON q.image_id = p.image_id AND q.x = greatest(0, least({W_ - 1}, p.x + o.dx)) AND q.y = greatest(0, least({H_ - 1}, p.y + o.dy)) GROUP BY 1, 2, 3""")
def lbp_code(spark, d):
    return S.lbp(A.raster(spark, d), W_, H_)


@QUERIES.add(A.sql("raster") + " SELECT a.image_id, a.x, a.y, sum(b.v) AS s FROM raster a JOIN raster b ON a.image_id = b.image_id AND b.x <= a.x AND b.y <= a.y GROUP BY 1, 2, 3")
def integral_image(spark, d):
    r = A.raster(spark, d)
    return S.integral(S.dense(r, W_, H_)).join(r.select("image_id", "x", "y"), ["image_id", "x", "y"], "left_semi")


SHAPES = [(0, -2, -1, 5, 3), (1, 0, 0, 4, 4), (2, -6, -3, 6, 2)]


@QUERIES.add(A.sql("raster") + f""",
shapes AS (SELECT * FROM (VALUES {', '.join(map(str, SHAPES))}) s(shape_id, dx, dy, w, h))
SELECT p.image_id, p.x, p.y, shape_id, coalesce(sum(q.v), 0) AS total FROM raster p CROSS JOIN shapes s LEFT JOIN raster q ON q.image_id = p.image_id AND q.x >= p.x + dx AND q.x < p.x + dx + w AND q.y >= p.y + dy AND q.y < p.y + dy + h GROUP BY 1, 2, 3, 4""")
def rect_sum(spark, d):
    shapes = spark.createDataFrame(SHAPES, "shape_id int, dx int, dy int, w int, h int")
    r = A.raster(spark, d)
    return S.rectangle_sums(S.integral(S.dense(r, W_, H_)), r, shapes, W_, H_)


_CELLS = ", ".join(f"({l * 2 + m}, {m * 3 - 3}, {l * 3 - 3})" for l in range(2) for m in range(2))


@QUERIES.add(GRAD + f""",
mass AS (SELECT image_id, x, y, bin, max(mass) AS mass FROM b GROUP BY 1, 2, 3, 4),
cells AS (SELECT * FROM (VALUES {_CELLS}) c(cell, i, j)),
spot AS (SELECT image_id, x, y, cell, greatest(0, least({W_ - 4}, x + i)) AS x0, greatest(0, least({H_ - 4}, y + j)) AS y0 FROM raster, cells WHERE x % 5 = 0 AND y % 5 = 0),
bins AS (SELECT CAST(unnest(range(8)) AS INT) AS bin),
h AS (SELECT a.image_id, a.x, a.y, cell, n.bin, coalesce(sum(m.mass), 0) AS f FROM spot a CROSS JOIN bins n LEFT JOIN mass m ON m.image_id = a.image_id AND m.bin = n.bin AND m.x > x0 AND m.x <= x0 + 3 AND m.y > y0 AND m.y <= y0 + 3 GROUP BY 1, 2, 3, 4, 5)
SELECT image_id, x, y, CAST(cell * 8 + bin AS INT) AS dim, round(f / sqrt(sum(f * f) OVER (PARTITION BY image_id, x, y)), 6) + 0.0 AS f FROM h""")
def sift_descriptor(spark, d):
    r = A.raster(spark, d)
    out = S.sift(r, W_, H_, 3, 2, 8, step=5)
    return out.select("image_id", "x", "y", F.posexplode("features").alias("dim", "f")).withColumn("f", F.round("f", 6) + F.lit(0.0))


@QUERIES.add(QUERIES["sift_descriptor"][1].replace(" WHERE x % 5 = 0 AND y % 5 = 0", ""))
def sift_descriptor_all(spark, d):
    """The descriptor of every pixel."""
    out = S.sift(A.raster(spark, d), W_, H_, 3, 2, 8)
    return out.select("image_id", "x", "y", F.posexplode("features").alias("dim", "f")).withColumn("f", F.round("f", 6) + F.lit(0.0))


@QUERIES.add()
def colour_sift_words(spark, d):
    """The word of every pixel of colour images: the nearest centre of k-means over every fifth pixel's descriptors."""
    from tessera.operators import learning as L

    found = S.colour_sift(A.rgb(spark, d), W_, H_, 3, 2, 4).withColumn("key", F.concat_ws("/", "image_id", "x", "y"))
    first = found.where("image_id = 'A' AND x % 20 = 0 AND y = 0").select((F.col("x") / 20).cast("int").alias("cluster"), F.col("features").alias("mean"))
    centres = L.kmeans(found.where("x % 5 = 0 AND y % 5 = 0"), first, key="key")
    return L.nearest(found, centres, key="key").select("key", F.col("cluster").alias("word"))
