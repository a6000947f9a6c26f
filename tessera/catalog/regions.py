"""Queries of superpixel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.evaluation import rounded
from tessera.catalog.registry import Registry
from tessera.operators import regions as R

QUERIES = Registry()
W_, H_ = A.WIDTH, A.HEIGHT


def members(spark, d, layer=0):
    return A.segments(A.raster(spark, d), layer)


@QUERIES.add(A.sql("seg") + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, count(*) AS n_pixels FROM seg GROUP BY 1, 2")
def segment_sizes(spark, d):
    return R.sizes(members(spark, d))


@QUERIES.add(A.sql("seg", "seg1") + " SELECT a.image_id, CAST(a.seg_id AS INT) AS child, CAST(b.seg_id AS INT) AS parent, count(*) AS weight FROM seg a JOIN seg1 b USING (image_id, x, y) GROUP BY 1, 2, 3")
def layer_overlap(spark, d):
    return R.layer_overlap(members(spark, d), members(spark, d, 1))


TOUCH = A.sql("seg") + """,
near AS (SELECT p.image_id, p.x, p.y, p.seg_id AS a, q.seg_id AS b FROM seg p JOIN seg q ON p.image_id = q.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1))),
touch AS (SELECT DISTINCT image_id, a, b FROM (SELECT image_id, a, b FROM near WHERE a <> b UNION ALL SELECT image_id, b, a FROM near WHERE a <> b))"""


@QUERIES.add(TOUCH + " SELECT image_id, CAST(a AS INT) AS a, CAST(b AS INT) AS b FROM touch")
def segment_adjacency(spark, d):
    return R.adjacency(members(spark, d))


LENGTHS = TOUCH + f", lengths AS (SELECT image_id, least(a, b) AS lo, greatest(a, b) AS hi, count(*) AS length FROM near WHERE a <> b AND x < {W_ - 1} AND y < {H_ - 1} GROUP BY 1, 2, 3)"


@QUERIES.add(LENGTHS + " SELECT image_id, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, length FROM lengths")
def boundary_length(spark, d):
    return R.boundary_length(members(spark, d), W_, H_)


def words(spark, d):
    return members(spark, d).withColumn("word", (F.col("v") % 16).cast("int"))


WORDS = TOUCH + ", words AS (SELECT image_id, seg_id, CAST(v % 16 AS INT) AS word, count(*) AS n FROM seg JOIN raster USING (image_id, x, y) WHERE CAST(v % 16 AS INT) < 14 GROUP BY 1, 2, 3)"


@QUERIES.add(WORDS + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, word, round(n * 1000.0 / sum(n) OVER (PARTITION BY image_id, seg_id), 6) AS share FROM words")
def segment_histogram(spark, d):
    return rounded(R.histogram(words(spark, d), 14), "share", digits=6)


@QUERIES.add(WORDS + """, every AS (SELECT * FROM words UNION ALL SELECT t.image_id, t.a, w.word, w.n FROM touch t JOIN words w ON w.image_id = t.image_id AND w.seg_id = t.b),
s AS (SELECT image_id, seg_id, word, sum(n) AS n FROM every GROUP BY 1, 2, 3)
SELECT image_id, CAST(seg_id AS INT) AS seg_id, word, round(CAST(n * 1000.0 / sum(n) OVER (PARTITION BY image_id, seg_id) AS DOUBLE), 6) AS share FROM s""")
def neighbour_histogram(spark, d):
    return rounded(R.neighbour_histogram(words(spark, d), R.adjacency(members(spark, d)), 14), "share", digits=6)


@QUERIES.add(A.sql("seg", "rgb") + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, count(*) AS n_points, round(avg(r), 6) AS r, round(avg(g), 6) AS g, CAST(sum(b) AS BIGINT) AS b FROM seg JOIN rgb USING (image_id, x, y) GROUP BY 1, 2")
def segment_mean(spark, d):
    return rounded(R.point_means(A.segments(A.rgb(spark, d)), ["r", "g"], "b"), "r", "g", digits=6)


def with_labels(spark, d):
    return members(spark, d).withColumn("label", F.when(F.col("v") < 100, 0).when(F.col("v") < 700, 1).otherwise(2))


LABELS = A.sql("seg") + ", l AS (SELECT image_id, seg_id, v, CASE WHEN v < 100 THEN 0 WHEN v < 700 THEN 1 ELSE 2 END AS label FROM seg JOIN raster USING (image_id, x, y)), c AS (SELECT image_id, seg_id, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY image_id, seg_id) AS weight FROM l GROUP BY 1, 2, 3)"


@QUERIES.add(LABELS + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, label, CAST(weight AS BIGINT) AS weight FROM c WHERE label > 0 AND n > 0.5 * weight")
def majority_label(spark, d):
    return R.majority_label(with_labels(spark, d))


@QUERIES.add(LABELS + ", m AS (SELECT DISTINCT image_id, seg_id, weight FROM c) SELECT image_id, CAST(seg_id AS INT) AS seg_id, CAST(coalesce((SELECT max(label) FROM c WHERE c.image_id = m.image_id AND c.seg_id = m.seg_id AND n > c.weight * 0.4), 3) AS INT) AS label FROM m")
def dominant_label(spark, d):
    return R.dominant_label(with_labels(spark, d).withColumn("weight", F.lit(1.0)), 0.6, 3)


@QUERIES.add(A.sql("lbl") + ", c AS (SELECT gt - 1 AS cls, count(*) AS n FROM lbl WHERE gt <> 0 GROUP BY 1) SELECT cls, n, least(1.0, round(sum(n) OVER () * 0.3 / n, 9)) AS keep, round(CAST(sum(n) OVER () AS DOUBLE) / (2 * n), 9) AS weight FROM c")
def class_weights(spark, d):
    return rounded(R.class_weights(A.labelled(spark, d), 2, 0.3), "keep", "weight")


CUBE = LENGTHS + ", " + A.SQL["rgb"] + """,
px AS (SELECT image_id, seg_id, r * 4 // 256 AS r, g * 4 // 256 AS g, b * 4 // 256 AS b FROM seg JOIN rgb USING (image_id, x, y)),
n AS (SELECT image_id, seg_id, count(*) AS total FROM px GROUP BY 1, 2),
cube AS (SELECT r, g, b FROM (SELECT CAST(unnest(range(4)) AS INT) AS r), (SELECT CAST(unnest(range(4)) AS INT) AS g), (SELECT CAST(unnest(range(4)) AS INT) AS b)),
cum AS (SELECT n.image_id, n.seg_id, c.r, c.g, c.b, count(p.r) / CAST(total AS DOUBLE) AS share FROM n CROSS JOIN cube c LEFT JOIN px p ON p.image_id = n.image_id AND p.seg_id = n.seg_id AND p.r <= c.r AND p.g <= c.g AND p.b <= c.b GROUP BY n.image_id, n.seg_id, c.r, c.g, c.b, total)"""


@QUERIES.add()
def sampled_pixels(spark, d):
    px = A.labelled(spark, d)
    return R.sample_pixels(px, R.class_weights(px, 2, 0.3))


def cube(spark, d):
    return R.colour_histogram(A.segments(A.rgb(spark, d)), 4)


@QUERIES.add(CUBE + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, r, g, b, round(share, 9) AS share FROM cum")
def colour_cumhist(spark, d):
    return rounded(cube(spark, d), "share")


@QUERIES.add(CUBE + """, d AS (SELECT l.image_id, lo, hi, length, sum((a.share - b.share) * (a.share - b.share)) AS d FROM lengths l JOIN cum a ON a.image_id = l.image_id AND a.seg_id = lo JOIN cum b ON b.image_id = l.image_id AND b.seg_id = hi AND a.r = b.r AND a.g = b.g AND a.b = b.b GROUP BY 1, 2, 3, 4)
SELECT image_id, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, round(length * (1.5 + 2.0 * exp(-d / 0.7)), 6) AS cost FROM d""")
def hist_pairwise(spark, d):
    return rounded(R.histogram_pairwise(cube(spark, d), R.boundary_length(members(spark, d), W_, H_), 1.5, 2.0, 0.7), "cost", digits=6)


@QUERIES.add(A.sql("raster") + " SELECT image_id, min(v) AS lo, max(v) AS hi FROM raster GROUP BY 1")
def value_range(spark, d):
    return R.value_range(A.raster(spark, d))


def flat(spark, d):
    """An image of few levels, so that neighbours often agree."""
    return A.raster(spark, d).withColumn("v", F.floor(F.col("v") / 400).cast("double"))


@QUERIES.add("WITH RECURSIVE " + A.sql("raster")[5:] + """,
px AS (SELECT image_id, CAST(y AS BIGINT) * 100000 + x AS node, x, y, floor(v / 400) AS v FROM raster),
e AS (SELECT p.image_id, p.node AS a, q.node AS b FROM px p JOIN px q ON p.image_id = q.image_id AND abs(p.x - q.x) + abs(p.y - q.y) = 1 AND abs(p.v - q.v) < 1.0),
reach AS (SELECT image_id, node, node AS root FROM px UNION SELECT r.image_id, e.b, r.root FROM reach r JOIN e ON e.image_id = r.image_id AND e.a = r.node)
SELECT px.image_id, x, y, min(root) AS seg FROM reach JOIN px ON px.image_id = reach.image_id AND px.node = reach.node GROUP BY 1, 2, 3""")
def connected_components(spark, d):
    return R.merge_modes(flat(spark, d))


@QUERIES.add(A.sql("raster") + """,
px AS (SELECT *, x // 5 AS gx, y // 4 AS gy FROM raster),
c AS (SELECT image_id, gx AS cx, gy AS cy, avg(x) AS mx, avg(y) AS my, avg(v) AS mv FROM px GROUP BY 1, 2, 3),
d AS (SELECT p.image_id, x, y, cx, cy, round(4.0 * ((x - mx) * (x - mx) + (y - my) * (y - my)) + (v - mv) * (v - mv), 9) AS dist FROM px p JOIN c ON c.image_id = p.image_id AND abs(cx - gx) <= 1 AND abs(cy - gy) <= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY dist, cy, cx) AS rn FROM d)
SELECT image_id, x, y, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy FROM r WHERE rn = 1""")
def slic_assign(spark, d):
    px = A.raster(spark, d)
    return R.grid_assign(px, R.grid_centres(px, (5, 4)), (5, 4), 2.0)


def _grid_sql(rounds: int) -> str:
    parts = [A.sql("raster"), "px AS (SELECT *, x // 5 AS gx, y // 5 AS gy FROM raster)", "c0 AS (SELECT image_id, gx AS cx, gy AS cy, avg(x) AS mx, avg(y) AS my, avg(v) AS mv FROM px GROUP BY 1, 2, 3)"]
    for k in range(rounds + 1):
        parts.append(f"d{k} AS (SELECT p.image_id, x, y, v, cx, cy, round(4.0 * ((x - mx) * (x - mx) + (y - my) * (y - my)) + (v - mv) * (v - mv), 9) AS dist FROM px p JOIN c{k} c ON c.image_id = p.image_id AND abs(cx - gx) <= 1 AND abs(cy - gy) <= 1)")
        parts.append(f"r{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY dist, cy, cx) AS rn FROM d{k}) WHERE rn = 1)")
        parts.append(f"c{k + 1} AS (SELECT image_id, cx, cy, coalesce(mx, 0) AS mx, coalesce(my, 0) AS my, coalesce(mv, 0) AS mv FROM (SELECT image_id, cx, cy FROM c{k}) LEFT JOIN (SELECT image_id, cx, cy, avg(x) AS mx, avg(y) AS my, avg(v) AS mv FROM r{k} GROUP BY 1, 2, 3) USING (image_id, cx, cy))")
    return ",\n".join(parts) + f" SELECT image_id, x, y, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy FROM r{rounds}"


@QUERIES.add(_grid_sql(2))
def slic_superpixels(spark, d):
    return R.grid_superpixels(A.raster(spark, d), 5, 2.0, iterations=2)


@QUERIES.add()
def mean_shift(spark, d):
    return R.mean_shift(A.raster(spark, d), 4.0, 100.0)


@QUERIES.add()
def mean_shift_segments(spark, d):
    return R.mean_shift_segments(A.raster(spark, d), 4.0, 100.0, 4)


@QUERIES.add()
def absorb_small_regions(spark, d):
    found = connected_components(spark, d).withColumnRenamed("seg", "seg_id")
    return R.absorb_small(found.join(flat(spark, d), ["image_id", "x", "y"]), 4)
