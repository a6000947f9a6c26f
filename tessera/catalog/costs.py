"""Queries of unary costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.evaluation import rounded
from tessera.catalog.registry import Registry
from tessera.functions import imaging as I
from tessera.operators import costs as C

QUERIES = Registry()
CELL = ["image_id", "x", "y"]


def with_scores(df, *names):
    return df.withColumn("scores", F.array(*(F.col(n) / F.lit(64.0) for n in names)))


def lidar(spark, d):
    """A range-sensor probability on every other cell."""
    return A.raster(spark, d).where((F.col("x") + F.col("y")) % 2 == 0).select(*CELL, (F.col("v") / 1000).alias("p"))


SOFT = A.sql("rgb") + ", s AS (SELECT image_id, x, y, r / 64.0 AS a, g / 64.0 AS b, b / 64.0 AS c FROM rgb), e AS (SELECT *, ln(exp(a) + exp(b) + exp(c)) AS z FROM s)"


@QUERIES.add(SOFT + "".join(f" {'UNION ALL' if k else ''} SELECT image_id, x, y, {k} AS cls, round(-2.0 * ({n} - z), 6) + 0.0 AS cost FROM e" for k, n in enumerate("abc")))
def softmax_cost(spark, d):
    df = with_scores(A.rgb(spark, d), "r", "g", "b")
    return df.select(*CELL, F.posexplode(I.softmax_costs(F.col("scores"), 2.0)).alias("cls", "cost")).withColumn("cost", F.round("cost", 6) + F.lit(0.0))


LIDAR = A.sql("raster", "rgb") + ", lidar AS (SELECT image_id, x, y, v / 1000 AS p FROM raster WHERE (x + y) % 2 = 0)"
PAIR = ", l AS (SELECT q.image_id, q.x, q.y, p, -ln(greatest(coalesce(p, 0.5), 1e-200)) AS c0, -ln(greatest(1 - coalesce(p, 0.5), 1e-200)) AS c1 FROM raster q LEFT JOIN lidar USING (image_id, x, y))"


@QUERIES.add(LIDAR + PAIR + " SELECT image_id, x, y, 0 AS cls, round(c0 * 3, 6) + 0.0 AS cost FROM l UNION ALL SELECT image_id, x, y, 1, round(c1 * 3, 6) + 0.0 FROM l")
def logloss_cost(spark, d):
    return C.pixel_costs(A.raster(spark, d), lidar(spark, d), CELL, 3.0).withColumn("cost", F.round("cost", 6) + F.lit(0.0))


FUSED = LIDAR + PAIR + ", f AS (SELECT image_id, x, y, p, c0, c1, ln(exp(r / 64.0) + exp(g / 64.0)) - r / 64.0 AS s0, ln(exp(r / 64.0) + exp(g / 64.0)) - g / 64.0 AS s1 FROM rgb JOIN l USING (image_id, x, y))"
ROWS = FUSED + ", pixel AS (" + " UNION ALL ".join(f"SELECT image_id, x, y, {k} AS cls, CASE WHEN p IS NULL THEN s{k} ELSE 0.5 * s{k} + 0.5 * c{k} END AS cost FROM f" for k in (0, 1)) + ")"


def fused(spark, d):
    return C.fuse_pixels(with_scores(A.rgb(spark, d), "r", "g"), lidar(spark, d), CELL)


@QUERIES.add(ROWS + " SELECT image_id, x, y, cls, round(cost, 6) + 0.0 AS cost FROM pixel")
def fuse_pixel(spark, d):
    return fused(spark, d).withColumn("cost", F.round("cost", 6) + F.lit(0.0))


@QUERIES.add(ROWS + " SELECT image_id, x, y, CAST(label AS INT) AS label FROM (SELECT image_id, x, y, arg_min(cls, round(cost, 9) * 10 + cls * 1e-12) AS label FROM pixel GROUP BY 1, 2, 3)")
def argmin_label(spark, d):
    return C.argmin_labels(fused(spark, d).withColumn("cost", F.round("cost", 9)), CELL)


def segment_table(spark, d):
    """Segments with their size, scores from mean colours, and the sensor's probability, if any."""
    sizes = A.segments(A.rgb(spark, d)).groupBy("image_id", "seg_id").agg(F.count("*").alias("n"), (F.avg("r") / 64).alias("a"), (F.avg("g") / 64).alias("b"))
    ps = A.segments(lidar(spark, d)).where("image_id <> 'R'").groupBy("image_id", "seg_id").agg(F.avg("p").alias("p"))
    return sizes.join(ps, ["image_id", "seg_id"], "left").withColumn("scores", F.array("a", "b"))


SEG = LIDAR + """,
sizes AS (SELECT image_id, x // 5 + 10 * (y // 4) AS seg_id, count(*) AS n, avg(r) / 64 AS a, avg(g) / 64 AS b FROM rgb GROUP BY 1, 2),
ps AS (SELECT image_id, x // 5 + 10 * (y // 4) AS seg_id, avg(p) AS p FROM lidar WHERE image_id <> 'R' GROUP BY 1, 2),
s AS (SELECT *, 2.0 * n AS w, ln(exp(a) + exp(b)) - a AS s0, ln(exp(a) + exp(b)) - b AS s1, -2.0 * n * ln(0.1) AS most FROM sizes LEFT JOIN ps USING (image_id, seg_id))"""


def _segment_sql(c0: str, c1: str) -> str:
    return SEG + f" SELECT image_id, seg_id, 0 AS cls, round(least({c0}, most), 6) + 0.0 AS cost FROM s UNION ALL SELECT image_id, seg_id, 1, round(least({c1}, most), 6) + 0.0 FROM s UNION ALL SELECT image_id, seg_id, 2, round(most + 0.5 * n, 6) FROM s"


@QUERIES.add(_segment_sql("w * CASE WHEN p IS NULL THEN s0 ELSE 0.5 * (s0 + 0.5 * -ln(greatest(p, 1e-200))) END", "w * CASE WHEN p IS NULL THEN s1 ELSE 0.5 * (s1 + 0.5 * -ln(greatest(1 - p, 1e-200))) END"))
def fuse_segment(spark, d):
    return C.segment_costs(segment_table(spark, d), ["image_id", "seg_id"], p="p", factor=2.0, prior=0.5).withColumn("cost", F.round("cost", 6) + F.lit(0.0))


@QUERIES.add(_segment_sql("w * s0", "w * s1"))
def segment_cost(spark, d):
    return C.segment_costs(segment_table(spark, d), ["image_id", "seg_id"], factor=2.0, prior=0.5).withColumn("cost", F.round("cost", 6) + F.lit(0.0))


@QUERIES.add(A.sql("raster") + ", n AS (SELECT image_id, x, y, CASE WHEN (x + y) % 2 = 0 THEN CAST(v > 500 AS INT) END AS lidar FROM raster) SELECT image_id, x, y, cls, round(-ln(CASE WHEN lidar IS NULL THEN 0.5 WHEN lidar = cls THEN 0.8 ELSE 0.2 END) * 2, 6) AS cost FROM n, (SELECT CAST(unnest([0, 1]) AS INT) AS cls)")
def height_unary(spark, d):
    nodes = A.raster(spark, d).select(*CELL, F.when((F.col("x") + F.col("y")) % 2 == 0, (F.col("v") > 500).cast("int")).alias("lidar"))
    return rounded(C.height_costs(nodes, CELL, 2, factor=2.0), "cost", digits=6)
