"""Views of the driver's tables as images, segments, scans, scores, vectors and labels.

Each comes twice: as a DataFrame, and as the text of the same view in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WIDTH, HEIGHT = 50, 11


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_quantity").cast("int") - 1).alias("x"), F.round(F.col("l_discount") * 100).cast("int").alias("y")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("image_id"), x, y)


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return _cells(spark, sf_dir).agg((cents % 1000).cast("double").alias("v"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.count("*") % 256, F.sum("l_linenumber") % 256, F.sum("l_quantity").cast("bigint") % 256
    return _cells(spark, sf_dir).agg(*(c.cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))))


def segments(cells: DataFrame, layer: int = 0) -> DataFrame:
    """Cells with the segment that they belong to in a layer of superpixels."""
    w, h, n = ((5, 4, 10), (10, 6, 5))[layer]
    return cells.withColumn("seg_id", (F.floor(F.col("x") / w) + n * F.floor(F.col("y") / h)).cast("int"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("int").alias("frame"), e.alias("idx"), (F.col("value") % 100).alias("x"), ((e % 81) - 40).cast("double").alias("y"), ((e % 17) / 10 - 0.8).alias("z"), F.col("value").alias("refl"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = ((F.col("value") + (F.col("event_id") % 100)) > 90).cast("int")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("category"), "event_id", F.least(F.col("value") / 200, F.lit(1.0)).alias("score"), gt.alias("gt"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("quality") + 1)
    return table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).cast("int").alias("image_id"), F.col("doc_id").alias("pixel"), gt.cast("int").alias("gt"), (F.col("toxic") + 1).cast("int").alias("pred"))


CELLS = "l_returnflag AS image_id, CAST(l_quantity AS INT) - 1 AS x, CAST(round(l_discount * 100) AS INT) AS y"
SQL = {
    "raster": f"raster AS (SELECT {CELLS}, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) % 1000 AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3)",
    "rgb": f"rgb AS (SELECT {CELLS}, CAST(count(*) % 256 AS INT) AS r, CAST(sum(l_linenumber) % 256 AS INT) AS g, CAST(CAST(sum(l_quantity) AS BIGINT) % 256 AS INT) AS b FROM lineitem GROUP BY 1, 2, 3)",
    "seg": "seg AS (SELECT image_id, x, y, x // 5 + 10 * (y // 4) AS seg_id FROM raster)",
    "seg1": "seg1 AS (SELECT image_id, x, y, x // 10 + 5 * (y // 6) AS seg_id FROM raster)",
    "points": "points AS (SELECT CAST(user_id % 5 AS INT) AS frame, event_id AS idx, value % 100 AS x, CAST((event_id % 81) - 40 AS DOUBLE) AS y, (event_id % 17) / 10 - 0.8 AS z, value AS refl FROM events)",
    "scored": "scored AS (SELECT CAST(user_id % 3 AS INT) AS category, event_id, least(value / 200, 1.0) AS score, CAST((value + (event_id % 100)) > 90 AS INT) AS gt FROM events)",
    "vec": "vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS features, label FROM embeddings)",
    "lbl": "lbl AS (SELECT CAST(doc_id % 3 AS INT) AS image_id, doc_id AS pixel, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE quality + 1 END AS gt, toxic + 1 AS pred FROM labels)",
}


def sql(*names: str) -> str:
    """WITH clause of these views, those they need first."""
    need = {"seg": ["raster"], "seg1": ["raster"]}
    order: list[str] = []
    for n in names:
        for m in [*need.get(n, []), n]:
            if m not in order:
                order.append(m)
    return "WITH " + ",\n".join(SQL[n] for n in order)
