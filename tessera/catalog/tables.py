"""Queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.evaluation import rounded
from tessera.catalog.registry import Registry
from tessera.sources import binary as B
from tessera.sources import sinks as K
from tessera.sources import tables as T
from tessera.storage import scratch, stored

QUERIES = Registry()


@QUERIES.add(A.sql("points") + " SELECT CAST(frame AS VARCHAR) AS frame_id, row_number() OVER (PARTITION BY frame ORDER BY idx) - 1 AS idx, CAST(x AS FLOAT) AS x, CAST(y AS FLOAT) AS y, CAST(z AS FLOAT) AS z, CAST(refl AS FLOAT) AS refl FROM points")
def scan_points(spark, d):
    return B.scan(B.pack_scan(A.points(spark, d), "frame"))


@QUERIES.add(A.sql("points") + " SELECT frame, idx, x, y, refl FROM points")
def csv_roundtrip(spark, d):
    path = scratch(spark, "matrix")
    T.write_matrix(A.points(spark, d), path, ["frame", "idx", "x", "y", "refl"])
    return T.read_matrix(spark, path, "frame int, idx bigint, x double, y double, refl double")


@QUERIES.add(A.sql("vec") + ", e AS (SELECT label, unnest(features) AS f, CAST(generate_subscripts(features, 1) - 1 AS INT) AS dim FROM vec) SELECT label AS cluster, dim, round(avg(f), 9) AS m FROM e GROUP BY 1, 2")
def model_roundtrip(spark, d):
    from tessera.catalog.learning import centroids

    return stored(centroids(spark, d), "model").select("cluster", F.posexplode("mean").alias("dim", "m")).withColumn("m", F.round("m", 9))


@QUERIES.add("""SELECT n_name AS frame, 'P' || n_regionkey AS name, CAST(unnest([0, 1, 2]) AS INT) AS i, CAST(unnest([n_nationkey, n_regionkey, n_nationkey * 10 + 0.5]) AS DOUBLE) AS v FROM nation""")
def parse_kv(spark, d):
    n = A.table(spark, d, "nation")
    line = F.concat(F.lit("P"), F.col("n_regionkey").cast("string"), F.lit(": "), F.concat_ws("  ", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), (F.col("n_nationkey") * 10 + 0.5).cast("string")))
    lines = n.select(F.col("n_name").alias("frame"), F.explode(F.array(F.lit("# calibration"), F.lit(""), line)).alias("value"))
    return T.parse_calibration(lines, "frame").select("frame", "name", F.posexplode("values").alias("i", "v"))


@QUERIES.add("SELECT 'customer' AS origin, c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1, 2 UNION ALL SELECT 'supplier', s_nationkey, count(*), round(sum(s_acctbal), 2) FROM supplier GROUP BY 1, 2")
def union_all_files(spark, d):
    c, s = A.table(spark, d, "customer"), A.table(spark, d, "supplier")
    stacked = c.select(F.lit("customer").alias("origin"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("b")).unionByName(s.select(F.lit("supplier").alias("origin"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("b")))
    return stacked.groupBy("origin", "nation").agg(F.count("*").alias("n"), F.round(F.sum("b"), 2).alias("total"))


@QUERIES.add("SELECT category, kind, count(*) AS n, min(key) AS first_key FROM (SELECT lang AS category, CASE WHEN doc_id % 2 = 0 THEN 'road' END AS kind, lang || '_' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS key FROM documents) GROUP BY 1, 2")
def category_key(spark, d):
    name = F.concat_ws("_", "lang", F.when(F.col("doc_id") % 2 == 0, "road"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    names = A.table(spark, d, "documents").select(name.alias("name"))
    category, kind, _ = T.frame_name(F.col("name"))
    return names.select(category.alias("category"), kind.alias("kind"), T.frame_key(F.col("name")).alias("key")).groupBy("category", "kind").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@QUERIES.add(A.sql("rgb") + """, p AS (SELECT r, g, b, CAST(row_number() OVER (ORDER BY r, g, b) AS INT) AS label FROM (SELECT DISTINCT r, g, b FROM rgb WHERE r % 2 = 0))
SELECT image_id, x, y, coalesce(label, 0) AS label FROM rgb LEFT JOIN p USING (r, g, b)""")
def palette_join(spark, d):
    from pyspark.sql import Window as W

    px = A.rgb(spark, d)
    colours = px.where("r % 2 = 0").select("r", "g", "b").distinct()
    palette = colours.withColumn("label", F.row_number().over(W.orderBy("r", "g", "b")))  # a palette is small
    return T.decode_labels(px, palette).select("image_id", "x", "y", "label")


@QUERIES.add(A.sql("scored") + ", a AS (SELECT category, event_id, row_number() OVER (PARTITION BY category ORDER BY event_id) - 1 AS position FROM scored), b AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY event_id) - 1 AS position, score FROM scored) SELECT category, event_id, position, score FROM a JOIN b USING (category, position)")
def positional_zip(spark, d):
    from pyspark.sql import Window as W

    s = A.scored(spark, d)
    at = (F.row_number().over(W.partitionBy("category").orderBy("event_id")) - 1).cast("bigint")
    answers = s.select("category", at.alias("position"), "score")
    return T.zip_scan_order(s.select("category", "event_id"), answers, ["category"], ["event_id"]).select("category", "event_id", "position", "score")


@QUERIES.add("SELECT lang, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY 1")
def anti_missing(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang")
    return T.missing_predictions(docs, A.table(spark, d, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@QUERIES.add(A.sql("rgb") + " SELECT image_id, y, x, r, g, b FROM rgb")
def image_roundtrip(spark, d):
    """Images written as PNG and decoded again."""
    px = A.rgb(spark, d).select("image_id", "y", "x", "r", "g", "b")
    back = B.images(B.pack_images(px, ["r", "g", "b"]))
    read = back.select("image_id", "y", "x", *(F.col("bands")[k].alias(c) for k, c in enumerate("rgb")))
    return read.join(px.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")


#: Points as described pixels (the features are stand-ins by position).
_FEATURES = ("(idx % 7) / 8", "(idx % 5) / 16", "(idx % 9) / 4")
EXPORT = A.sql("points") + f", px AS (SELECT CAST(frame AS VARCHAR) AS image_id, CAST(idx // 50 AS INT) AS row, CAST(idx % 50 AS INT) AS col, CAST(1 + idx % 3 AS DOUBLE) AS weight, CAST(idx % 2 AS INT) AS label, x, y, z, refl, {_FEATURES[0]} AS curvature, {_FEATURES[1]} AS height_var, {_FEATURES[2]} AS max_hdiff, idx FROM points)"


def described(spark, d):
    i = F.col("idx")
    px = A.points(spark, d).select(F.col("frame").cast("string").alias("image_id"), F.floor(i / 50).cast("int").alias("row"), (i % 50).cast("int").alias("col"), (1 + i % 3).cast("double").alias("weight"), (i % 2).cast("int").alias("label"), "x", "y", "z", "refl", ((i % 7) / 8).alias("curvature"), ((i % 5) / 16).alias("height_var"), ((i % 9) / 4).alias("max_hdiff"), (i % 4 != 0).alias("valid"), "idx")
    return px


def _written(matrix, keys, name):
    """A matrix exported as text and read again."""
    path = scratch(matrix.sparkSession, name)
    K.write_ordered(matrix, path, keys)
    return T.read_matrix(matrix.sparkSession, path, matrix._jdf.schema().toDDL())


@QUERIES.add(EXPORT + " SELECT image_id, row, col, weight, label, x, y, z, refl, curvature, height_var, max_hdiff FROM px WHERE idx % 4 <> 0")
def dense_train_export(spark, d):
    return _written(K.dense_matrix(described(spark, d), train=True), ["image_id", "row", "col"], "dense-train")


@QUERIES.add(EXPORT + " SELECT image_id, row, col, x, y, z, refl, curvature, height_var, max_hdiff FROM px WHERE idx % 4 <> 0")
def dense_eval_export(spark, d):
    return _written(K.dense_matrix(described(spark, d), train=False), ["image_id", "row", "col"], "dense-eval")


SEGMENT_EXPORT = EXPORT + ", s AS (SELECT image_id, CAST(idx % 40 AS INT) AS seg_id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in T.SEGMENT[:-1]) + ", round(sum(height_var), 6) AS height_var FROM px WHERE idx % 4 <> 0 GROUP BY 1, 2)"


def _segments(spark, d):
    return described(spark, d).where("valid").withColumn("seg_id", (F.col("idx") % 40).cast("int"))


@QUERIES.add(SEGMENT_EXPORT + " SELECT image_id, seg_id, CAST(1 + seg_id AS DOUBLE) AS weight, CAST(seg_id % 3 = 0 AS INT) AS label, x, y, z, refl, curvature, max_hdiff, height_var FROM s")
def segment_train_export(spark, d):
    points = _segments(spark, d)
    labels = points.select("image_id", "seg_id").distinct().withColumns({"label": F.col("seg_id") % 3, "weight": (1 + F.col("seg_id")).cast("double")})
    return rounded(_written(K.segment_matrix(points, labels), ["image_id", "seg_id"], "segment-train"), *T.SEGMENT, digits=6)


@QUERIES.add(SEGMENT_EXPORT + " SELECT image_id, seg_id, x, y, z, refl, curvature, max_hdiff, height_var FROM s")
def segment_eval_export(spark, d):
    return rounded(_written(K.segment_matrix(_segments(spark, d)), ["image_id", "seg_id"], "segment-eval"), *T.SEGMENT, digits=6)


@QUERIES.add(A.sql("raster") + " SELECT image_id, y, x, v / 100 AS c0, (1000 - v) / 100 AS c1 FROM raster")
def dense_cost_roundtrip(spark, d):
    """Costs of all pixels written as cost files and read again."""
    px = A.raster(spark, d).select("image_id", "y", "x", F.array(F.col("v") / 100, (1000 - F.col("v")) / 100).alias("scores"))
    back = B.dense_costs(K.pack_dense_costs(px)).join(px.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi")
    return back.select("image_id", "y", "x", F.col("scores")[0].alias("c0"), F.col("scores")[1].alias("c1"))


@QUERIES.add(A.sql("raster", "seg") + ", s AS (SELECT image_id, seg_id, min(v) AS lo, max(v) AS hi FROM raster JOIN seg USING (image_id, x, y) GROUP BY 1, 2) SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY seg_id) - 1 AS INT) AS seg_id, lo, hi FROM s")
def segment_cost_roundtrip(spark, d):
    """Costs of segments written as cost files (which number them in order) and read again."""
    s = A.segments(A.raster(spark, d)).groupBy("image_id", "seg_id").agg(F.array(F.min("v"), F.max("v")).alias("scores"))
    back = B.segment_costs(K.pack_segment_costs(s), 2)
    return back.select("image_id", "seg_id", F.col("scores")[0].alias("lo"), F.col("scores")[1].alias("hi"))


@QUERIES.add(A.sql("raster", "seg") + " SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY seg_id) - 1 AS INT) AS seg_id, CAST(y * 50 + x AS INT) AS pixel FROM seg")
def segment_file_roundtrip(spark, d):
    """Segments written as segment files and read again."""
    px = A.segments(A.raster(spark, d)).select("image_id", "seg_id", (F.col("y") * 50 + F.col("x")).cast("int").alias("pixel"))
    return B.segments(K.pack_segments(px))


@QUERIES.add(A.sql("raster") + " SELECT image_id, y, x, CAST(floor(v / 300) AS INT) % 3 AS label FROM raster")
def label_image_roundtrip(spark, d):
    """Labels written as images in a palette's colours, decoded by the same palette."""
    palette = spark.createDataFrame([(0, 0, 0, 0), (1, 255, 0, 255), (2, 255, 0, 0)], "label int, r int, g int, b int")
    px = A.raster(spark, d).select("image_id", "y", "x", (F.floor(F.col("v") / 300).cast("int") % 3).alias("label"))
    back = B.images(K.pack_labels(px, palette)).select("image_id", "y", "x", *(F.col("bands")[k].alias(c) for k, c in enumerate("rgb")))
    return T.decode_labels(back.join(px.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_semi"), palette).select("image_id", "y", "x", "label")


@QUERIES.add(A.sql("rgb") + """, p AS (SELECT *, CASE WHEN x % 3 <> 0 THEN y / 10 END AS p FROM rgb)
SELECT image_id, x, y, CASE WHEN p IS NULL THEN r ELSE CAST(floor(r * 0.5 + CASE WHEN p > 0.5 THEN 0 ELSE 255 END * 0.5) AS INT) END AS r, CASE WHEN p IS NULL THEN g ELSE CAST(floor(g * 0.5 + CASE WHEN p > 0.5 THEN 255 ELSE 0 END * 0.5) AS INT) END AS g,
CASE WHEN p IS NULL THEN b ELSE CAST(floor(b * 0.5) AS INT) END AS b FROM p""")
def overlay_pixels(spark, d):
    p = F.when(F.col("x") % 3 != 0, F.col("y") / 10)
    return K.overlay(A.rgb(spark, d), p).select("image_id", "x", "y", "r", "g", "b")
