"""Queries of random-field terms and moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import adapters as A
from tessera.catalog.evaluation import rounded
from tessera.catalog.registry import Registry
from tessera.operators import graphs as G
from tessera.operators import regions as R

QUERIES = Registry()
CELL = ["image_id", "x", "y"]
EDGES = """,
pairs AS (SELECT p.image_id, p.x, p.y, q.x AS nx, q.y AS ny, CASE WHEN p.x <> q.x AND p.y <> q.y THEN sqrt(2.0) ELSE 1.0 END AS dist, p.v AS v, q.v AS n_v FROM raster p JOIN raster q ON p.image_id = q.image_id AND ((q.x = p.x + 1 AND q.y = p.y) OR (q.x = p.x AND q.y = p.y + 1) OR (q.x = p.x + 1 AND q.y = p.y + 1) OR (q.x = p.x - 1 AND q.y = p.y + 1)))"""
RASTER_EDGES = A.sql("raster") + EDGES


def pairs(spark, d):
    return G.eight_neighbours(A.raster(spark, d), "v")


@QUERIES.add(RASTER_EDGES + " SELECT image_id, x, y, nx, ny, round(CAST(dist AS DOUBLE), 9) AS dist FROM pairs")
def eight_neighbour_edges(spark, d):
    return rounded(pairs(spark, d).select(*CELL, "nx", "ny", "dist"), "dist")


@QUERIES.add(A.sql("rgb") + """,
raster AS (SELECT image_id, x, y, r AS v FROM rgb)""" + EDGES + """,
c AS (SELECT e.image_id, e.x, e.y, nx, ny, dist, 0.5 * (a.r - b.r) * (a.r - b.r) + 0.3 * (a.g - b.g) * (a.g - b.g) + 0.2 * (a.b - b.b) * (a.b - b.b) AS d FROM pairs e JOIN rgb a ON a.image_id = e.image_id AND a.x = e.x AND a.y = e.y JOIN rgb b ON b.image_id = e.image_id AND b.x = nx AND b.y = ny)
SELECT image_id, x, y, nx, ny, round(1.0 + 3.0 * exp(-d / (1000.0 * dist)), 6) AS w FROM c""")
def pairwise_weight(spark, d):
    e = G.eight_neighbours(A.rgb(spark, d), "r", "g", "b")
    w = G.contrast_weight(["r", "g", "b"], [0.5, 0.3, 0.2], 1.0, 3.0, 1000.0)
    return rounded(e.select(*CELL, "nx", "ny", w.alias("w")), "w", digits=6)


@QUERIES.add(RASTER_EDGES + " SELECT image_id, x, y, nx, ny, CAST(least(abs(CAST(floor(v / 100) AS INT) - CAST(floor(n_v / 100) AS INT)), 3) AS DOUBLE) * 2 AS cost FROM pairs")
def trunc_linear(spark, d):
    level = lambda c: F.floor(F.col(c) / 100).cast("int")
    return pairs(spark, d).select(*CELL, "nx", "ny", (G.truncated(level("v"), level("n_v"), 3.0) * 2).alias("cost"))


@QUERIES.add(RASTER_EDGES + """, l AS (SELECT *, CAST(v > 500 AS INT) AS o1, CAST(n_v > 500 AS INT) AS o2, least(abs(floor(v / 100) - floor(n_v / 100)), 4.0) AS delta FROM pairs)
SELECT image_id, x, y, nx, ny, round(CASE WHEN o1 <> o2 THEN 2.0 * (1 + 0.5 * 0.25 * delta) ELSE 0 END + 0.25 * delta, 9) AS cost FROM l""")
def joint_cost(spark, d):
    obj, m = (lambda c: (F.col(c) > 500).cast("int")), (lambda c: F.floor(F.col(c) / 100))
    cost = G.joint_cost(F.lit(2.0), obj("v"), obj("n_v"), m("v"), m("n_v"), 4.0, 0.25, 0.5)
    return rounded(pairs(spark, d).select(*CELL, "nx", "ny", cost.alias("cost")), "cost")


def state(spark, d):
    """Labels 0, 1, 2 by value."""
    return A.raster(spark, d).select(*CELL, F.when(F.col("v") < 300, 0).when(F.col("v") < 700, 1).otherwise(2).alias("label"))


def unary(spark, d):
    v = F.col("v")
    return A.raster(spark, d).select(*CELL, F.posexplode(F.array(v / 100, F.abs(v - 500) / 100, (1000 - v) / 100)).alias("cls", "cost"))


LABELLED = A.sql("raster", "seg") + """,
state AS (SELECT image_id, x, y, v, CASE WHEN v < 300 THEN 0 WHEN v < 700 THEN 1 ELSE 2 END AS label FROM raster),
u AS (SELECT image_id, x, y, 0 AS cls, v / 100 AS cost FROM raster UNION ALL SELECT image_id, x, y, 1, abs(v - 500) / 100 FROM raster UNION ALL SELECT image_id, x, y, 2, (1000 - v) / 100 FROM raster)"""


@QUERIES.add(LABELLED + " SELECT image_id, x, y, label FROM state WHERE label <> 1")
def expansion_nodes(spark, d):
    return G.moving(state(spark, d), 1)


@QUERIES.add(LABELLED + " SELECT s.image_id, s.x, s.y, a.cost AS t_source, b.cost AS t_sink FROM state s JOIN u a ON a.image_id = s.image_id AND a.x = s.x AND a.y = s.y AND a.cls = 1 JOIN u b ON b.image_id = s.image_id AND b.x = s.x AND b.y = s.y AND b.cls = s.label WHERE s.label <> 1")
def expansion_tlinks(spark, d):
    return G.unary_links(state(spark, d), unary(spark, d), 1, CELL)


def labelled_edges(spark, d):
    e = G.eight_neighbours(state(spark, d), "label")
    node = lambda x, y: F.col(y).cast("bigint") * 50 + F.col(x)
    return e.select("image_id", node("x", "y").alias("u"), node("nx", "ny").alias("v"), (F.lit(2.0) / F.col("dist")).alias("w"), F.col("label").alias("lu"), F.col("n_label").alias("lv"))


EDGE_STATE = LABELLED + EDGES + ", e AS (SELECT p.image_id, CAST(p.y AS BIGINT) * 50 + p.x AS u, CAST(ny AS BIGINT) * 50 + nx AS v, 2.0 / dist AS w, a.label AS lu, b.label AS lv FROM pairs p JOIN state a ON a.image_id = p.image_id AND a.x = p.x AND a.y = p.y JOIN state b ON b.image_id = p.image_id AND b.x = nx AND b.y = ny)"


@QUERIES.add(EDGE_STATE + """ SELECT image_id, u, v, round(CAST(CASE WHEN lu <> 1 AND lv <> 1 AND lu = lv THEN w ELSE 0 END AS DOUBLE), 9) AS cap, round(CAST(CASE WHEN lu <> 1 AND lv <> 1 THEN w ELSE 0 END AS DOUBLE), 9) AS rev,
round(CAST(CASE WHEN (lu <> 1 AND lv <> 1 AND lu <> lv) OR (lu <> 1 AND lv = 1) THEN w ELSE 0 END AS DOUBLE), 9) AS extra_u, round(CAST(CASE WHEN lv <> 1 AND lu = 1 THEN w ELSE 0 END AS DOUBLE), 9) AS extra_v FROM e WHERE NOT (lu = 1 AND lv = 1)""")
def expansion_edges(spark, d):
    return rounded(G.potts_edges(labelled_edges(spark, d), 1), "cap", "rev", "extra_u", "extra_v")


@QUERIES.add(EDGE_STATE + """, p AS (SELECT image_id, sum(CASE WHEN lu <> lv THEN w ELSE 0 END) AS pe FROM e GROUP BY 1), o AS (SELECT s.image_id, sum(cost) AS ue FROM state s JOIN u ON u.image_id = s.image_id AND u.x = s.x AND u.y = s.y AND u.cls = s.label GROUP BY 1)
SELECT image_id, round(CAST(pe + ue AS DOUBLE), 6) AS energy FROM p JOIN o USING (image_id)""")
def energy_total(spark, d):
    both = G.potts_energy(labelled_edges(spark, d)).unionByName(G.unary_energy(state(spark, d), unary(spark, d), CELL))
    return rounded(both.groupBy("image_id").agg(F.sum("energy").alias("energy")), "energy", digits=6)


def members(spark, d):
    return A.segments(A.raster(spark, d)).select(*CELL, "seg_id").withColumn("weight", F.lit(1.0))


PN = LABELLED + """,
c AS (SELECT s.image_id, seg_id, label, count(*) AS n FROM seg JOIN state s USING (image_id, x, y) GROUP BY 1, 2, 3),
t AS (SELECT image_id, seg_id, sum(n) AS total FROM c GROUP BY 1, 2),
l AS (SELECT image_id, seg_id, total, coalesce((SELECT max(label) FROM c WHERE c.image_id = t.image_id AND c.seg_id = t.seg_id AND n > total * 0.5), 3) AS label FROM t),
s AS (SELECT l.image_id, seg_id, l.label, l.total, l.total - coalesce((SELECT sum(n) FROM c WHERE c.image_id = l.image_id AND c.seg_id = l.seg_id AND c.label = l.label), 0) AS against FROM l)"""


def sums(spark, d):
    m = members(spark, d)
    labels = R.dominant_label(m.join(state(spark, d), CELL), 0.5, 3)
    return G.segment_sums(m, state(spark, d), labels)


@QUERIES.add(PN + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, CAST(label AS INT) AS label, CAST(total AS DOUBLE) AS total, CAST(against AS DOUBLE) AS against FROM s")
def pn_sums(spark, d):
    return sums(spark, d)


@QUERIES.add(PN + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, round(CAST(CASE WHEN label = 3 THEN 10.0 ELSE label + against * (10.0 - label) / (total * 0.5) END AS DOUBLE), 6) AS cost FROM s")
def pn_energy(spark, d):
    s = sums(spark, d)
    costs = s.select("image_id", "seg_id", F.explode(F.array(*(F.struct(F.lit(k).alias("cls"), F.lit(float(k if k < 3 else 10)).alias("cost")) for k in range(4)))).alias("c")).select("image_id", "seg_id", "c.cls", "c.cost")
    return rounded(G.segment_energy(s, costs, 3, 0.5), "cost", digits=6)


def network(spark, d):
    """Every image as nodes, unary costs and Potts edges."""
    px = A.raster(spark, d)
    node = lambda x, y: F.col(y).cast("bigint") * 50 + F.col(x)
    v = F.col("v")
    nodes = px.select("image_id", node("x", "y").alias("node"), F.array(v / 100, F.abs(v - 500) / 100, (1000 - v) / 100).alias("costs"))
    edges = G.eight_neighbours(px, "v").select("image_id", node("x", "y").alias("u"), node("nx", "ny").alias("v"), (F.lit(2.0) / F.col("dist")).alias("w"))
    return nodes, edges


@QUERIES.add()
def max_flow(spark, d):
    nodes, edges = network(spark, d)
    t = nodes.select("image_id", "node", F.col("costs")[0].alias("t_source"), F.col("costs")[2].alias("t_sink"))
    return G.max_flows(t, edges.select("image_id", "u", "v", F.col("w").alias("cap"), F.col("w").alias("rev")))


@QUERIES.add()
def alpha_expansion(spark, d):
    return G.label_images(*network(spark, d))


@QUERIES.add()
def alpha_expansion_segments(spark, d):
    """The same images with superpixels that ask for one label."""
    nodes, edges = network(spark, d)
    px = A.segments(A.raster(spark, d))
    members = px.select("image_id", "seg_id", (F.col("y").cast("bigint") * 50 + F.col("x")).alias("node"), F.lit(1.0).alias("weight"))
    costs = R.sizes(px).select("image_id", "seg_id", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("n_pixels") * 1.0).alias("costs"))
    return G.label_images(nodes, edges, members, costs)


@QUERIES.add()
def segment_layers(spark, d):
    """Two layers of superpixels, the second made of the first; touching ones should agree, and labels cost to occur."""
    nodes, edges = network(spark, d)
    px = A.raster(spark, d)
    fine, coarse = A.segments(px), A.segments(px, 1)
    member = fine.select("image_id", F.lit(0).alias("layer"), "seg_id", (F.col("y").cast("bigint") * 50 + F.col("x")).alias("node"), F.lit(1.0).alias("weight"))
    above = R.layer_overlap(fine, coarse).select("image_id", F.lit(1).alias("layer"), F.col("parent").alias("seg_id"), F.col("child").cast("bigint").alias("node"), F.col("weight").cast("double").alias("weight"))
    price = lambda seg, layer, share: R.sizes(seg).select("image_id", F.lit(layer).alias("layer"), "seg_id", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("n_pixels") * share).alias("costs"))
    touching = R.adjacency(fine).where("a < b").select("image_id", F.lit(0).alias("layer"), "a", "b", F.lit(2.0).alias("w"))
    return G.label_images(nodes, edges, member.unionByName(above), price(fine, 0, 1.0).unionByName(price(coarse, 1, 0.5)), touching=touching, nested=True, presence=[5.0, 20.0, 5.0])


@QUERIES.add()
def range_moves(spark, d):
    """Ten levels of the values, edges truncated linear, moves of three labels."""
    nodes, edges = network(spark, d)
    v = (F.col("y").cast("bigint") * 50 + F.col("x")).alias("node")
    costs = A.raster(spark, d).select("image_id", v, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.abs(F.col("v") - 100 * k - 50) / 100).alias("costs"))
    return G.label_images(costs, edges.withColumn("w", F.col("w") / 8), truncated=3.0, size=3)


@QUERIES.add()
def joint_moves(spark, d):
    """Objects by value and levels as sensor labels, coupled."""
    nodes, edges = network(spark, d)
    px = A.raster(spark, d).withColumn("node", F.col("y").cast("bigint") * 50 + F.col("x"))
    objects = px.select("image_id", "node", F.array(F.col("v") / 250, (1000 - F.col("v")) / 250).alias("costs"))
    sensor = px.select("image_id", "node", F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.abs(F.col("v") / 200 - k)).alias("costs"))
    return G.label_jointly(objects, sensor, edges.withColumn("w", F.col("w") / 4), 2.0, 0.25, 0.5)


@QUERIES.add(A.sql("seg") + " SELECT image_id, CAST(seg_id AS INT) AS seg_id, cls, CAST(CASE WHEN cls = 3 THEN 0.5 * n ELSE 0 END AS DOUBLE) AS cost FROM (SELECT image_id, seg_id, count(*) AS n FROM seg GROUP BY 1, 2), (SELECT CAST(unnest(range(4)) AS INT) AS cls)")
def consistency_cost(spark, d):
    return G.consistency_costs(R.sizes(A.segments(A.raster(spark, d))), 3, 0.5)
