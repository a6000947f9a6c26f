"""The entry points and the stream, end to end on small inputs."""

import struct

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessera import adapters as A
from tessera import catalog, plans, streaming
from tessera.catalog import projection
from tessera.sources import binary


def test_evaluation_headline(spark, small):
    rows = plans.EvaluationPlan().headline(A.scored(spark, small)).collect()
    assert len(rows) == 3 and all(0 <= r.ap <= 1 and 0 <= r.f <= 1 for r in rows)


def test_scan_training_and_scoring(spark, small):
    plan = plans.ScanPlan(projection.FUSED, 64, 48, 3.0, 8)
    points = A.points(spark, small)
    truth = plan.pixels(points).select("frame", "u", "v", (F.col("z") > 0).cast("int").alias("label"))
    scored = plan.score(points, plan.train(points, truth, rounds=2))
    assert scored.count() == truth.count() and scored.where("p < 0 OR p > 1").count() == 0


def test_labelling(spark, small):
    px = A.rgb(spark, small).where("x < 8")
    scored = px.withColumn("scores", F.array(F.col("r") / 64.0, F.col("g") / 64.0))
    lidar = px.where("x % 2 = 0").select("image_id", "x", "y", (F.col("b") / 256.0).alias("p"))
    plan = plans.LabelPlan()
    out = plan.solve(px, plan.unary(scored, lidar))
    assert out.count() == px.count() and {r.label for r in out.collect()} <= {0, 1}


def test_segment_labels(spark, small):
    px = A.raster(spark, small)
    truth = px.select("image_id", "x", "y", F.when(F.col("v") > 500, 2).otherwise(1).alias("label"))
    assert plans.segment_labels(px, 5, 2.0, truth).count() > 0


def test_scans_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, x in (("000001", 10.0), ("000002", 20.0)):
        (tmp_path / "in" / f"{name}.bin").write_bytes(struct.pack("<8f", x, 0.1, 0.2, 0.5, x, 0.1, 0.2, 0.9))
    q = streaming.project_stream(streaming.scans(spark, str(tmp_path / "in")), projection.FUSED, 64, 48, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.frame for r in rows) == ["000001", "000002"] and all(r.idx == 1 for r in rows)


def test_scans_are_whole(spark, tmp_path):
    """Scans of more points than the reference's buffer holds: a file, and the query against its SQL."""
    (tmp_path / "long.bin").write_bytes(np.arange(4 * 250_003, dtype="<f4").tobytes() + b"\0" * 7)
    file = binary.scan(binary.files(spark, str(tmp_path), "*.bin"))
    assert tuple(file.agg(F.count("*"), F.countDistinct("idx"), F.max("idx"), F.sum((F.col("refl") == 4 * F.col("idx") + 3).cast("int"))).first()) == (250_003, 250_003, 250_002, 250_003)
    numbers = spark.range(0, 2_000_000, 3, 6).select(F.col("id").alias("event_id"), F.when(F.col("id") < 99, None).when(F.col("id") % 100 < 40, F.col("id") % 7).otherwise(0).alias("user_id"), (F.hash("id") % 50_000 / 100).alias("value"))
    numbers.orderBy(F.hash("event_id")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    catalog.queries()["scan_points"](spark, str(tmp_path)).write.parquet(str(tmp_path / "ours"))
    con.execute("CREATE TABLE theirs AS " + catalog.oracle_sql()["scan_points"])
    con.execute(f"CREATE TABLE ours AS SELECT * FROM '{tmp_path}/ours/*.parquet'")
    assert con.execute("SELECT max(idx) FROM theirs").fetchone()[0] > 250_000
    for a, b in (("ours", "theirs"), ("theirs", "ours")):
        assert con.execute(f"SELECT count(*) FROM (SELECT frame_id, idx, x, y, z, refl FROM {a} EXCEPT ALL SELECT frame_id, idx, x, y, z, refl FROM {b})").fetchone() == (0,)


def test_fields_from_potentials(spark, small):
    px = A.rgb(spark, small).withColumn("v", F.col("r").cast("double"))

    class Level(plans.UnaryPotential):
        middle = 0.0

        def train(self, pixels):
            self.middle = pixels.agg(F.avg("v")).first()[0]

        def costs(self, pixels):
            off = (F.col("v") - self.middle) / 10
            return pixels.select("image_id", "x", "y", F.posexplode(F.array(F.greatest(off, F.lit(0.0)), F.greatest(-off, F.lit(0.0)))).alias("cls", "cost"))

    level = Level()
    plan = plans.FieldPlan([level, level], [plans.Contrast(["v"], [1.0]), plans.Contrast(["v"], [1.0], prior=0.5)])
    plan.train(px)
    assert level.middle > 0
    out = plan.solve(px)
    assert {(r.image_id, r.x, r.y) for r in out.collect()} == {(r.image_id, r.x, r.y) for r in px.collect()}
    apart = plans.FieldPlan([level], [plans.Contrast(["v"], [1.0], prior=0.0, factor=0.0)]).solve(px).join(px, ["image_id", "x", "y"]).collect()
    assert all(r.label == (r.v > level.middle) for r in apart if r.v != level.middle)


def test_labels_of_a_data_set(spark):
    data = plans.Dataset(spark.createDataFrame([(1, 255, 0, 0), (2, 0, 255, 0)], "label int, r int, g int, b int"))
    labels = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 2), ("a", 0, 2, 0)], "image_id string, y int, x int, label int")
    back = data.decode(data.encode(labels).drop("label")).select("image_id", "y", "x", "label")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, labels.collect()))
