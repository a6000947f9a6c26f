"""Evaluation: confusion matrices, precision-recall sweeps and what is read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.bins import filled

STEPS = 255
EPS = 1e-10


def confusion(pixels: DataFrame, *keys: str) -> DataFrame:
    """(keys, gt, pred, n) of the pixels whose truth is not void (0)."""
    return pixels.where("gt <> 0").groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))


def class_metrics(matrix: DataFrame, classes: int) -> DataFrame:
    """(cls, gt_n, pred_n, ok, recall, iou) of every class, empty ones as 0."""
    each = matrix.select(F.explode(F.array(F.struct(F.col("gt").alias("cls"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("ok")), F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("ok")))).alias("e")).select("e.*")
    sums = each.groupBy("cls").agg(F.sum("g").alias("gt_n"), F.sum("p").alias("pred_n"), F.sum("ok").alias("ok"))
    dim = matrix.sparkSession.range(1, classes + 1).select(F.col("id").cast("int").alias("cls"))
    full = dim.join(sums, "cls", "left").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return full.select("cls", "gt_n", "pred_n", "ok", ratio(F.col("ok"), F.col("gt_n")).alias("recall"), ratio(F.col("ok"), F.col("gt_n") + F.col("pred_n") - F.col("ok")).alias("iou"))


def summary(metrics: DataFrame) -> DataFrame:
    """(overall, average, waverage): share of right pixels, mean recall, mean IoU over all classes."""
    return metrics.agg(F.coalesce(F.try_divide(F.sum("ok").cast("double"), F.sum("gt_n").cast("double")), F.lit(0.0)).alias("overall"), F.avg("recall").alias("average"), F.avg("iou").alias("waverage"))


def report(matrix: DataFrame, classes: int) -> DataFrame:
    """One text row per class (its row of the matrix in percent, recall, IoU) and one of the summary."""
    m = class_metrics(matrix, classes)
    cells = matrix.select("gt", "pred", "n").groupBy("gt").pivot("pred", list(range(1, classes + 1))).sum("n").na.fill(0)
    row = m.join(cells, m["cls"] == cells["gt"], "left").na.fill(0)
    pct = lambda c: F.format_string("%.2f", c * 100)
    share = lambda k: pct(F.coalesce(F.try_divide(F.col(str(k)).cast("double"), F.col("gt_n").cast("double")), F.lit(0.0)))
    lines = row.select(F.col("cls").alias("line"), F.concat_ws(" ", *(share(k) for k in range(1, classes + 1)), F.lit("recall"), pct(F.col("recall")), F.lit("iou"), pct(F.col("iou"))).alias("value"))
    return lines.unionByName(summary(m).select(F.lit(classes + 1).alias("line"), F.concat_ws(" ", F.lit("overall"), pct(F.col("overall")), F.lit("average"), pct(F.col("average")), F.lit("waverage"), pct(F.col("waverage"))).alias("value")))


def pr_curve(scores: DataFrame, *keys: str, steps: int = STEPS, score: str = "score", gt: str = "gt") -> DataFrame:
    """(keys, k, thr, fn, fp, tp, tn, precision, recall, f) for thresholds 0..steps over ``steps``.

    One pass: scores fall into bins, bins are summed, and two running sums over the few bins give all
    thresholds; the data never meets the thresholds."""
    keys = keys or ("_all",)
    src = scores if keys != ("_all",) else scores.withColumn("_all", F.lit(0))
    # the number of thresholds at or below a score: it is positive for exactly those
    below = F.least(F.lit(steps), F.floor(F.col(score) * steps)).cast("int")
    fixed = below + F.when((below < steps) & ((below + 1).cast("double") / steps <= F.col(score)), 1).when(below.cast("double") / steps > F.col(score), -1).otherwise(0)
    bins = src.groupBy(*keys, fixed.alias("k")).agg(F.sum(F.col(gt).cast("bigint")).alias("pos"), F.sum((1 - F.col(gt)).cast("bigint")).alias("neg"))
    full = filled(bins, keys, "k", 0, steps, ["pos", "neg"])
    w = W.partitionBy(*keys).orderBy("k")
    before, after, every = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(W.currentRow, W.unboundedFollowing), W.partitionBy(*keys)
    c = full.select(*keys, "k", (F.col("k") / F.lit(float(steps))).alias("thr"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("fn"), F.sum("neg").over(after).alias("fp"), F.sum("pos").over(every).alias("p"), F.sum("neg").over(every).alias("n"))
    c = c.withColumn("tp", F.col("p") - F.col("fn")).withColumn("tn", F.col("n") - F.col("fp"))
    c = c.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp") + EPS)).withColumn("recall", F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("p").cast("double")), F.lit(0.0)))
    return c.withColumn("f", f_measure(F.col("precision"), F.col("recall"))).drop("p", "n", *(["_all"] if keys == ("_all",) else []))


def f_measure(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + EPS)


def max_f(curve: DataFrame, *keys: str) -> DataFrame:
    """The point of the largest F, the lowest threshold of those that tie."""
    live = curve.where("precision > 0 OR recall > 0")
    best = F.max_by(F.struct("k", "thr", "f", "precision", "recall", "fn", "fp", "tp", "tn"), F.struct("f", (-F.col("k")).alias("low")))
    return live.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def average_precision(curve: DataFrame, *keys: str) -> DataFrame:
    """11-point interpolated average precision; the recall levels carry their binary rounding."""
    levels = curve.sparkSession.range(11).select((F.col("id") * F.lit(0.1)).alias("level"))  # 11 rows
    at = curve.where("precision > 0 OR recall > 0").join(F.broadcast(levels), F.col("recall") >= F.col("level"))
    top = at.groupBy(*keys, "level").agg(F.max("precision").alias("top"))
    return top.groupBy(*keys).agg((F.sum("top") / 11).alias("ap"))


def measures(point: DataFrame, *keys: str) -> DataFrame:
    """Quality, accuracy and the four rates at a point of the curve."""
    c = lambda n: F.col(n).cast("double")
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (c(n) for n in ("tp", "fp", "tn", "fn"))
    return point.select(*keys, part(tp, tp + fp + fn).alias("quality"), part(tp + tn, tp + fp + tn + fn).alias("accuracy"), part(tp, tp + fn).alias("tpr"), part(fp, fp + tn).alias("fpr"), part(fn, tp + fn).alias("fnr"), part(tn, fp + tn).alias("tnr"), part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"))


def location_prior(masks: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    """Per pixel: mean of the label over all images of its key; images without the pixel count as 0."""
    images = masks.groupBy(*keys).agg(F.countDistinct("image_id").alias("_images"))
    cells = masks.groupBy(*keys, "x", "y").agg(F.sum(label).alias("_sum"))
    joined = cells.join(images, list(keys)) if keys else cells.crossJoin(F.broadcast(images))  # one row
    return joined.select(*keys, "x", "y", (F.col("_sum") / F.col("_images")).alias("prior"))
