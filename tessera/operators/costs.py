"""Unary costs of pixels and segments from classifier scores and range-sensor probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import imaging as I


def lidar_costs(p: Column) -> Column:
    """array(cost of class 0, cost of class 1) of a probability of class 0; null: one half. Both arms are
    kept off zero (a deviation: an unguarded logarithm would be infinite)."""
    guarded = F.coalesce(p, F.lit(0.5))
    return F.array(I.logloss(guarded), I.logloss(1 - guarded))


def pixel_costs(pixels: DataFrame, lidar: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """(keys, class, cost) from the range sensor alone: pixels without a point cost -ln 0.5 either way."""
    joined = pixels.select(*keys).join(lidar.select(*keys, "p"), keys, "left")
    return joined.select(*keys, F.posexplode(F.transform(lidar_costs(F.col("p")), lambda c: c * factor)).alias("cls", "cost"))


def fuse_pixels(pixels: DataFrame, lidar: DataFrame, keys: list[str], scores: str = "scores", factor: float = 1.0) -> DataFrame:
    """(keys, class, cost): half softmax and half range-sensor cost where there is a point, else softmax."""
    joined = pixels.select(*keys, I.softmax_costs(F.col(scores)).alias("soft")).join(lidar.select(*keys, "p"), keys, "left")
    both = F.zip_with("soft", lidar_costs(F.col("p")), lambda s, c: 0.5 * s + 0.5 * c)
    fused = F.when(F.col("p").isNotNull(), both).otherwise(F.col("soft"))
    return joined.select(*keys, F.posexplode(F.transform(fused, lambda c: c * factor)).alias("cls", "cost"))


def segment_costs(segments: DataFrame, keys: list[str], scores: str = "scores", p: str | None = None, factor: float = 1.0, alpha: float = 0.1, prior: float = 1.0) -> DataFrame:
    """(keys, class, cost) of segments with ``n`` pixels, cut off at -w ln alpha; the last class is the free
    label. With ``p`` (null: no point in the segment) the cost is w (softmax + range / 2) / 2."""
    w = F.lit(factor) * F.col("n")
    most = w * -math.log(alpha)
    soft = I.softmax_costs(F.col(scores))
    mixed = soft
    if p is not None:
        mixed = F.when(F.col(p).isNotNull(), F.zip_with(soft, lidar_costs(F.col(p)), lambda s, c: 0.5 * (s + 0.5 * c))).otherwise(soft)
    capped = F.transform(mixed, lambda c: F.least(w * c, most))
    return segments.select(*keys, F.posexplode(F.concat(capped, F.array(most + F.lit(prior) * F.col("n")))).alias("cls", "cost"))


def height_costs(nodes: DataFrame, keys: list[str], classes: int, lidar_class: str = "lidar", factor: float = 1.0, threshold: float = 0.2) -> DataFrame:
    """(keys, class, cost): -ln 0.8 where the label agrees with the sensor's, -ln threshold where it does not,
    -ln 0.5 without a sensor label (null)."""
    cls = F.explode(F.array(*(F.lit(k) for k in range(classes)))).alias("cls")
    cost = F.when(F.col(lidar_class).isNull(), F.lit(-math.log(0.5))).when(F.col(lidar_class) == F.col("cls"), F.lit(-math.log(0.8))).otherwise(F.lit(-math.log(threshold)))
    return nodes.select(*keys, lidar_class, cls).select(*keys, "cls", (cost * factor).alias("cost"))


def argmin_labels(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label) of least cost, the lowest label of those that tie."""
    return costs.groupBy(*keys).agg(F.min(F.struct("cost", "cls")).alias("best")).select(*keys, F.col("best.cls").alias("label"))
