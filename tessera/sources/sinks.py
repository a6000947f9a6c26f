"""Exports: training and evaluation matrices, cost and segment files, label images, models and their answers.

Matrices are headerless tab-separated values with keys in front, so that answers can be joined back.
Binary layouts come as (stem, content) rows, one file a row; a store of files is written from those.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import regions
from tessera.sources import binary, tables

ROW = ["image_id", "y", "x"]


def dense_matrix(pixels: DataFrame, train: bool) -> DataFrame:
    """Keys, then (weight, label,) x, y, z, refl, curvature, height_var, max_hdiff of pixels that have a point; ``pixels``
    name the pixel (image_id, row, col)."""
    head = ["image_id", "row", "col", *(["weight", "label"] if train else [])]
    return pixels.where(F.col("valid")).select(*head, *tables.DENSE)


def segment_matrix(points: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Keys, then (weight, label,) the means x, y, z, refl, curvature, max_hdiff and the sum height_var of the points in
    each segment that has any. ``labels`` (image_id, seg_id, label, weight): label 0 is the wanted class, written as 1;
    all others are written as 0."""
    means = regions.point_means(points, tables.SEGMENT[:-1], tables.SEGMENT[-1]).drop("n_points")
    if labels is None:
        return means.select(*regions.SEG, *tables.SEGMENT)
    wanted = labels.select(*regions.SEG, "weight", (F.col("label") == 0).cast("int").alias("label"))
    return means.join(wanted, regions.SEG).select(*regions.SEG, "weight", "label", *tables.SEGMENT)


def write_ordered(matrix: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A matrix as text, its rows in the order of their keys in each file and from file to file."""
    tables.write_matrix(matrix.repartitionByRange(*keys).sortWithinPartitions(*keys), path, matrix.columns)


def _packed(rows: DataFrame, key: str, pack) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stem": [str(group[key].iloc[0])], "content": [pack(group)]})

    return rows.groupBy(key).applyInPandas(one, "stem string, content binary")  # one image a group


def pack_dense_costs(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, scores) -> (stem, content): width, height, classes, then float64 by row, column, class; pixels
    that are not there score 0."""

    def pack(g: pd.DataFrame) -> bytes:
        out = np.zeros((g["y"].max() + 1, g["x"].max() + 1, len(g["scores"].iloc[0])))
        out[g["y"], g["x"]] = np.array(g["scores"].tolist(), float)
        h, w, c = out.shape
        return struct.pack("<3i", w, h, c) + out.astype("<f8").tobytes()

    return _packed(pixels.select(*ROW, "scores"), "image_id", pack)


def pack_segment_costs(costs: DataFrame) -> DataFrame:
    """(image_id, seg_id, scores) -> (stem, content): float64 by segment and class, segments in the order of their ids."""
    pack = lambda g: np.array(g.sort_values("seg_id")["scores"].tolist(), "<f8").tobytes()
    return _packed(costs.select("image_id", "seg_id", "scores"), "image_id", pack)


def pack_segments(members: DataFrame) -> DataFrame:
    """(image_id, seg_id, pixel) -> (stem, content) of images that have any: segments in the order of their ids, pixels
    in theirs."""
    pack = lambda g: binary.pack_segments([sorted(p) for _, p in g.groupby("seg_id")["pixel"]])
    return _packed(members.select("image_id", "seg_id", "pixel"), "image_id", pack)


def encode_labels(pixels: DataFrame, palette: DataFrame, void: Sequence[int] = (0, 0, 0)) -> DataFrame:
    """Labels to colours by a palette (label, r, g, b); labels outside it get the void colour."""
    out = pixels.join(palette.select("label", "r", "g", "b"), "label", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)).cast("int") for c, v in zip("rgb", void, strict=True)})


def pack_labels(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """(image_id, y, x, label) -> (stem, content): label images in the palette's colours."""
    return binary.pack_images(encode_labels(pixels, palette).select(*ROW, "r", "g", "b"), ["r", "g", "b"])


def overlay(pixels: DataFrame, probability: Column, share: float = 0.5) -> DataFrame:
    """Pixels with a point tinted green where the probability passes one half, red where not; others as they are."""
    likely = probability > 0.5
    tint = {"r": F.when(likely, 0).otherwise(255), "g": F.when(likely, 255).otherwise(0), "b": F.lit(0)}
    mixed = {c: F.when(probability.isNull(), F.col(c)).otherwise(F.floor(F.col(c) * (1 - share) + t * share)).cast("int") for c, t in tint.items()}
    return pixels.withColumns(mixed)


def save_words(words: DataFrame, path: str) -> None:
    """Word images (image_id, y, x, word), a folder per image."""
    words.select(*ROW, "word").repartition("image_id").sortWithinPartitions("image_id", "y", "x").write.partitionBy("image_id").parquet(path)


def save_model(model, path: str) -> None:
    """A learner's model and, as text, its trees."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(model.toDebugString,)], "model string").coalesce(1).write.mode("overwrite").text(f"{path}/text")


def load_model(path: str):
    from pyspark.ml.classification import GBTClassificationModel

    return GBTClassificationModel.load(f"{path}/model")


def save_answers(model, rows: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Probabilities of the positive class by key, stored."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    answers = model.transform(rows.withColumn("features", array_to_vector("features"))).select(*keys, vector_to_array("probability")[1].alias("p"))
    answers.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)
