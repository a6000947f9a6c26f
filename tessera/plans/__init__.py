"""The three entry points as lazy plans: labelling images, scoring range scans, evaluating predictions."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import costs, graphs, learning, metrics, raster, regions
from tessera.sources import sinks, tables

KEY = ["image_id", "x", "y"]


@dataclass
class ScanPlan:
    """Points to per-pixel features and, with a trained model, to probabilities."""

    matrix: Sequence[Sequence[float]]
    width: int = 1242
    height: int = 376
    radius: float = 0.3
    tile: int = 32
    features: list[str] = field(default_factory=lambda: ["x", "y", "z", "refl", "curvature", "height_var", "max_hdiff"])

    def pixels(self, points: DataFrame) -> DataFrame:
        return raster.last_per_cell(raster.project_points(points, self.matrix, self.width, self.height), "frame", "u", "v")

    def describe(self, points: DataFrame) -> DataFrame:
        """(frame, u, v, features) of valid pixels; lonely ones have shape 0."""
        px = self.pixels(points)
        pairs = raster.neighbours(px, self.radius, self.tile)
        shape = raster.shape_features(raster.scatter(pairs)).drop("weight")
        key = ["frame", "u", "v"]
        return px.join(shape, key, "left").join(raster.height_range(pairs).drop("n"), key, "left").na.fill(0.0, ["curvature", "height_var", "max_hdiff"])

    def train(self, points: DataFrame, truth: DataFrame, rounds: int = 20):
        """Boosted trees on described pixels joined to their truth (frame, u, v, label)."""
        rows = self.describe(points).join(truth, ["frame", "u", "v"]).select(F.array(*(F.col(f).cast("double") for f in self.features)).alias("features"), "label")
        return learning.train_gbt(rows, rounds=rounds)

    def score(self, points: DataFrame, model) -> DataFrame:
        """(frame, u, v, p): the probability of the positive class, keyed by pixel."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        rows = self.describe(points).withColumn("features", array_to_vector(F.array(*(F.col(f).cast("double") for f in self.features))))
        return model.transform(rows).select("frame", "u", "v", vector_to_array("probability")[1].alias("p"))


@dataclass
class LabelPlan:
    """Scores, range-sensor probabilities and superpixels to labels of least energy."""

    bands: list[str] = field(default_factory=lambda: ["r", "g", "b"])
    weights: list[float] = field(default_factory=lambda: [1.0, 1.0, 1.0])
    prior: float = 1.0
    factor: float = 2.0
    beta: float = 1000.0
    sweeps: int = 4

    def unary(self, scored: DataFrame, lidar: DataFrame) -> DataFrame:
        """(image_id, x, y, cls, cost): fused where a range point exists."""
        return costs.fuse_pixels(scored, lidar, KEY)

    def solve(self, pixels: DataFrame, unary: DataFrame) -> DataFrame:
        """(image_id, node, label, energy); node is y * 2**24 + x, however wide the image."""
        node = lambda x, y: F.col(y).cast("bigint") * (1 << 24) + F.col(x)
        nodes = unary.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "cost"))), lambda c: c["cost"]).alias("costs")).select("image_id", node("x", "y").alias("node"), "costs")
        weight = graphs.contrast_weight(self.bands, self.weights, self.prior, self.factor, self.beta)
        edges = graphs.eight_neighbours(pixels, *self.bands).select("image_id", node("x", "y").alias("u"), node("nx", "ny").alias("v"), weight.alias("w"))
        return graphs.label_images(nodes, edges, sweeps=self.sweeps)


class UnaryPotential(ABC):
    """Costs of labels per pixel; trained before it is asked, if it needs to be."""

    def train(self, pixels: DataFrame) -> None:
        """Fits what the costs need."""

    @abstractmethod
    def costs(self, pixels: DataFrame) -> DataFrame:
        """(image_id, x, y, cls, cost), one row a label; several potentials add up."""


class PairwisePotential(ABC):
    """Weights between pixels."""

    @abstractmethod
    def edges(self, pixels: DataFrame) -> DataFrame:
        """(image_id, x, y, nx, ny, w); several potentials add up."""


@dataclass
class Contrast(PairwisePotential):
    """Neighbours of like colour pull together."""

    bands: list[str]
    weights: list[float]
    prior: float = 1.0
    factor: float = 2.0
    beta: float = 1000.0

    def edges(self, pixels: DataFrame) -> DataFrame:
        w = graphs.contrast_weight(self.bands, self.weights, self.prior, self.factor, self.beta)
        return graphs.eight_neighbours(pixels, *self.bands).select(*KEY, "nx", "ny", w.alias("w"))


@dataclass
class FieldPlan:
    """A random field put together from potentials, and its labels of least energy."""

    unary: list[UnaryPotential]
    pairwise: list[PairwisePotential]
    sweeps: int = 4
    truncated: float | None = None

    def train(self, pixels: DataFrame) -> None:
        for p in self.unary:
            p.train(pixels)

    def solve(self, pixels: DataFrame) -> DataFrame:
        """(image_id, x, y, label, energy)."""
        node = lambda x, y: F.col(y).cast("bigint") * (1 << 24) + F.col(x)
        every = reduce(DataFrame.unionByName, (p.costs(pixels).select(*KEY, "cls", "cost") for p in self.unary))
        summed = every.groupBy(*KEY, "cls").agg(F.sum("cost").alias("cost")).groupBy(*KEY)
        nodes = summed.agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "cost"))), lambda c: c["cost"]).alias("costs")).select("image_id", node("x", "y").alias("node"), "costs")
        edges = reduce(DataFrame.unionByName, (p.edges(pixels).select("image_id", node("x", "y").alias("u"), node("nx", "ny").alias("v"), F.col("w").cast("double")) for p in self.pairwise))
        out = graphs.label_images(nodes, edges, sweeps=self.sweeps, truncated=self.truncated)
        return out.select("image_id", (F.col("node") % (1 << 24)).cast("int").alias("x"), F.floor(F.col("node") / (1 << 24)).cast("int").alias("y"), "label", "energy")


@dataclass
class Dataset:
    """How a data set writes its labels: a palette (label, r, g, b), label 0 void."""

    palette: DataFrame

    def decode(self, pixels: DataFrame) -> DataFrame:
        return tables.decode_labels(pixels, self.palette)

    def encode(self, labels: DataFrame) -> DataFrame:
        return sinks.encode_labels(labels, self.palette)


@dataclass
class EvaluationPlan:
    """Scored pixels with truth to curves and the six headline measures per category."""

    steps: int = 255

    def curve(self, scored: DataFrame) -> DataFrame:
        return metrics.pr_curve(scored, "category", steps=self.steps)

    def headline(self, scored: DataFrame) -> DataFrame:
        """(category, k, thr, f, precision, recall, fn, fp, tp, tn, ap) in one row per category."""
        curve = self.curve(scored)
        return metrics.max_f(curve, "category").join(metrics.average_precision(curve, "category"), "category")


def segment_labels(pixels: DataFrame, distance: int, ratio: float, truth: DataFrame) -> DataFrame:
    """Superpixels with their majority label and size: a segment classifier's training rows."""
    found = regions.grid_superpixels(pixels, distance, ratio)
    ids = found.select(*KEY, (F.col("cy") * 100_000 + F.col("cx")).cast("int").alias("seg_id"))
    return regions.majority_label(ids.join(truth.select(*KEY, "label"), KEY))
