"""Model files and model tables. Models are small: they are parsed on the driver and become tables."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

STUMPS = "round int, feature int, theta double, a double, b double, sharing_mask int, k array<double>"
LINEAR = "cls int, w array<double>, bias double"
NODES, LEAVES = "tree int, node int, feature int, theta double", "tree int, leaf int, cls int, prob double"
CENTROIDS = "cluster int, mean array<double>"


def boosting(spark: SparkSession, blob: bytes, classes: int, theta: str = "<f8") -> DataFrame:
    """Stumps: a count, then feature, threshold, a, b, sharing mask and k of each class per stump."""
    kind = np.dtype([("feature", "<i4"), ("theta", theta), ("a", "<f8"), ("b", "<f8"), ("mask", "<u4"), ("k", "<f8", (classes,))])
    rows = np.frombuffer(blob, kind, struct.unpack("<i", blob[:4])[0], 4)
    return spark.createDataFrame([(i, int(r["feature"]), float(r["theta"]), float(r["a"]), float(r["b"]), int(r["mask"]), np.atleast_1d(r["k"]).tolist()) for i, r in enumerate(rows)], STUMPS)


def pack_boosting(stumps: list[tuple], theta: str = "<d") -> bytes:
    """Rows of the stump table as a file."""
    return struct.pack("<i", len(stumps)) + b"".join(struct.pack("<i", f) + struct.pack(theta, t) + struct.pack(f"<2dI{len(k)}d", a, b, m, *k) for _, f, t, a, b, m, k in stumps)


def linear(spark: SparkSession, blob: bytes, classes: int, maps: int = 1) -> DataFrame:
    """Linear models: number of features, then weights of each class, then biases. ``maps``: weights per feature, of
    kernel machines."""
    n = struct.unpack("<i", blob[:4])[0] * maps
    v = np.frombuffer(blob, "<f8", classes * (n + 1), 4)
    return spark.createDataFrame([(c, v[c * n : (c + 1) * n].tolist(), float(v[classes * n + c])) for c in range(classes)], LINEAR)


def forest(spark: SparkSession, blob: bytes, classes: int, depth: int, theta: str = "<f8") -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): a count, then leaf probabilities, thresholds and features of each complete tree."""
    leaves, inner = 1 << depth, (1 << depth) - 1
    kind = np.dtype([("prob", "<f8", (leaves, classes)), ("theta", theta, (inner,)), ("feature", "<i4", (inner,))])
    trees = np.frombuffer(blob, kind, struct.unpack("<i", blob[:4])[0], 4)
    nodes = [(t, n, int(r["feature"][n]), float(r["theta"][n])) for t, r in enumerate(trees) for n in range(inner)]
    probs = [(t, leaf, c, float(r["prob"][leaf, c])) for t, r in enumerate(trees) for leaf in range(leaves) for c in range(classes)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(probs, LEAVES)


def kmeans(spark: SparkSession, blob: bytes) -> DataFrame:
    """Centroids: number of clusters and bands, then the means (what follows, a search tree, is not needed)."""
    k, bands = struct.unpack("<2i", blob[:8])
    v = np.frombuffer(blob, "<f8", k * bands, 8).reshape(k, bands)
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], CENTROIDS)


def pack_linear(models: list[tuple[int, list[float], float]], maps: int = 1) -> bytes:
    """Rows (cls, w, bias) of linear models as a file."""
    rows = sorted(models)
    return struct.pack("<i", len(rows[0][1]) // maps) + np.array([w for _, w, _ in rows], "<f8").tobytes() + np.array([b for *_, b in rows], "<f8").tobytes()


def pack_forest(nodes: list[tuple], leaves: list[tuple], theta: str = "<f8") -> bytes:
    """Rows of the node and leaf tables of complete trees as a file."""
    trees = 1 + max(n[0] for n in nodes)
    out = struct.pack("<i", trees)
    for t in range(trees):
        inner = sorted(n for n in nodes if n[0] == t)
        probs = sorted(x for x in leaves if x[0] == t)
        out += np.array([p for *_, p in probs], "<f8").tobytes() + np.array([x for *_, x in inner], theta).tobytes() + np.array([f for _, _, f, _ in inner], "<i4").tobytes()
    return out


def pack_kmeans(centroids: list[tuple[int, list[float]]]) -> bytes:
    """Rows (cluster, mean) as a file; the search tree and scaler that may follow are not written."""
    means = np.array([m for _, m in sorted(centroids)], "<f8")
    return struct.pack("<2i", *means.shape) + means.tobytes()
