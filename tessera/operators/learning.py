"""Learners: clustering, boosting, linear models and forests, as aggregations and joins of model tables."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import imaging as I
from tessera.operators.bins import filled
from tessera.storage import Rounds, stored

# --- vectors and clusters ---------------------------------------------------------------------------


def dimensions(vectors: DataFrame, key: str = "vec_id", features: str = "features") -> DataFrame:
    return vectors.select(key, F.posexplode(features).alias("dim", "f"))


def scaler(vectors: DataFrame, features: str = "features") -> DataFrame:
    """(dim, mean, std): population statistics of each dimension."""
    return vectors.select(F.posexplode(features).alias("dim", "f")).groupBy("dim").agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("std"))


def scaler_arrays(stats: DataFrame) -> tuple[list[float], list[float]]:
    """The scaler on the driver: as many numbers as dimensions."""
    rows = sorted(stats.collect(), key=lambda r: r["dim"])
    return [r["mean"] for r in rows], [r["std"] or 1.0 for r in rows]


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def scaled(features: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """z-scores, row by row, without exploding."""
    return F.transform(F.arrays_zip(features.alias("f"), literal(mean).alias("m"), literal(std).alias("s")), lambda t: (t["f"] - t["m"]) / t["s"])


def unscaled(features: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    return F.transform(F.arrays_zip(features.alias("f"), literal(mean).alias("m"), literal(std).alias("s")), lambda t: t["f"] * t["s"] + t["m"])


def nearest(vectors: DataFrame, centroids: DataFrame, key: str = "vec_id", digits: int | None = 9) -> DataFrame:
    """(key, cluster, dist): the exact nearest centroid, the lowest number of those that tie. The model is a table of k
    rows, so every vector meets all of it in one map-side pass, many vectors in an array operation."""
    rows = sorted((r["cluster"], r["mean"]) for r in centroids.select("cluster", "mean").collect())  # k rows
    names, means = np.array([c for c, _ in rows], np.int32), np.array([m for _, m in rows], float)
    shared = vectors.sparkSession.sparkContext.broadcast(means)

    def run(batches):
        means = shared.value
        step = max(1, (1 << 21) // max(1, means.size))
        for rb in batches:
            col = rb.column(1)
            x = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rb.num_rows, -1)
            best, dist = np.zeros(rb.num_rows, np.int64), np.zeros(rb.num_rows)
            for i in range(0, rb.num_rows, step):
                d = ((x[i : i + step, None, :] - means[None]) ** 2).sum(axis=2)
                d = d.round(digits) if digits is not None else d
                best[i : i + step], dist[i : i + step] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(names[best]), pa.array(dist)], names=[key, "cluster", "dist"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.where("features IS NOT NULL").select(key, F.col("features").cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, cluster int, dist double")


def cluster_means(vectors: DataFrame, assigned: DataFrame, key: str = "vec_id") -> DataFrame:
    """(cluster, mean): means of the assigned vectors; clusters without any are gone."""
    dims = dimensions(vectors.join(assigned.select(key, "cluster"), key).select("cluster", "features"), "cluster")
    means = dims.groupBy("cluster", "dim").agg(F.avg("f").alias("f"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "f"))), lambda t: t["f"]).alias("mean"))


def kmeans(vectors: DataFrame, first: DataFrame, change: float = 0.01, rounds: int = 20, key: str = "vec_id") -> DataFrame:
    """Lloyd's algorithm from given centroids until less than a share ``change`` of vectors moves."""
    centroids, total, before = first, vectors.count(), None
    labels, means = Rounds("assigned"), Rounds("centroids")
    for _ in range(rounds):
        assigned = labels.store(nearest(vectors, centroids, key))
        centroids = means.store(cluster_means(vectors, assigned, key))
        if before is not None:
            moved = assigned.alias("a").join(before.alias("b"), key).where(F.col("a.cluster") != F.col("b.cluster")).count()
            if moved <= change * total:
                break
        before = assigned
    return centroids


def first_centroids(vectors: DataFrame, k: int, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """(cluster, mean): k random rows, with replacement, each the row of the least hash of its own; one pass."""
    picks = vectors.agg(*(F.min_by("features", F.struct(F.xxhash64(key, F.lit(seed), F.lit(c)), F.col(key))).alias(f"c{c}") for c in range(k)))
    return picks.select(F.posexplode(F.array(*(f"c{c}" for c in range(k)))).alias("cluster", "mean"))


@dataclass
class Codebook:
    """Centres of a feature's vectors, and the scaler that they live behind: trained once, then every vector gets the
    number of its nearest centre as its word."""

    mean: list[float]
    std: list[float]
    centroids: DataFrame

    @classmethod
    def train(cls, vectors: DataFrame, k: int, seed: int = 0, key: str = "vec_id", normalise: bool = True, rounds: int = 20) -> Codebook:
        mean, std = scaler_arrays(scaler(vectors)) if normalise else ([], [])
        z = vectors.withColumn("features", scaled(F.col("features"), mean, std)) if normalise else vectors
        return cls(mean, std, kmeans(z, first_centroids(z, k, seed, key), rounds=rounds, key=key))

    def words(self, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
        """(key, word) of every vector."""
        z = vectors.withColumn("features", scaled(F.col("features"), self.mean, self.std)) if self.mean else vectors
        return nearest(z, self.centroids, key).select(key, F.col("cluster").alias("word"))

    def save(self, path: str) -> None:
        spark = self.centroids.sparkSession
        self.centroids.write.parquet(f"{path}/centroids")
        spark.createDataFrame([(self.mean, self.std)], "mean array<double>, std array<double>").coalesce(1).write.parquet(f"{path}/scaler")

    @classmethod
    def load(cls, spark, path: str) -> Codebook:
        scale = spark.read.parquet(f"{path}/scaler").first()
        return cls(list(scale["mean"]), list(scale["std"]), spark.read.parquet(f"{path}/centroids"))


class Feature(ABC):
    """A dense feature: what a subclass computes per pixel becomes a word per pixel."""

    #: Words of the codebook.
    buckets: int = 50

    @abstractmethod
    def evaluate(self, pixels: DataFrame) -> DataFrame:
        """(vec_id, features) of pixels."""

    def train(self, pixels: DataFrame, seed: int = 0) -> Codebook:
        return Codebook.train(stored(self.evaluate(pixels), "feature"), self.buckets, seed)

    def discretize(self, pixels: DataFrame, book: Codebook) -> DataFrame:
        return book.words(self.evaluate(pixels))


# --- joint boosting -----------------------------------------------------------------------------------


def thetas(start: float, step: float, count: int) -> list[float]:
    """Thresholds: each is the one before plus a widening step (the sum of the last two)."""
    out = [start, start + step]
    while len(out) < count:
        out.append(out[-1] + out[-2])
    return out[:count]


def boost_sums(examples: DataFrame, thresholds: Sequence[float], feature: str = "f", keys: Sequence[str] = ("cls",)) -> DataFrame:
    """(keys, t, p, q, r, u): weight and weighted target, of all rows and of those at or over each threshold.

    Values fall into the bin of the highest threshold they reach; bins are summed once, and suffix
    sums over the bins give every threshold."""
    t = literal(sorted(thresholds))
    reached = F.size(F.filter(t, lambda x: x <= F.col(feature)))
    bins = examples.groupBy(*keys, reached.alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("wz"))
    full = filled(bins, keys, "bin", 0, len(thresholds), ["w", "wz"])
    over = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.partitionBy(*keys)
    s = full.select(*keys, "bin", F.sum("w").over(every).alias("p"), F.sum("w").over(over).alias("q"), F.sum("wz").over(every).alias("r"), F.sum("wz").over(over).alias("u"))
    return s.where("bin > 0").select(*keys, F.element_at(t, F.col("bin")).alias("t"), "p", "q", "r", "u")


def best_stump(sums: list[dict], classes: int) -> dict | None:
    """The stump with the smallest error over features, thresholds and greedily grown sharing sets of fewer than
    all classes. ``sums``: rows (feature, t, cls, p, q, r, u); a model's worth, not data."""
    by: dict[tuple, dict[int, dict]] = {}
    for s in sums:
        by.setdefault((s["feature"], s["t"]), {})[s["cls"]] = s
    best = None
    for (feature, t), per in sorted(by.items()):
        left, chosen = set(per), []
        while left and len(chosen) < max(1, classes - 1):
            options = []
            for c in sorted(left):
                group = [per[k] for k in [*chosen, c]]
                p, q, r, u = (sum(g[n] for g in group) for n in "pqru")
                if q < 1e-6 or p - q < 1e-6:
                    continue
                b = (r - u) / (p - q)
                a = u / q - b
                error = sum(g["p"] - 2 * a * g["u"] - 2 * b * g["r"] + a * a * g["q"] + b * b * g["p"] + 2 * a * b * g["q"] for g in group)
                for k, g in per.items():
                    if k not in chosen and k != c and g["p"] > 0:
                        alone = g["r"] / g["p"]
                        error += g["p"] - 2 * alone * g["r"] + alone * alone * g["p"]
                options.append((error, c, a, b))
            if not options:
                break
            error, c, a, b = min(options)
            chosen.append(c)
            left.discard(c)
            if best is None or error < best["error"]:
                best = {"error": error, "feature": feature, "theta": t, "a": a, "b": b, "sharing_mask": sum(1 << k for k in chosen), "k": {k: (g["r"] / g["p"] if g["p"] > 0 else 0.0) for k, g in per.items()}}
    return best


#: Rounds after which the examples' margins are stored anew; in between they follow from the latest stumps.
STORE_ROUNDS = 25


def _answers(x: np.ndarray, stumps: Sequence[dict], classes: int) -> np.ndarray:
    """Sums of stump answers, rows by classes."""
    out = np.zeros((len(x), classes))
    for s in stumps:
        shares = np.array([s["sharing_mask"] >> c & 1 for c in range(classes)], bool)
        alone = np.array([s["k"].get(c, 0.0) for c in range(classes)])
        high = np.where(x[:, s["feature"]] >= s["theta"], s["a"] + s["b"], s["b"])
        out += np.where(shares, high[:, None], alone)
    return out


def boost_round(data: DataFrame, thresholds: Sequence[float], latest: Sequence[dict], classes: int) -> tuple[list[dict], DataFrame]:
    """(sums of a round as in boost_sums, data with margins up to date). ``data`` (id, features, target, margin): one
    row an example; a task sends one histogram of features, bins and classes."""
    t = np.sort(np.array(thresholds, float))

    def read(rb):
        x = rb.column("features").flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, -1)
        margin = rb.column("margin").flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, classes) + _answers(x, latest, classes)
        z = np.where(rb.column("target").to_numpy(zero_copy_only=False)[:, None] == np.arange(classes), 1.0, -1.0)
        return x, margin, z

    def count(batches):
        total = None
        for rb in batches:
            if not rb.num_rows:
                continue
            x, margin, z = read(rb)
            w = np.exp(-z * margin)
            bins = np.searchsorted(t, x, "right") + np.arange(x.shape[1]) * (len(t) + 1)
            size = x.shape[1] * (len(t) + 1)
            part = np.stack([np.stack([np.bincount(bins.ravel(), np.repeat(v[:, c], x.shape[1]), size) for c in range(classes)], axis=1) for v in (w, w * z)])
            total = part if total is None else total + part
        if total is not None:
            cell = np.arange(total[0].size)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[0].ravel()), pa.array(total[1].ravel())], names=["cell", "w", "wz"])

    def refresh(batches):
        for rb in batches:
            _, margin, _ = read(rb)
            off = pa.array(np.arange(rb.num_rows + 1, dtype=np.int32) * classes)
            yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("features"), rb.column("target"), pa.ListArray.from_arrays(off, pa.array(margin.ravel()))], names=["id", "features", "target", "margin"])

    rows = data.mapInArrow(count, "cell bigint, w double, wz double").groupBy("cell").agg(F.sum("w").alias("w"), F.sum("wz").alias("wz")).orderBy("cell").collect()
    h = np.array([(r["w"], r["wz"]) for r in rows]).reshape(-1, len(t) + 1, classes, 2)
    over = h[:, ::-1].cumsum(axis=1)[:, ::-1]
    over = over.tolist()
    sums = [{"feature": f, "t": float(t[k]), "cls": c, "p": over[f][0][c][0], "q": over[f][k + 1][c][0], "r": over[f][0][c][1], "u": over[f][k + 1][c][1]} for f in range(len(h)) for k in range(len(t)) for c in range(classes)]
    return sums, data.mapInArrow(refresh, data.schema)


def train_boosting(rows: DataFrame, classes: int, thresholds: Sequence[float], rounds: int) -> list[dict]:
    """Joint boosting of shared stumps over (id, target, features array). Each round is one distributed aggregation
    and a choice among its few sums on the driver."""
    zero = F.array_repeat(F.lit(0.0), classes)
    kept = Rounds("boost")
    data = kept.store(rows.select("id", F.col("features").cast("array<double>"), F.col("target").cast("int"), zero.alias("margin")))
    model: list[dict] = []
    held = 0  # stumps that the stored margins know
    for _ in range(rounds):
        sums, fresh = boost_round(data, thresholds, model[held:], classes)
        best = best_stump(sums, classes)
        if best is None:
            break
        if len(model) - held >= STORE_ROUNDS:
            data, held = kept.store(fresh), len(model)
        model.append(best)
    return model


def stump_value(stump: dict, features: Column) -> Column:
    """A stump's answer for the class in column ``cls``."""
    mine = F.lit(stump["sharing_mask"]).bitwiseAND(F.expr("shiftleft(1, cls)")) != 0
    alone = F.lit(0.0)
    for c, v in stump["k"].items():
        alone = F.when(F.col("cls") == c, F.lit(float(v))).otherwise(alone)
    high = F.element_at(features, stump["feature"] + 1) >= stump["theta"]
    return F.when(mine, F.when(high, F.lit(stump["a"] + stump["b"])).otherwise(F.lit(stump["b"]))).otherwise(alone)


def boost_scores(vectors: DataFrame, stumps: DataFrame, classes: int, key: str = "vec_id") -> DataFrame:
    """(key, cls, score): sums of stump answers; ``stumps`` (round, feature, theta, a, b, sharing_mask, k array) is
    a model table, collected into one row and read by every vector map-side."""
    model = stumps.agg(F.array_sort(F.collect_list(F.struct("round", "feature", "theta", "a", "b", "sharing_mask", "k"))).alias("_m"))
    cls = F.explode(F.array(*(F.lit(c) for c in range(classes)))).alias("cls")

    def answer(s: Column) -> Column:
        high = F.element_at(F.col("features"), s["feature"] + 1) >= s["theta"]
        mine = F.getbit(s["sharing_mask"], F.col("cls")) == 1
        return F.when(mine, F.when(high, s["a"] + s["b"]).otherwise(s["b"])).otherwise(F.element_at(s["k"], F.col("cls") + 1))

    score = F.aggregate(F.transform("_m", answer), F.lit(0.0), lambda a, x: a + x)
    return vectors.crossJoin(F.broadcast(model)).select(key, "features", "_m", cls).select(key, "cls", score.alias("score"))


# --- linear models, forests and trees -----------------------------------------------------------------


def linear_scores(vectors: DataFrame, models: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, cls, score): w . x + bias for each class of a model table (cls, w array, bias)."""
    dot = F.aggregate(F.zip_with("features", "w", lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return vectors.crossJoin(F.broadcast(models)).select(key, "cls", (dot + F.col("bias")).alias("score"))  # one row per class of the model


def train_linear(rows: DataFrame, label: str = "label", regularisation: float = 0.01, epochs: int = 20):
    """One-versus-rest linear SVMs by the library's optimiser (not stochastic descent in a given order)."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label"))
    return OneVsRest(classifier=LinearSVC(regParam=regularisation, maxIter=epochs)).fit(data)


def entropy_splits(rows: DataFrame, thresholds: Sequence[float], feature: str = "f", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, t, score): weighted class entropy of both sides of each threshold, in nats; lower is better. One
    pass: values are binned, the bins summed, and prefix sums give each side."""
    t = literal(sorted(thresholds))
    reached = F.size(F.filter(t, lambda x: x <= F.col(feature)))
    bins = rows.groupBy(*keys, label, reached.alias("bin")).agg(F.count("*").alias("n"))
    full = filled(bins, [*keys, label], "bin", 0, len(thresholds), ["n"])
    w = W.partitionBy(*keys, label).orderBy("bin")
    right = F.sum("n").over(w.rowsBetween(W.currentRow, W.unboundedFollowing))
    left = F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sides = full.select(*keys, label, "bin", left.alias("_l"), right.alias("_r")).where("bin > 0").select(*keys, label, "bin", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_l").alias("n")), F.struct(F.lit(1).alias("side"), F.col("_r").alias("n")))).alias("s")).select(*keys, label, "bin", "s.side", "s.n")
    total = F.sum("n").over(W.partitionBy(*keys, "bin", "side"))
    terms = sides.withColumn("_t", total).where("n > 0")
    return terms.groupBy(*keys, "bin").agg((-F.sum(F.col("n") * F.log(F.col("n") / F.col("_t")))).alias("score")).select(*keys, F.element_at(t, F.col("bin")).alias("t"), "score")


def tree_leaf(features: Column, tree: Column, depth: int) -> Column:
    """Leaf of a complete binary tree: level by level, the node is index + 2^k - 1, and a value at or over its
    threshold adds 2^k. ``tree``: array<struct<feature, theta>> in node order."""
    index = F.lit(0)
    for k in range(depth):
        node = F.element_at(tree, index + (1 << k))
        index = index + F.when(F.element_at(features, node["feature"] + 1) >= node["theta"], 1 << k).otherwise(0)
    return index


def forest_scores(vectors: DataFrame, nodes: DataFrame, leaves: DataFrame, depth: int, key: str = "vec_id") -> DataFrame:
    """(key, cls, score): log of the mean leaf probability over trees, -1e50 where it is zero. The model tables are
    of fixed size (trees x 2^depth)."""
    packed = nodes.groupBy("tree").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "feature", "theta"))), lambda n: F.struct(n["feature"].alias("feature"), n["theta"].alias("theta"))).alias("t"))
    at = vectors.crossJoin(F.broadcast(packed)).select(key, "tree", tree_leaf(F.col("features"), F.col("t"), depth).alias("leaf"))
    mean = at.join(F.broadcast(leaves), ["tree", "leaf"]).groupBy(key, "cls").agg(F.avg("prob").alias("p"))
    return mean.select(key, "cls", F.when(F.col("p") > 0, F.log(F.when(F.col("p") > 0, F.col("p")))).otherwise(F.lit(-1e50)).alias("score"))


def train_forest(rows: DataFrame, label: str = "label", trees: int = 10, depth: int = 5, seed: int = 0):
    """A random forest with entropy splits by the library."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, impurity="entropy", seed=seed).fit(data)


def mapped(features: Column, spectrum, count: int, period: float) -> Column:
    """Every feature as its approximate kernel map, one after the other."""
    return F.flatten(F.transform(features, lambda f: I.kernel_map(f, spectrum, count, period)))


def train_kernel_svm(rows: DataFrame, spectrum, count: int = 5, period: float = 0.5, label: str = "label", regularisation: float = 0.01, epochs: int = 20):
    """One-versus-rest linear machines on kernel maps (an additive kernel machine)."""
    return train_linear(rows.withColumn("features", mapped(F.col("features"), spectrum, count, period)), label, regularisation, epochs)


def kernel_svm_scores(vectors: DataFrame, models: DataFrame, spectrum, count: int = 5, period: float = 0.5, key: str = "vec_id") -> DataFrame:
    """(key, cls, score) of a model table (cls, w array, bias) whose weights belong to kernel maps."""
    return linear_scores(vectors.withColumn("features", mapped(F.col("features"), spectrum, count, period)), models, key)


def train_gbt(rows: DataFrame, label: str = "label", weight: str | None = None, rounds: int = 20, rate: float = 0.05, bagging: float = 0.8, seed: int = 0, leaves: int = 31, feature_fraction: float = 1.0, patience: int | None = None):
    """Gradient-boosted trees for a binary label, with example weights. Trees are as deep as ``leaves`` leaves need
    when grown level by level. With ``patience`` the model ends where the loss over the training rows had not fallen
    for so many rounds."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector("features").alias("features"), F.col(label).cast("double").alias("label"), *([F.col(weight).alias("weight")] if weight else []))
    gbt = GBTClassifier(maxIter=rounds, stepSize=rate, subsamplingRate=bagging, seed=seed, maxDepth=max(1, math.ceil(math.log2(leaves))), featureSubsetStrategy="all" if feature_fraction >= 1 else str(feature_fraction))
    gbt = gbt.setWeightCol("weight") if weight else gbt
    model = gbt.fit(data)
    if patience is None:
        return model
    best = enough(model.evaluateEachIteration(data), patience)
    return model if best == model.getNumTrees else gbt.setMaxIter(best).fit(data)  # the same seed grows the same first trees


def enough(losses: Sequence[float], patience: int) -> int:
    """Rounds until the least loss that is followed by ``patience`` rounds without a lower one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def importances(model) -> list[tuple[int, float]]:
    """(feature, importance), largest first."""
    v = model.featureImportances
    return sorted(((i, float(v[i])) for i in range(v.size)), key=lambda t: (-t[1], t[0]))


def parity(frames: DataFrame, column: str, odd: bool) -> DataFrame:
    """Half of the frames by the parity of their number: a fixed train and validation split."""
    return frames.where(F.pmod(F.col(column), F.lit(2)) == (1 if odd else 0))
