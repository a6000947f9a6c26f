"""Superpixels: sizes, histograms, adjacency, labels, and the kernels that make them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.graphs import eight_neighbours
from tessera.storage import Rounds, stored

SEG = ["image_id", "seg_id"]


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy(*SEG).agg(F.count("*").alias("n_pixels"))


def layer_overlap(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(image_id, child, parent, weight): pixels that segments of two layers share."""
    a, b = child.select("image_id", "x", "y", F.col("seg_id").alias("child")), parent.select("image_id", "x", "y", F.col("seg_id").alias("parent"))
    return a.join(b, ["image_id", "x", "y"]).groupBy("image_id", "child", "parent").agg(F.count("*").alias("weight"))


def shifted_pairs(members: DataFrame, value: str = "seg_id") -> DataFrame:
    """(image_id, x, y, a, b): each pixel's value with that of the pixel to the right, and of the one below."""
    wx, wy = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    right = F.when(F.lead("x").over(wx) == F.col("x") + 1, F.lead(value).over(wx))
    below = F.when(F.lead("y").over(wy) == F.col("y") + 1, F.lead(value).over(wy))
    both = members.select("image_id", "x", "y", F.col(value).alias("a"), F.array(right, below).alias("_n"))
    return both.select("image_id", "x", "y", "a", F.explode("_n").alias("b")).where("b IS NOT NULL")


def adjacency(members: DataFrame) -> DataFrame:
    """(image_id, a, b) of segments that touch, in both directions."""
    one = shifted_pairs(members).where("a <> b").select("image_id", "a", "b").distinct()
    return one.union(one.select("image_id", F.col("b"), F.col("a"))).distinct()


def value_range(pixels: DataFrame, value: str = "v") -> DataFrame:
    """(image_id, lo, hi)."""
    return pixels.groupBy("image_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def boundary_length(members: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, lo, hi, length) of touching segments; the last row and column are not counted from."""
    inner = shifted_pairs(members).where(f"x < {width - 1} AND y < {height - 1} AND a <> b")
    return inner.groupBy("image_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("length"))


def histogram(words: DataFrame, bins: int, scale: float = 1000.0) -> DataFrame:
    """(image_id, seg_id, word, share): word counts of segments, scaled to sum to ``scale``; words outside
    0..bins-1 are ignored."""
    counts = words.where(f"word >= 0 AND word < {bins}").groupBy(*SEG, "word").agg(F.count("*").alias("n"))
    total = W.partitionBy(*SEG)
    return counts.select(*SEG, "word", (F.col("n") * scale / F.sum("n").over(total)).alias("share"))


def neighbour_histogram(words: DataFrame, touching: DataFrame, bins: int, scale: float = 1000.0) -> DataFrame:
    """The histogram of each segment and its neighbours together: per-segment counts are summed first,
    so pixels are shuffled once."""
    counts = words.where(f"word >= 0 AND word < {bins}").groupBy(*SEG, "word").agg(F.count("*").alias("n"))
    around = touching.select("image_id", F.col("a").alias("to"), F.col("b").alias("seg_id")).join(counts, SEG).select("image_id", F.col("to").alias("seg_id"), "word", "n")
    summed = counts.unionByName(around).groupBy(*SEG, "word").agg(F.sum("n").alias("n"))
    return summed.select(*SEG, "word", (F.col("n") * scale / F.sum("n").over(W.partitionBy(*SEG))).alias("share"))


def point_means(members: DataFrame, features: list[str], summed: str | None, fix_sum: bool = False) -> DataFrame:
    """Mean of point features per segment; ``summed`` is left a sum unless ``fix_sum``."""
    aggs = [F.avg(f).alias(f) for f in features]
    if summed:
        aggs.append((F.avg if fix_sum else F.sum)(summed).alias(summed))
    return members.groupBy(*SEG).agg(F.count("*").alias("n_points"), *aggs)


def majority_label(members: DataFrame, least: float = 0.5) -> DataFrame:
    """(image_id, seg_id, label, weight): the label of more than ``least`` of the pixels; weight is their number."""
    counts = members.groupBy(*SEG, "label").agg(F.count("*").alias("n"))
    c = counts.withColumn("weight", F.sum("n").over(W.partitionBy(*SEG)))
    return c.where((F.col("label") > 0) & (F.col("n") > least * F.col("weight"))).select(*SEG, "label", "weight")


def dominant_label(members: DataFrame, truncation: float, classes: int) -> DataFrame:
    """(image_id, seg_id, label): the highest label whose weight exceeds W (1 - truncation), else the free
    label ``classes``."""
    counts = members.groupBy(*SEG, "label").agg(F.sum("weight").alias("w"))
    c = counts.withColumn("_all", F.sum("w").over(W.partitionBy(*SEG)))
    win = F.max(F.when(F.col("w") > F.col("_all") * (1 - truncation), F.col("label")))
    return c.groupBy(*SEG).agg(F.coalesce(win, F.lit(classes)).cast("int").alias("label"))


def class_weights(pixels: DataFrame, classes: int, ratio: float = 1.0) -> DataFrame:
    """(cls, n, keep, weight): counts, the probability that a pixel is sampled, and N / (C n); void is left out."""
    counts = pixels.where("gt <> 0").groupBy((F.col("gt") - 1).alias("cls")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())  # over one row per class
    return counts.select("cls", "n", F.least(F.lit(1.0), total * ratio / F.col("n")).alias("keep"), (total / (classes * F.col("n"))).alias("weight"))


def sample_pixels(pixels: DataFrame, weights: DataFrame, seed: int = 0) -> DataFrame:
    """Labelled pixels kept with their class's probability ``keep``: by a hash of the pixel, so the same ones are
    kept however the data is laid out."""
    u = F.pmod(F.xxhash64("image_id", "pixel", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    labelled = pixels.where("gt <> 0").withColumn("cls", F.col("gt") - 1)
    return labelled.join(weights.select("cls", "keep", "weight"), "cls").where(u < F.col("keep")).drop("keep")


def colour_histogram(pixels: DataFrame, buckets: int) -> DataFrame:
    """(image_id, seg_id, r, g, b, share): colour cube shares, cumulated along each axis."""
    b = lambda c: F.floor(F.col(c) * buckets / 256).cast("int").alias(c)
    shares = pixels.select(*SEG, b("r"), b("g"), b("b")).groupBy(*SEG, "r", "g", "b").agg(F.count("*").alias("n"))
    full = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    cube = pixels.sparkSession.range(1).select(full.alias("r")).select("r", full.alias("g")).select("r", "g", full.alias("b"))
    total = shares.groupBy(*SEG).agg(F.sum("n").alias("_all"))
    dense = total.crossJoin(F.broadcast(cube)).join(shares, [*SEG, "r", "g", "b"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / F.col("_all"))  # buckets**3 rows a segment
    for axis in "rgb":
        w = W.partitionBy(*SEG, *(a for a in "rgb" if a != axis)).orderBy(axis).rowsBetween(W.unboundedPreceding, W.currentRow)
        dense = dense.withColumn("share", F.sum("share").over(w))
    return dense.select(*SEG, "r", "g", "b", "share")


def histogram_pairwise(cumulated: DataFrame, lengths: DataFrame, prior: float, factor: float, beta: float) -> DataFrame:
    """(image_id, lo, hi, cost): boundary length times prior + factor exp(-distance^2 / beta)."""
    a = cumulated.select("image_id", F.col("seg_id").alias("lo"), "r", "g", "b", F.col("share").alias("_a"))
    b = cumulated.select("image_id", F.col("seg_id").alias("hi"), "r", "g", "b", F.col("share").alias("_b"))
    d = lengths.join(a, ["image_id", "lo"]).join(b, ["image_id", "hi", "r", "g", "b"]).groupBy("image_id", "lo", "hi", "length").agg(F.sum((F.col("_a") - F.col("_b")) ** 2).alias("d"))
    return d.select("image_id", "lo", "hi", (F.col("length") * (prior + factor * F.exp(-F.col("d") / beta))).alias("cost"))


def connected_components(nodes: DataFrame, edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node, root): the smallest node of each component. Labels spread to neighbours and jump to
    their label's label, so rounds grow with the logarithm of a component's width."""
    keys = keys or ["image_id"]
    both = stored(edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b"), F.col("a"))).distinct(), "cc-edges")
    kept = Rounds("cc-labels")
    labels = kept.store(nodes.select(*keys, "node", F.col("node").alias("root")))
    while True:
        around = both.join(labels.select(*keys, F.col("node").alias("b"), F.col("root").alias("_r")), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("_r").alias("_r"))
        spread = labels.join(around, [*keys, "node"], "left").select(*keys, "node", F.least("root", F.coalesce("_r", "root")).alias("root"), F.col("root").alias("_old"))
        jump = spread.select(*keys, F.col("node").alias("root"), F.col("root").alias("_far"))
        moved = spread.join(jump, [*keys, "root"], "left").select(*keys, "node", F.least("root", F.coalesce("_far", "root")).alias("root"), "_old")
        nxt = kept.store(moved)
        labels = nxt.drop("_old")
        if nxt.where("root <> _old").isEmpty():
            return labels


def merge_modes(pixels: DataFrame, gap: float = 1.0, value: str = "v") -> DataFrame:
    """Flood of four-neighbours whose values differ by less than ``gap``: (image_id, x, y, seg)."""
    w = pixels.withColumn("node", F.col("y").cast("bigint") * 100_000 + F.col("x"))
    ids = shifted_pairs(w.withColumn("_p", F.struct("node", value)), "_p").where(F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")) < gap).select("image_id", F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return connected_components(w.select("image_id", "node"), ids).join(w.select("image_id", "node", "x", "y"), ["image_id", "node"]).select("image_id", "x", "y", F.col("root").alias("seg"))


# --- superpixels by grid k-means ---------------------------------------------------------------------


def sides(distance: int | tuple[int, int]) -> tuple[int, int]:
    return distance if isinstance(distance, tuple) else (distance, distance)


def grid_centres(pixels: DataFrame, distance: int | tuple[int, int]) -> DataFrame:
    """One centre per grid square (a side, or width and height): (image_id, cx, cy, mx, my, mv)."""
    w, h = sides(distance)
    at = pixels.withColumn("cx", F.floor(F.col("x") / w).cast("int")).withColumn("cy", F.floor(F.col("y") / h).cast("int"))
    return at.groupBy("image_id", "cx", "cy").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("v").alias("mv"))


def grid_assign(pixels: DataFrame, centres: DataFrame, distance: int | tuple[int, int], ratio: float, reach: int = 1) -> DataFrame:
    """(image_id, x, y, cx, cy): the nearest centre of the squares within ``reach``; the first wins ties. An
    equi join on squares: each pixel asks (2 reach + 1)^2 of them."""
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(-reach, reach + 1) for i in range(-reach, reach + 1))))
    w, h = sides(distance)
    asked = pixels.select("image_id", "x", "y", "v", step.alias("s")).withColumn("cx", F.floor(F.col("x") / w).cast("int") + F.col("s.i")).withColumn("cy", F.floor(F.col("y") / h).cast("int") + F.col("s.j")).drop("s")
    d = ratio * ratio * ((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2) + (F.col("v") - F.col("mv")) ** 2
    best = F.min(F.struct(F.round(d, 9).alias("d"), F.col("cy").alias("cy"), F.col("cx").alias("cx"))).alias("best")
    return asked.join(centres, ["image_id", "cx", "cy"]).groupBy("image_id", "x", "y").agg(best).select("image_id", "x", "y", "best.cx", "best.cy")


def grid_superpixels(pixels: DataFrame, distance: int, ratio: float, iterations: int = 3, reach: int = 1) -> DataFrame:
    """Grid k-means for a fixed number of iterations; centres that lose all pixels move to zero."""
    centres, kept = grid_centres(pixels, distance), Rounds("centres")
    for _ in range(iterations):
        got = grid_assign(pixels, centres, distance, ratio, reach)
        means = got.join(pixels, ["image_id", "x", "y"]).groupBy("image_id", "cx", "cy").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("v").alias("mv"))
        centres = kept.store(centres.select("image_id", "cx", "cy").join(means, ["image_id", "cx", "cy"], "left").na.fill(0.0))
    return grid_assign(pixels, centres, distance, ratio, reach)


# --- mean shift ----------------------------------------------------------------------------------------


#: Decimals of a position, so that the order of a sum decides nothing; candidates held at once while modes are sought.
DIGITS = 12
SHIFT_CELLS = 1 << 20


def shift_modes(xy: np.ndarray, values: np.ndarray, space: float, colour: float, limit: int = 100, still: float = 0.01) -> np.ndarray:
    """Mode of every pixel under a flat kernel in joint space; lightness over 80 counts four times. All pixels move
    together, each over the pixels of the square around where it is."""
    points = np.concatenate([xy / space, values / colour], axis=1)
    cell = xy.astype(np.int64)
    low, size = (cell.min(axis=0), np.ptp(cell, axis=0) + 1) if len(cell) else (np.zeros(2, np.int64), np.zeros(2, np.int64))
    where = np.full(tuple(size[::-1]) if len(cell) else (0, 0), -1, np.int64)
    where[cell[:, 1] - low[1], cell[:, 0] - low[0]] = np.arange(len(cell))
    reach = int(np.ceil(space))
    dy, dx = (g.ravel() for g in np.mgrid[-reach : reach + 2, -reach : reach + 2])
    heavy = np.where(points[:, 2] * colour > 80, 4.0, 1.0)
    at, moving = points.copy(), np.arange(len(points))
    step = max(1, SHIFT_CELLS // len(dx))
    for _ in range(limit):
        going = []
        for i in range(0, len(moving), step):
            who = moving[i : i + step]
            base = np.floor(at[who, :2] * space).astype(np.int64) - low
            x, y = base[:, :1] + dx, base[:, 1:] + dy
            inside = (x >= 0) & (y >= 0) & (x < size[0]) & (y < size[1])
            other = np.where(inside, where[np.where(inside, y, 0), np.where(inside, x, 0)], -1)
            near = other >= 0
            p = points[np.maximum(other, 0)]
            d = p - at[who][:, None]
            far = heavy[np.maximum(other, 0)] * d[..., 2] ** 2 + (d[..., 3:] ** 2).sum(axis=2)
            near &= ((d[..., :2] ** 2).sum(axis=2) < 1) & (far < 1)
            n = near.sum(axis=1)
            new = np.where(n[:, None] > 0, ((p * near[..., None]).sum(axis=1) / np.maximum(n, 1)[:, None]).round(DIGITS), at[who])
            moved = ((new - at[who]) ** 2).sum(axis=1)
            at[who] = new
            going.append(who[(n > 0) & (moved >= still)])
        moving = np.concatenate(going) if going else moving[:0]
        if not len(moving):
            break
    return at[:, 2:] * colour


def mean_shift(pixels: DataFrame, space: float, colour: float, bands: list[str] | None = None) -> DataFrame:
    """(image_id, x, y, modes of bands): images are independent, so each is one group."""
    bands = bands or ["v"]

    def one(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values(["y", "x"])
        modes = shift_modes(image[["x", "y"]].to_numpy(float), image[bands].to_numpy(float), space, colour)
        return image[["image_id", "x", "y"]].assign(**{b: modes[:, k] for k, b in enumerate(bands)})

    schema = "image_id string, x int, y int, " + ", ".join(f"{b} double" for b in bands)
    return pixels.select("image_id", "x", "y", *(F.col(b).cast("double") for b in bands)).groupBy("image_id").applyInPandas(one, schema)


def absorb_small(members: DataFrame, least: int, value: str = "v") -> DataFrame:
    """Segments under ``least`` pixels join the touching segment of the nearest mean until none is left."""
    kept = Rounds("regions")
    current = kept.store(members)
    while True:
        means = current.groupBy(*SEG).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
        small = means.where(F.col("n") < least)
        touching = adjacency(current)
        a = small.select("image_id", F.col("seg_id").alias("a"), F.col("m").alias("_m"))
        b = means.select("image_id", F.col("seg_id").alias("b"), F.col("m").alias("_o"), F.col("n").alias("_n"))
        best = touching.join(a, ["image_id", "a"]).join(b, ["image_id", "b"])
        # A small one may only join a larger one, or a smaller number: so no two swap places.
        best = best.where((F.col("_n") >= least) | (F.col("b") < F.col("a"))).groupBy("image_id", F.col("a").alias("seg_id")).agg(F.min(F.struct(F.abs(F.col("_m") - F.col("_o")).alias("d"), F.col("b").alias("b"))).alias("to"))
        if best.isEmpty():
            return current
        current = kept.store(current.join(best, SEG, "left").withColumn("seg_id", F.coalesce("to.b", "seg_id")).drop("to"))


def flood_modes(modes: DataFrame, bands: list[str], gap: float = 1.0) -> DataFrame:
    """Flood of eight-neighbours whose modes differ by less than ``gap`` in every band: (image_id, x, y, seg_id)."""
    node = lambda x, y: F.col(y).cast("bigint") * (1 << 24) + F.col(x)
    alike = F.lit(True)
    for b in bands:
        alike &= F.abs(F.col(b) - F.col(f"n_{b}")) < gap
    links = eight_neighbours(modes, *bands).where(alike).select("image_id", node("x", "y").alias("a"), node("nx", "ny").alias("b"))
    px = modes.select("image_id", "x", "y", node("x", "y").alias("node"))
    return connected_components(px.select("image_id", "node"), links).join(px, ["image_id", "node"]).select("image_id", "x", "y", F.col("root").alias("seg_id"))


def merge_alike(members: DataFrame, modes: DataFrame, bands: list[str], colour: float, least: float = 0.25) -> DataFrame:
    """Touching segments whose mean modes lie within a scaled squared distance of ``least`` become one, and those
    with what they touch in turn (one pass over the means as they were). Lightness over 80 counts four times."""
    means = members.join(modes, ["image_id", "x", "y"]).groupBy(*SEG).agg(*(F.avg(b).alias(b) for b in bands))
    a = means.select("image_id", F.col("seg_id").alias("a"), *(F.col(b).alias(f"a_{b}") for b in bands))
    b = means.select("image_id", F.col("seg_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in bands))
    pairs = adjacency(members).where("a < b").join(a, ["image_id", "a"]).join(b, ["image_id", "b"])
    square = lambda c: ((F.col(f"a_{c}") - F.col(f"b_{c}")) / colour) ** 2
    far = F.when(F.col(f"a_{bands[0]}") > 80, 4.0).otherwise(1.0) * square(bands[0])
    for c in bands[1:]:
        far = far + square(c)
    links = pairs.where(far < least).select("image_id", "a", "b")
    nodes = means.select("image_id", F.col("seg_id").alias("node"))
    roots = connected_components(nodes, links).select("image_id", F.col("node").alias("seg_id"), "root")
    return members.join(roots, SEG).select("image_id", "x", "y", F.col("root").alias("seg_id"))


def mean_shift_segments(pixels: DataFrame, space: float, colour: float, least: int, bands: list[str] | None = None) -> DataFrame:
    """(image_id, x, y, seg_id): modes, their flood, one merge of alike neighbours, and no segment under ``least`` pixels
    beside a larger one."""
    bands = bands or ["v"]
    modes = stored(mean_shift(pixels, space, colour, bands), "modes")
    merged = merge_alike(stored(flood_modes(modes, bands), "flooded"), modes, bands, colour)
    return absorb_small(merged.join(modes, ["image_id", "x", "y"]), least, bands[0]).select("image_id", "x", "y", "seg_id")
