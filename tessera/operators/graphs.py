"""Random-field terms and moves as edge and node tables, and the per-image solver.

Labels are numbered from 0; ``alpha`` is the label of a move; the free label of a segment is the
number of classes. In a move's network a node that ends on the sink side takes ``alpha``: ``t_source``
is the price of taking it, ``t_sink`` the price of keeping the old label.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import fields
from tessera.operators.flow import max_flow

CELL = ["image_id", "x", "y"]
TINY = 1e-12


def eight_neighbours(pixels: DataFrame, *values: str) -> DataFrame:
    """(image_id, x, y, nx, ny, dist, values and n_values): each neighbour pair once, to the east, south, south-east
    and south-west."""
    offsets = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))))).alias("o")
    asked = pixels.select(*CELL, *values, offsets).select(*CELL, *values, (F.col("x") + F.col("o.dx")).alias("nx"), (F.col("y") + F.col("o.dy")).alias("ny"), F.when((F.col("o.dx") != 0) & (F.col("o.dy") != 0), math.sqrt(2)).otherwise(1.0).alias("dist"))
    told = pixels.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), *(F.col(v).alias(f"n_{v}") for v in values))
    return asked.join(told, ["image_id", "nx", "ny"])


def contrast_weight(bands: list[str], weights: list[float], prior: float, factor: float, beta: float) -> Column:
    """prior + factor exp(-(weighted squared difference) / (beta dist))."""
    d = sum((F.lit(w) * (F.col(b) - F.col(f"n_{b}")) ** 2 for b, w in zip(bands[1:], weights[1:], strict=True)), F.lit(weights[0]) * (F.col(bands[0]) - F.col(f"n_{bands[0]}")) ** 2)
    return F.lit(prior) + F.lit(factor) * F.exp(-d / (F.lit(beta) * F.col("dist")))


def truncated(a: Column, b: Column, most: float) -> Column:
    return F.least(F.abs(a - b), F.lit(most)).cast("double")


def joint_cost(w: Column, o1: Column, o2: Column, m1: Column, m2: Column, most: float, disparity: float, cross: float) -> Column:
    """w (1 + cross disparity delta) where object labels differ, plus disparity delta of the sensor labels."""
    delta = truncated(m1, m2, most)
    return F.when(o1 != o2, w * (1 + cross * disparity * delta)).otherwise(0.0) + disparity * delta


def moving(state: DataFrame, alpha: int) -> DataFrame:
    """Sites that a move may change: those that do not have its label yet."""
    return state.where(F.col("label") != alpha)


def unary_links(state: DataFrame, unary: DataFrame, alpha: int, keys: list[str]) -> DataFrame:
    """(keys, t_source, t_sink) of a move from unary costs (keys, cls, cost)."""
    u = unary.select(*keys, "cls", "cost")
    new = u.where(F.col("cls") == alpha).select(*keys, F.col("cost").alias("t_source"))
    old = u.select(*keys, F.col("cls").alias("label"), F.col("cost").alias("t_sink"))
    return moving(state, alpha).join(new, keys).join(old, [*keys, "label"]).select(*keys, "t_source", "t_sink")


def potts_edges(edges: DataFrame, alpha: int) -> DataFrame:
    """(image_id, u, v, cap, rev, extra_u, extra_v) of a move: one end at alpha already adds its weight to the other's
    sink link; equal old labels give an edge (w, w); different ones a sink link on u and an edge (0, w)."""
    e = edges.where((F.col("w") > TINY) & ~((F.col("lu") == alpha) & (F.col("lv") == alpha)))
    u_in, v_in = F.col("lu") != alpha, F.col("lv") != alpha
    both, same = u_in & v_in, F.col("lu") == F.col("lv")
    w, zero = F.col("w"), F.lit(0.0)
    return e.select("image_id", "u", "v", F.when(both & same, w).otherwise(zero).alias("cap"), F.when(both, w).otherwise(zero).alias("rev"), F.when((both & ~same) | (u_in & ~v_in), w).otherwise(zero).alias("extra_u"), F.when(v_in & ~u_in, w).otherwise(zero).alias("extra_v"))


def potts_energy(edges: DataFrame) -> DataFrame:
    """(image_id, energy) of differing neighbours."""
    return edges.groupBy("image_id").agg(F.sum(F.when(F.col("lu") != F.col("lv"), F.col("w")).otherwise(0.0)).alias("energy"))


def unary_energy(state: DataFrame, unary: DataFrame, keys: list[str]) -> DataFrame:
    own = state.join(unary.select(*keys, F.col("cls").alias("label"), "cost"), [*keys, "label"])
    return own.groupBy("image_id").agg(F.sum("cost").alias("energy"))


def segment_sums(members: DataFrame, state: DataFrame, labels: DataFrame) -> DataFrame:
    """(image_id, seg_id, label, total, against): weight of a segment's pixels, and of those that disagree with the
    segment's label."""
    joined = members.join(state.select(*CELL, F.col("label").alias("_l")), CELL).join(labels.select("image_id", "seg_id", "label"), ["image_id", "seg_id"])
    return joined.groupBy("image_id", "seg_id", "label").agg(F.sum("weight").alias("total"), F.sum(F.when(F.col("_l") != F.col("label"), F.col("weight")).otherwise(0.0)).alias("against"))


def segment_energy(sums: DataFrame, costs: DataFrame, classes: int, truncation: float) -> DataFrame:
    """(image_id, seg_id, cost): robust higher-order cost. The free label costs M; any other its own cost plus
    (M - own) against / (W T)."""
    c = costs.select("image_id", "seg_id", F.col("cls").alias("label"), F.col("cost").alias("own"))
    free = costs.where(F.col("cls") == classes).select("image_id", "seg_id", F.col("cost").alias("most"))
    j = sums.join(c, ["image_id", "seg_id", "label"]).join(free, ["image_id", "seg_id"])
    return j.select("image_id", "seg_id", F.when(F.col("label") == classes, F.col("most")).otherwise(F.col("own") + F.col("against") * (F.col("most") - F.col("own")) / (F.col("total") * truncation)).alias("cost"))


def consistency_costs(sizes: DataFrame, classes: int, prior: float) -> DataFrame:
    """(image_id, seg_id, cls, cost): labels are free of charge, the free label costs prior x pixels."""
    cost = F.array(*[F.lit(0.0)] * classes, F.lit(prior) * F.col("n_pixels"))
    return sizes.select("image_id", "seg_id", F.posexplode(cost).alias("cls", "cost"))


def segment_potts(a: Column, b: Column, weight: Column, free: int) -> Column:
    """Cost of two touching segments: their weight if labels differ, half of it if just one is free."""
    one_free = (a == free) != (b == free)
    return F.when(a == b, F.lit(0.0)).when(one_free, weight / 2).otherwise(weight)


# --- images solved one by one ---------------------------------------------------------------------------


def _number(ids: np.ndarray, values: pd.Series) -> np.ndarray:
    """Places of values among sorted ids."""
    at = np.minimum(np.searchsorted(ids, values.to_numpy(np.int64)), max(len(ids) - 1, 0))
    if len(values) and (not len(ids) or (ids[at] != values.to_numpy()).any()):
        raise ValueError("an edge or a segment names a node that its image has not")
    return at


def label_images(
    unary: DataFrame,
    edges: DataFrame,
    segments: DataFrame | None = None,
    segment_costs: DataFrame | None = None,
    sweeps: int = 4,
    truncation: float = 0.5,
    touching: DataFrame | None = None,
    nested: bool = False,
    presence: Sequence[float] | None = None,
    truncated: float | None = None,
    size: int = 1,
) -> DataFrame:
    """(image_id, node, label, energy): every image is solved on its own, one group each (a frame of 376 x 1242 pixels
    takes half a minute).

    ``unary`` (image_id, node, costs array), ``edges`` (image_id, u, v, w). Optional layers of segments:
    ``segments`` (image_id, seg_id, node, weight), ``segment_costs`` (image_id, seg_id, costs array, the free label's
    last) and ``touching`` (image_id, a, b, w), each with a column ``layer`` if there is more than one; with ``nested``
    the nodes of a layer past the first are segments of the one before. ``presence``: price of each label that occurs.
    ``truncated``: edges cost w min(|a - b|, truncated), and moves take ``size`` labels at a time."""
    none = F.lit(None).cast("array<double>")
    level = lambda df: F.col("layer").cast("int") if "layer" in df.columns else F.lit(0)
    row = lambda df, kind, layer, a, b, w, costs=none: df.select("image_id", F.lit(kind).alias("kind"), layer.alias("layer"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), w.cast("double").alias("w"), costs.alias("costs"))
    terms = row(edges, 0, F.lit(0), F.col("u"), F.col("v"), F.col("w"))
    if segments is not None:
        terms = terms.union(row(segments, 1, level(segments), F.col("seg_id"), F.col("node"), F.col("weight")))
        terms = terms.union(row(segment_costs, 2, level(segment_costs), F.col("seg_id"), F.lit(0), F.lit(0.0), F.col("costs")))
    if touching is not None:
        terms = terms.union(row(touching, 3, level(touching), F.col("a"), F.col("b"), F.col("w")))

    def one(key, nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids = [nodes["node"].to_numpy(np.int64)]
        pairs = rows[rows["kind"] == 0]
        layers = []
        for k in sorted(rows.loc[rows["kind"] == 1, "layer"].unique()):
            part = rows[rows["layer"] == k]
            inside, costs, near = (part[part["kind"] == kind] for kind in (1, 2, 3))
            costs = costs[costs["a"].isin(inside["a"])].sort_values("a")
            own = costs["a"].to_numpy(np.int64)
            below = len(layers) - 1 if nested and layers else fields.NONE
            near = near[near["a"].isin(own) & near["b"].isin(own)]
            layers.append(fields.Layer(_number(own, inside["a"]), _number(ids[below + 1], inside["b"]), inside["w"].to_numpy(float), np.array(costs["costs"].tolist(), float), truncation, (_number(own, near["a"]), _number(own, near["b"]), near["w"].to_numpy(float)), below))
            ids.append(own)
        f = fields.Field(np.array(nodes["costs"].tolist(), float), _number(ids[0], pairs["a"]), _number(ids[0], pairs["b"]), pairs["w"].to_numpy(float), layers, None if presence is None else np.array(presence, float), truncated)
        state, trail = fields.solve(f, sweeps, size)
        return pd.DataFrame({"image_id": key[0], "node": ids[0], "label": state.labels.astype(np.int32), "energy": trail[-1]})

    return unary.select("image_id", "node", "costs").groupBy("image_id").cogroup(terms.toDF(*terms.columns).groupBy("image_id")).applyInPandas(one, "image_id string, node bigint, label int, energy double")


def label_jointly(objects: DataFrame, sensor: DataFrame, edges: DataFrame, most: float, disparity: float, cross: float, sweeps: int = 4) -> DataFrame:
    """(image_id, node, object, sensor, energy): both domains of every image, solved in turns. ``objects`` and ``sensor``
    (image_id, node, costs array), ``edges`` (image_id, u, v, w); see joint_cost."""

    def one(key, nodes: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids = nodes["node"].to_numpy(np.int64)
        j = fields.Joint(np.array(nodes["o"].tolist(), float), np.array(nodes["m"].tolist(), float), _number(ids, rows["u"]), _number(ids, rows["v"]), rows["w"].to_numpy(float), most, disparity, cross)
        o, m, trail = fields.solve_joint(j, sweeps)
        return pd.DataFrame({"image_id": key[0], "node": ids, "object": o.astype(np.int32), "sensor": m.astype(np.int32), "energy": trail[-1]})

    both = objects.select("image_id", "node", F.col("costs").alias("o")).join(sensor.select("image_id", "node", F.col("costs").alias("m")), ["image_id", "node"])
    links = edges.select("image_id", "u", "v", "w")
    return both.groupBy("image_id").cogroup(links.toDF(*links.columns).groupBy("image_id")).applyInPandas(one, "image_id string, node bigint, object int, sensor int, energy double")


def max_flows(terminals: DataFrame, edges: DataFrame) -> DataFrame:
    """(image_id, flow, node, on_sink) of networks given as tables: terminals (image_id, node, t_source, t_sink) and
    edges (image_id, u, v, cap, rev). Nodes that can still reach the sink are on its side."""

    def one(key, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids = nodes["node"].to_numpy(np.int64)
        flow, side = max_flow(nodes["t_source"], nodes["t_sink"], _number(ids, links["u"]), _number(ids, links["v"]), links["cap"], links["rev"])
        return pd.DataFrame({"image_id": key[0], "flow": flow, "node": ids, "on_sink": side})

    return terminals.groupBy("image_id").cogroup(edges.toDF(*edges.columns).groupBy("image_id")).applyInPandas(one, "image_id string, flow double, node bigint, on_sink boolean")
