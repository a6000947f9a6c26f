"""Stencils over images: separable convolution, gradients, patterns, integral images."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import imaging as I


def dense(pixels: DataFrame, width: int, height: int, *values: str, fill: float = 0.0) -> DataFrame:
    """Images with every pixel of their grid; those that were missing hold ``fill``."""
    cells = pixels.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    grid = pixels.select("image_id").distinct().crossJoin(F.broadcast(cells))  # one row a pixel: the result's own size
    return grid.join(pixels, ["image_id", "x", "y"], "left").withColumns({v: F.coalesce(v, F.lit(fill)) for v in values or ("v",)})


def convolve(pixels: DataFrame, taps: Sequence[float], axis: str, size: int | None = None, value: str = "v", legacy_edge: bool = True, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One-dimensional convolution along ``axis`` (x or y) of ``size`` pixels with clamped borders.

    Taps are window frames of one coordinate over an image's rows: one sort, no join. Missing pixels
    count as zero. ``size``: by default up to the last pixel of each row. ``legacy_edge``: the last
    tap is left out where it would reach past the far border.
    """
    other = "y" if axis == "x" else "x"
    centre = len(taps) // 2
    w = W.partitionBy(*keys, other).orderBy(axis)
    row = W.partitionBy(*keys, other)
    most = F.lit(size - 1) if size else F.max(axis).over(row)
    at = pixels.select(*keys, "x", "y", value, most.alias("_most"), *(F.max(value).over(w.rangeBetween(k, k)).alias(f"_t{k + centre}") for k in range(-centre, centre + 1)))
    edge = lambda where: F.max(F.when(where, F.col(value))).over(row)
    at = at.withColumn("_low", edge(F.col(axis) == 0)).withColumn("_high", edge(F.col(axis) == F.col("_most")))
    out: Column = F.lit(0.0)
    for k, tap in enumerate(taps):
        off = k - centre
        v = F.when(F.col(axis) + off < 0, F.col("_low")).when(F.col(axis) + off > F.col("_most"), F.col("_high")).otherwise(F.col(f"_t{k}"))
        if legacy_edge and off == centre and centre:
            v = F.when(F.col(axis) + off > F.col("_most"), F.lit(0.0)).otherwise(v)
        out = out + F.lit(float(tap)) * F.coalesce(v, F.lit(0.0))
    return at.select(*keys, "x", "y", out.alias(value))


def convolve_window(pixels: DataFrame, taps: Sequence[float], axis: str, window: tuple[int, int, int, int], size: int | None = None, value: str = "v", legacy_edge: bool = True) -> DataFrame:
    """Convolution of the pixels in a rectangle (x, y, width, height) of each image, by what lies around it in the whole
    image; rows that it does not cross are not read."""
    x, y, w, h = window
    across, along = (("y", y, h), ("x", x, w)) if axis == "x" else (("x", x, w), ("y", y, h))
    inside = lambda side: F.col(side[0]).between(side[1], side[1] + side[2] - 1)
    return convolve(pixels.where(inside(across)), taps, axis, size, value, legacy_edge).where(inside(along))


def separable(pixels: DataFrame, taps_x: Sequence[float], taps_y: Sequence[float], size: tuple[int, int] | None = None, value: str = "v", legacy_edge: bool = True) -> DataFrame:
    """x first, then y."""
    w, h = size or (None, None)
    return convolve(convolve(pixels, taps_x, "x", w, value, legacy_edge), taps_y, "y", h, value, legacy_edge)


def laplacian(pixels: DataFrame, sigma: float, size: tuple[int, int] | None = None, value: str = "v", legacy_edge: bool = True) -> DataFrame:
    """Laplacian of Gaussian: the sum of both second derivatives."""
    g, c = I.gaussian(sigma), I.gaussian_curvature(sigma)
    parts = separable(pixels, c, g, size, value, legacy_edge).unionByName(separable(pixels, g, c, size, value, legacy_edge))
    return parts.groupBy("image_id", "x", "y").agg(F.sum(value).alias(value))


def texton_responses(pixels: DataFrame, scale: float = 1.0, size: tuple[int, int] | None = None, value: str = "v", legacy_edge: bool = True) -> DataFrame:
    """(image_id, x, y, name, response) of the one-band filters of the texton bank."""
    out = None
    for name, band, tx, ty in I.texton_bank(scale):
        if band:
            continue
        part = separable(pixels, tx, ty, size, value, legacy_edge).select("image_id", "x", "y", F.lit(name).alias("name"), F.col(value).alias("response"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("image_id", "x", "y", "name").agg(F.sum("response").alias("response"))


def gradient(pixels: DataFrame, value: str = "v", central: bool = False) -> DataFrame:
    """(dx, dy): forward differences, or central ones; borders clamp, so the last forward one is 0."""
    v = F.col(value)
    wx, wy = W.partitionBy("image_id", "y").orderBy("x"), W.partitionBy("image_id", "x").orderBy("y")
    diff = lambda w: F.coalesce(F.lead(v).over(w), v) - (F.coalesce(F.lag(v).over(w), v) if central else v)
    return pixels.select("image_id", "x", "y", value, diff(wx).alias("dx"), diff(wy).alias("dy"))


def gradient_bins(pixels: DataFrame, bins: int, full_circle: bool = False, value: str = "v") -> DataFrame:
    """(image_id, x, y, bin, mass): each gradient's size split between two angle bins."""
    g = gradient(pixels, value)
    low, a, high, b = I.angle_bins(F.col("dx"), F.col("dy"), bins, full_circle)
    pair = F.array(F.struct(low.alias("bin"), a.alias("mass")), F.struct(high.alias("bin"), b.alias("mass")))
    return g.select("image_id", "x", "y", F.explode(pair).alias("e")).select("image_id", "x", "y", "e.bin", "e.mass").groupBy("image_id", "x", "y", "bin").agg(F.max_by("mass", "mass").alias("mass"))


def lbp(pixels: DataFrame, width: int, height: int, value: str = "v") -> DataFrame:
    """Local binary pattern of the 3 x 3 window: bit k is set where neighbour k (row-major, borders
    clamped) is larger than the centre."""
    offsets = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    around = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(offsets)))).alias("o")
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), c))
    asked = pixels.select("image_id", "x", "y", F.col(value).alias("centre"), around).select("image_id", "x", "y", "centre", F.col("o.k").alias("k"), clamp(F.col("x") + F.col("o.dx"), width).alias("nx"), clamp(F.col("y") + F.col("o.dy"), height).alias("ny"))
    told = pixels.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col(value).alias("other"))
    bit = F.when(F.col("other") > F.col("centre"), F.expr("shiftleft(1, k)")).otherwise(0)
    return asked.join(told, ["image_id", "nx", "ny"]).groupBy("image_id", "x", "y").agg(F.sum(bit).cast("int").alias("code"))


def integral(pixels: DataFrame, value: str = "v", keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Summed-area table of dense images: sums over all pixels above and left, both included."""
    wx = W.partitionBy(*keys, "y").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    wy = W.partitionBy(*keys, "x").orderBy("y").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = pixels.select(*keys, "x", "y", F.sum(value).over(wx).alias("_row"))
    return rows.select(*keys, "x", "y", F.sum("_row").over(wy).alias("s"))


def rectangle_sums(table: DataFrame, pixels: DataFrame, shapes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, x, y, shape_id, total) of the rectangle (dx, dy, w, h) at each pixel, clamped to the image: four
    corners of the summed-area table. ``shapes`` are parameters of a model, a few hundred rows."""
    at = pixels.select("image_id", "x", "y").crossJoin(F.broadcast(shapes))  # fixed number of shapes per pixel
    clamp = lambda c, most: F.greatest(F.lit(-1), F.least(F.lit(most - 1), c))
    x0, y0 = F.col("x") + F.col("dx") - 1, F.col("y") + F.col("dy") - 1
    at = at.select("image_id", "x", "y", "shape_id", clamp(x0, width).alias("x0"), clamp(y0, height).alias("y0"), clamp(x0 + F.col("w"), width).alias("x1"), clamp(y0 + F.col("h"), height).alias("y1"))
    corner = lambda cx, cy, sign: F.struct(F.col(cx).alias("cx"), F.col(cy).alias("cy"), F.lit(sign).alias("sign"))
    four = at.select("image_id", "x", "y", "shape_id", F.explode(F.array(corner("x1", "y1", 1), corner("x0", "y1", -1), corner("x1", "y0", -1), corner("x0", "y0", 1))).alias("c")).select("image_id", "x", "y", "shape_id", "c.*")
    told = table.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "s")
    return four.join(told, ["image_id", "cx", "cy"], "left").groupBy("image_id", "x", "y", "shape_id").agg(F.sum(F.col("sign") * F.coalesce("s", F.lit(0.0))).alias("total"))


def sift(pixels: DataFrame, width: int, height: int, size: int, number: int, bins: int, step: int = 1, full_circle: bool = False, value: str = "v") -> DataFrame:
    """(image_id, x, y, features): gradient histograms of ``number`` x ``number`` cells of side ``size`` around every
    ``step``-th pixel of dense images, as one vector of length one.

    Each bin has a summed-area column; a cell is four corners of it, clamped to the image, without
    its own first row and column."""
    g = gradient(pixels, value)
    low, a, high, b = I.angle_bins(F.col("dx"), F.col("dy"), bins, full_circle)
    g = g.select("image_id", "x", "y", low.alias("_l"), a.alias("_a"), high.alias("_h"), b.alias("_b"))
    mass = lambda k: F.when(F.col("_h") == k, F.col("_b")).when(F.col("_l") == k, F.col("_a")).otherwise(0.0).alias(f"_m{k}")
    g = dense(g.select("image_id", "x", "y", *(mass(k) for k in range(bins))), width, height, *(f"_m{k}" for k in range(bins)))
    wx = W.partitionBy("image_id", "y").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    wy = W.partitionBy("image_id", "x").orderBy("y").rowsBetween(W.unboundedPreceding, W.currentRow)
    g = g.select("image_id", "x", "y", *(F.sum(f"_m{k}").over(wx).alias(f"_m{k}") for k in range(bins)))
    area = g.select("image_id", F.col("x").alias("cx"), F.col("y").alias("cy"), *(F.sum(f"_m{k}").over(wy).alias(f"_m{k}") for k in range(bins)))
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most - 1 - size), c))
    offset = size * number // 2
    cells = F.explode(F.array(*(F.struct(F.lit(l * number + m).alias("cell"), F.lit(m * size - offset).alias("i"), F.lit(l * size - offset).alias("j")) for l in range(number) for m in range(number)))).alias("c")
    at = pixels.where((F.col("x") % step == 0) & (F.col("y") % step == 0)).select("image_id", "x", "y", cells).select("image_id", "x", "y", "c.cell", clamp(F.col("x") + F.col("c.i"), width).alias("x0"), clamp(F.col("y") + F.col("c.j"), height).alias("y0"))
    corners = F.explode(F.array(*(F.struct((F.col("x0") + dx).alias("cx"), (F.col("y0") + dy).alias("cy"), F.lit(sign).alias("sign")) for dx, dy, sign in ((0, 0, 1), (size, size, 1), (0, size, -1), (size, 0, -1))))).alias("k")
    asked = at.select("image_id", "x", "y", "cell", corners).select("image_id", "x", "y", "cell", "k.*")
    sums = asked.join(area, ["image_id", "cx", "cy"]).groupBy("image_id", "x", "y", "cell").agg(F.array(*(F.sum(F.col("sign") * F.col(f"_m{k}")) for k in range(bins))).alias("h"))
    whole = sums.groupBy("image_id", "x", "y").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cell", "h"))), lambda c: c["h"])).alias("features"))
    return whole.select("image_id", "x", "y", I.l2_unit(F.col("features")).alias("features"))


def colour_sift(pixels: DataFrame, width: int, height: int, size: int, number: int, bins: int, step: int = 1, full_circle: bool = False) -> DataFrame:
    """SIFT of the three opponent channels of (r, g, b), one after the other."""
    out = None
    for k, channel in enumerate(I.opponent(F.col("r"), F.col("g"), F.col("b"))):
        part = sift(pixels.select("image_id", "x", "y", channel.alias("v")), width, height, size, number, bins, step, full_circle).withColumnRenamed("features", f"_f{k}")
        out = part if out is None else out.join(part, ["image_id", "x", "y"])
    return out.select("image_id", "x", "y", F.concat("_f0", "_f1", "_f2").alias("features"))
