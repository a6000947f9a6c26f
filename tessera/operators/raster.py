"""Point clouds and images: projection, rasters, neighbour searches, warps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as G


def project_points(points: DataFrame, matrix: Sequence[Sequence[float]], width: int, height: int) -> DataFrame:
    """Points in front of the sensor with the pixel (u, v) that they fall on; others are dropped."""
    u, v = G.project(matrix, F.col("x"), F.col("y"), F.col("z"))
    near = points.where((F.col("x") > G.NEAR) & (F.col("x") < G.FAR))
    return near.withColumn("u", u).withColumn("v", v).where(f"u >= 0 AND u < {width} AND v >= 0 AND v < {height}")


def last_per_cell(points: DataFrame, *cell: str, order: str = "idx", values: Sequence[str] = ("x", "y", "z", "refl")) -> DataFrame:
    """One row per cell: the point that comes last in scan order. Partial aggregation keeps one row
    per cell and task before the shuffle."""
    last = F.max_by(F.struct(order, *values), order).alias("_last")
    return points.groupBy(*cell).agg(last).select(*cell, "_last.*")


def occupancy(points: DataFrame, size: int = 800, cell: float = 0.2) -> DataFrame:
    """Distinct cells of the ground grid that hold a point."""
    gx, gy = G.grid_cell(F.col("x"), F.col("y"), size, cell)
    cells = points.select("frame", gx.alias("gx"), gy.alias("gy"))
    return cells.where(f"gx >= 0 AND gx < {size} AND gy >= 0 AND gy < {size}").distinct()


def neighbours(pixels: DataFrame, radius: float, tile: int, window: Column | None = None) -> DataFrame:
    """(frame, u, v, n_u, n_v, nx, ny, nz) of valid pixels and those near them in the image and in space.

    An image tile as large as the widest window bounds the search: every pixel goes to the 3 x 3
    tiles around its own, so the join is on equal tiles, and window and distance are residual
    predicates. ``window`` is the half width at a row: by default 5 pixels more per 100 rows.
    """
    half = window if window is not None else (F.floor(F.col("v") / 100).cast("int") + 1) * 5
    a = pixels.select("frame", "u", "v", "x", "y", "z", half.alias("half"), F.floor(F.col("u") / tile).cast("int").alias("tu"), F.floor(F.col("v") / tile).cast("int").alias("tv"))
    tiles = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col(c) / tile).cast("int") + k))
    b = pixels.select("frame", F.col("u").alias("n_u"), F.col("v").alias("n_v"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"))
    b = b.withColumn("tu", tiles("n_u")).withColumn("tv", tiles("n_v"))
    close = (F.abs(F.col("u") - F.col("n_u")) <= F.col("half")) & (F.abs(F.col("v") - F.col("n_v")) <= F.col("half"))
    d = (F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2 + (F.col("z") - F.col("nz")) ** 2
    return a.join(b, ["frame", "tu", "tv"]).where(close & (F.sqrt(d) <= radius)).withColumn("dist", F.sqrt(d)).drop("half", "tu", "tv")


def height_range(pairs: DataFrame) -> DataFrame:
    """(frame, u, v, n, max_hdiff) of the pixels with more than one neighbour."""
    return pairs.groupBy("frame", "u", "v").agg(F.count("*").alias("n"), (F.max("nz") - F.min("nz")).alias("max_hdiff")).where("n > 1")


def scatter(pairs: DataFrame) -> DataFrame:
    """Weighted scatter of each neighbourhood: its six distinct sums. Points nearer than the mean distance
    weigh 1, others exp(-(d/mean)^2); the centre is the plain mean.

    One aggregation: the image window bounds a neighbourhood, so its points are kept together and
    summed in place once their means are known; the range join is not run a second time."""
    near = F.collect_list(F.struct("dist", "nx", "ny", "nz")).alias("_near")
    g = pairs.groupBy("frame", "u", "v").agg(F.count("*").alias("n"), F.avg("dist").alias("_mu"), *(F.avg(f"n{c}").alias(f"_{c}") for c in "xyz"), near).where("n > 1")
    names = [a + b for i, a in enumerate("xyz") for b in "xyz"[i:]]

    def add(acc: Column, p: Column) -> Column:
        ratio = F.try_divide(p["dist"], F.col("_mu"))
        w = F.when((F.col("_mu") > 0) & (p["dist"] >= F.col("_mu")), F.exp(-(ratio * ratio))).otherwise(F.lit(1.0))
        return F.struct(*((acc[n] + w * (p[f"n{n[0]}"] - F.col(f"_{n[0]}")) * (p[f"n{n[1]}"] - F.col(f"_{n[1]}"))).alias(n) for n in names))

    sums = F.aggregate("_near", F.struct(*(F.lit(0.0).alias(n) for n in names)), add).alias("_s")
    return g.select("frame", "u", "v", "n", sums).select("frame", "u", "v", "n", *(F.col(f"_s.{n}").alias(f"s{n}") for n in names))


def shape_features(scatters: DataFrame) -> DataFrame:
    """(frame, u, v, curvature, height_var, weight): the largest eigenvalue of the scatter over its trace, by
    the closed form for symmetric 3x3 matrices, and the scatter along z."""
    c = F.col
    q = (c("sxx") + c("syy") + c("szz")) / 3
    off = c("sxy") ** 2 + c("sxz") ** 2 + c("syz") ** 2
    p = F.sqrt(((c("sxx") - q) ** 2 + (c("syy") - q) ** 2 + (c("szz") - q) ** 2 + 2 * off) / 6)
    a, b, d = c("sxx") - q, c("syy") - q, c("szz") - q
    det = a * (b * d - c("syz") ** 2) - c("sxy") * (c("sxy") * d - c("syz") * c("sxz")) + c("sxz") * (c("sxy") * c("syz") - b * c("sxz"))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det / 2, p * p * p), F.lit(1.0))))
    largest = q + 2 * p * F.cos(F.acos(r) / 3)
    return scatters.select("frame", "u", "v", F.coalesce(F.try_divide(largest, 3 * q), F.lit(0.0)).alias("curvature"), c("szz").alias("height_var"), c("n").alias("weight"))


def warp(pixels: DataFrame, bev: G.BirdsEye, matrix: Sequence[Sequence[float]], width: int, height: int, *values: str) -> DataFrame:
    """Bird's-eye view of an image: every cell takes the pixel that its centre maps to, 0 where none.

    Coordinates count from 1 and truncate. The table of cells is a range, not data; the images
    join it by pixel."""
    spark = pixels.sparkSession
    cells = spark.range(bev.rows * bev.cols).select((F.col("id") % bev.cols).cast("int").alias("col"), F.floor(F.col("id") / bev.cols).cast("int").alias("row"))
    x, z = bev.centre(F.col("col"), F.col("row"))
    u, v = G.plane(matrix, x, z)
    lut = cells.withColumns({"u": u, "v": v}).where(f"u >= 1 AND u <= {width} AND v >= 1 AND v <= {height}")
    lut = lut.select("col", "row", (F.col("u").cast("int") - 1).alias("x"), (F.col("v").cast("int") - 1).alias("y"))
    frames = pixels.select("image_id").distinct()
    hit = F.broadcast(lut).join(pixels, ["x", "y"]).select("image_id", "col", "row", *values)  # a cell table of fixed size
    every = frames.crossJoin(F.broadcast(cells))  # one row per image and cell: the result's own size
    return every.join(hit, ["image_id", "col", "row"], "left").na.fill(0, list(values))


def unwarp(bev_pixels: DataFrame, bev: G.BirdsEye, inverse: Sequence[Sequence[float]], width: int, height: int, *values: str) -> DataFrame:
    """Image pixels that a bird's-eye view covers, with its values: half-even rounding, counted from 1."""
    spark = bev_pixels.sparkSession
    cells = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    gx, gz = G.plane(inverse, F.col("x") + 1.0, F.col("y") + 1.0)
    col, row = bev.to_pixel(gx, gz)
    lut = cells.withColumns({"col": F.bround(col).cast("int"), "row": F.bround(row).cast("int")}).where(f"col >= 1 AND col <= {bev.cols} AND row >= 1 AND row <= {bev.rows}")
    lut = lut.select("x", "y", (F.col("col") - 1).alias("col"), (F.col("row") - 1).alias("row"))
    return F.broadcast(lut).join(bev_pixels, ["col", "row"]).select("image_id", "x", "y", *values)
