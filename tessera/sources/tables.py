"""Text and table layouts: calibrations, matrices, file names, palettes, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Feature columns of the dense and the segment training matrices, in file order (they differ).
DENSE = ["x", "y", "z", "refl", "curvature", "height_var", "max_hdiff"]
SEGMENT = ["x", "y", "z", "refl", "curvature", "max_hdiff", "height_var"]


def parse_calibration(lines: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, name, values) of lines ``NAME: v v ...``; blank lines and comments are skipped, a line without exactly
    one colon is an error."""
    text = F.trim(value)
    live = lines.where((text != "") & ~text.startswith("#"))
    parts = F.split(F.col(value), ":")
    name = F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(0)))).otherwise(F.raise_error(F.concat(F.lit("calibration line without one colon: "), F.col(value))))
    values = F.transform(F.filter(F.split(F.trim(F.get(parts, F.lit(1))), r"\s+"), lambda x: x != ""), lambda x: x.cast("double"))
    return live.select(key, name.alias("name"), values.alias("values"))


def require(calibration: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, map of name to values); a frame that lacks a name is an error."""
    per = calibration.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "values"))).alias("calib"))
    missing = F.array_except(F.array(*map(F.lit, names)), F.map_keys("calib"))
    return per.withColumn("calib", F.when(F.size(missing) == 0, F.col("calib")).otherwise(F.raise_error(F.concat(F.lit("calibration lacks "), F.array_join(missing, ", ")))))


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("frame_id"), "value")
    return parse_calibration(lines, "frame_id")


def write_matrix(df: DataFrame, path: str, columns: list[str]) -> None:
    """Headerless tab-separated values; keys among ``columns`` keep rows joinable."""
    df.select(*columns).write.option("sep", "\t").csv(path)


def read_matrix(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_all(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """All files of the paths, stacked, with the file each row came from."""
    return read_matrix(spark, sorted(paths), schema).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def frame_name(name: Column) -> tuple[Column, Column, Column]:
    """(category, truth type or null, number) of ``um_000012`` or ``um_road_000012``."""
    parts = F.split(name, "_")
    return F.get(parts, F.lit(0)), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))), F.element_at(parts, -1)


def frame_key(name: Column) -> Column:
    """The key that a frame and its truth share: the name without the type."""
    category, _, number = frame_name(name)
    return F.concat_ws("_", category, number)


def join_frames(scan: DataFrame, *others: DataFrame, key: str = "frame") -> DataFrame:
    """What belongs to the same frame: a scan's pixels with its calibration, truth and so on; frames that any of them
    lacks are left out."""
    for other in others:
        scan = scan.join(other, key)
    return scan


def decode_labels(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Colours to labels by a palette (r, g, b, label); colours outside it are void (0)."""
    return pixels.join(palette, ["r", "g", "b"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def zip_scan_order(valid: DataFrame, answers: DataFrame, keys: list[str], order: list[str], position: str = "position") -> DataFrame:
    """Classifier answers that carry only their position, joined to pixels in scan order within each frame."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return valid.withColumn(position, at.cast("bigint")).join(answers, [*keys, position])


def missing_predictions(frames: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Frames without a prediction; a category is complete if it has none."""
    return frames.join(predictions.select(key).distinct(), key, "left_anti")
