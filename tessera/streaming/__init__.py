"""Frames as they arrive: every frame is independent, so batch operators run per micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import raster
from tessera.sources import binary


def scans(spark: SparkSession, path: str) -> DataFrame:
    """A stream of range scans from the binary files that appear under ``path``: (frame_id, idx, x, y, z, refl)."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return binary.scan(raw.select(binary.stem(raw["path"]).alias("stem"), "content"))


def project_stream(stream: DataFrame, matrix: Sequence[Sequence[float]], width: int, height: int, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each new frame's raster, the last point of every pixel, as Parquet.

    A frame is one file and so lies in one micro-batch; the raster needs no state between batches, and
    rewriting a batch after a failure overwrites the same folder."""

    def one(batch: DataFrame, number: int) -> None:
        frames = batch.withColumnRenamed("frame_id", "frame")
        pixels = raster.last_per_cell(raster.project_points(frames, matrix, width, height), "frame", "u", "v")
        pixels.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
