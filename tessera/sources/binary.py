"""Binary layouts: range scans, segment lists, cost tensors, label and probability images."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.storage import stored

#: What a scan says of a point, and the points that go to Spark at once (of a scan of any length).
BANDS = ("x", "y", "z", "refl")
POINTS_AT_ONCE = 65_536


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(stem, content) of files, whatever store they are in."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(stem(F.col("path")).alias("stem"), "content")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _batches(parse, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]):
        for rb in batches:
            for key, blob in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                cols = parse(blob or b"")
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), *map(pa.array, cols)], names=names)

    return run


def scan(content: DataFrame) -> DataFrame:
    """(stem, content), or pieces of ``pack_scan`` -> (frame_id, idx, x, y, z, refl): little-endian float32 quadruples in
    scan order, all of them."""
    start = F.col("start") if "start" in content.columns else F.lit(0).cast("bigint")

    def run(batches):
        for rb in batches:
            for stem, start, blob in zip(*(rb.column(k).to_pylist() for k in range(3)), strict=True):
                blob = blob or b""
                points = np.frombuffer(blob[: len(blob) // 16 * 16], "<f4").reshape(-1, 4)
                for at in range(0, len(points), POINTS_AT_ONCE):
                    p = points[at : at + POINTS_AT_ONCE]
                    idx = np.arange(start + at, start + at + len(p), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(stem, pa.string()), len(p)), pa.array(idx), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(4))], names=["frame_id", "idx", *BANDS])

    return content.select("stem", start.alias("start"), "content").mapInArrow(run, "frame_id string, idx bigint, x float, y float, z float, refl float")


def pack_scan(points: DataFrame, key: str = "frame_id") -> DataFrame:
    """(stem, start, content): the scans' bytes in the order of ``idx``, in pieces that begin after ``start`` points; a
    scan's pieces in that order are its file.

    Points are dealt by ranges of key and ``idx``: a long scan is neither one task's nor one row's."""
    ordered = points.select(F.col(key).cast("string").alias("stem"), "idx", *(F.col(c).cast("float").alias(c) for c in BANDS)).repartitionByRange("stem", "idx").sortWithinPartitions("stem", "idx")

    def run(batches):
        for rb in batches:
            v = np.stack([rb.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in BANDS], axis=1)
            stems = pc.run_end_encode(rb.column("stem"))
            ends = stems.run_ends.to_numpy()
            n = np.diff(ends, prepend=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([stems.values, pa.array(n), pa.array([v[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)], pa.binary())], names=["stem", "n", "content"])

    numbered = ordered.select("stem", *BANDS).mapInArrow(run, "stem string, n bigint, content binary").withColumn("piece", F.monotonically_increasing_id())
    pieces = stored(numbered, "scan")  # ranges are sampled: once for both sides
    before = F.sum("n").over(W.partitionBy("stem").orderBy("piece").rowsBetween(W.unboundedPreceding, -1))
    return pieces.join(pieces.select("piece", F.coalesce(before, F.lit(0)).alias("start")), "piece").select("stem", "start", "content")


def segments(content: DataFrame) -> DataFrame:
    """(stem, content) -> (image_id, seg_id, pixel): a count, then a count and pixel numbers per segment."""

    def parse(blob: bytes):
        v = np.frombuffer(blob[: len(blob) // 4 * 4], "<i4")
        ids, pixels, at = [], [], 1
        for s in range(int(v[0]) if len(v) else 0):
            n = int(v[at])
            ids.append(np.full(n, s, np.int32))
            pixels.append(v[at + 1 : at + 1 + n])
            at += 1 + n
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        return [cat(ids), cat(pixels)]

    return content.mapInArrow(_batches(parse, ["image_id", "seg_id", "pixel"]), "image_id string, seg_id int, pixel int")


def pack_segments(members: list[list[int]]) -> bytes:
    return struct.pack("<i", len(members)) + b"".join(struct.pack(f"<{len(m) + 1}i", len(m), *m) for m in members)


def dense_costs(content: DataFrame) -> DataFrame:
    """(stem, content) -> (image_id, y, x, scores): width, height, classes, then float64 by row, column, class."""

    def parse(blob: bytes):
        w, h, c = struct.unpack("<3i", blob[:12]) if len(blob) >= 12 else (0, 0, 0)
        v = np.frombuffer(blob, "<f8", w * h * c, 12).reshape(w * h, c) if w else np.zeros((0, 1))
        k = np.arange(len(v))
        return [(k // w if w else k).astype(np.int32), (k % w if w else k).astype(np.int32), pa.array(list(v), pa.list_(pa.float64()))]

    return content.mapInArrow(_batches(parse, ["image_id", "y", "x", "scores"]), "image_id string, y int, x int, scores array<double>")


def segment_costs(content: DataFrame, classes: int) -> DataFrame:
    """(stem, content) -> (image_id, seg_id, scores): float64 by segment and class, without a header."""

    def parse(blob: bytes):
        v = np.frombuffer(blob[: len(blob) // (8 * classes) * 8 * classes], "<f8").reshape(-1, classes)
        return [np.arange(len(v), dtype=np.int32), pa.array(list(v), pa.list_(pa.float64()))]

    return content.mapInArrow(_batches(parse, ["image_id", "seg_id", "scores"]), "image_id string, seg_id int, scores array<double>")


# --- images --------------------------------------------------------------------------------------------


def read_png(blob: bytes) -> np.ndarray:
    """An 8-bit, non-interlaced PNG as (height, width, bands)."""
    if blob[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, b"", None
    while at + 8 <= len(blob):
        n, kind = struct.unpack(">I4s", blob[at : at + 8])
        data = blob[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body += data
    width, height, depth, colour, _, _, interlaced = head
    bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or bands is None or interlaced:
        raise ValueError("only plain 8-bit grey and colour images are read")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * bands)
    out = np.zeros((height, width * bands), np.uint8)
    before = np.zeros(width * bands, np.int64)
    for y in range(height):
        line, how = raw[y, 1:].astype(np.int64), raw[y, 0]
        if how == 2:
            line = (line + before) & 255
        elif how in (1, 3, 4):
            for i in range(len(line)):
                left = line[i - bands] if i >= bands else 0
                up, corner = before[i], before[i - bands] if i >= bands else 0
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + up) // 2
                else:
                    base = left + up - corner
                    guess = min((abs(base - left), 0, left), (abs(base - up), 1, up), (abs(base - corner), 2, corner))[2]
                line[i] = (line[i] + guess) & 255
        out[y], before = line, line
    return out.reshape(height, width, bands)


def write_png(image: np.ndarray) -> bytes:
    """An 8-bit grey or colour image as PNG."""
    image = np.atleast_3d(image).astype(np.uint8)
    h, w, bands = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    out = io.BytesIO()
    out.write(b"\x89PNG\r\n\x1a\n")
    out.write(chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)))
    out.write(chunk(b"IDAT", zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes())))
    out.write(chunk(b"IEND", b""))
    return out.getvalue()


def images(content: DataFrame) -> DataFrame:
    """(stem, content) of PNG files -> (image_id, y, x, bands)."""

    def parse(blob: bytes):
        img = read_png(blob)
        h, w, b = img.shape
        k = np.arange(h * w)
        return [(k // w).astype(np.int32), (k % w).astype(np.int32), pa.array(list(img.reshape(-1, b).astype(np.int32)), pa.list_(pa.int32()))]

    return content.mapInArrow(_batches(parse, ["image_id", "y", "x", "bands"]), "image_id string, y int, x int, bands array<int>")


def ground_truth(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, road, valid) of red-green-blue truth images: blue marks road, red the valid area."""
    return pixels.select("image_id", "y", "x", (F.col("bands")[2] > 0).cast("int").alias("road"), (F.col("bands")[0] > 0).cast("int").alias("valid"))


def pack_images(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(image_id, y, x, bands) -> (stem, content) as PNG, one image a group."""
    import pandas as pd

    def one(g: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((g["y"].max() + 1, g["x"].max() + 1, len(bands)), np.uint8)
        img[g["y"], g["x"]] = g[bands].to_numpy()
        return pd.DataFrame({"stem": [g["image_id"].iloc[0]], "content": [write_png(img)]})

    return pixels.select("image_id", "y", "x", *bands).groupBy("image_id").applyInPandas(one, "stem string, content binary")
