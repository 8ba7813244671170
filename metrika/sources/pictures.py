"""Images as rows of bytes: decoded by Spark's image source, cut out by slices of their rows, written as files."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from .files import IMAGES


def pictures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data): the images of a folder, decoded in the JVM. data is row by row from the top, one
    byte a channel, in the order blue, green, red, alpha. Files that are no images have NULL in all but the path.

    Samples of 16 bits are not read rightly by that source: filter by `deep` first.
    """
    raw = spark.read.format("image").option("dropInvalid", "false").load(folder)
    none = F.col("image.width") < 0
    part = lambda c: F.when(~none, F.col(f"image.{c}"))
    out = raw.select(F.col("image.origin").alias("path"), *(part(c).alias(n) for c, n in (("width", "width"), ("height", "height"), ("nChannels", "channels"), ("data", "data"))))
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return out.filter(kind.isin(*IMAGES))


def deep(files: DataFrame) -> DataFrame:
    """binaryFile rows with `deep`: whether a PNG has samples of 16 bits, by its header; NULL for other files."""
    png = F.substring("content", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    return files.withColumn("deep", F.when(png, F.hex(F.substring("content", 25, 1)) == "10"))


def gray(data: Column, channels: Column) -> Column:
    """Values 0 to 255 of the pixels as an array: the one channel, or 0.114 blue + 0.587 green + 0.299 red, rounded."""
    at = lambda i: F.conv(F.hex(F.substring(data, i.cast("int") + 1, 1)), 16, 10).cast("int")
    n = (F.octet_length(data) / channels).cast("int")
    of = lambda i: F.when(channels < 3, at(i * channels)).otherwise(F.floor(0.114 * at(i * channels) + 0.587 * at(i * channels + 1) + 0.299 * at(i * channels + 2) + 0.5).cast("int"))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), of))


def cut_out(cx: Column, cy: Column, size: Column, width: Column, height: Column, channels: Column, data: Column) -> Column:
    """The bytes of the square of `size` pixels a side around a centre, its corner truncated to whole pixels; outside of the
    image 0. Each row is one slice of the image's bytes."""
    c = G.crop(cx, cy, size, width, height)
    wide = F.greatest(F.lit(0), c["to_x"] - c["from_x"]) * channels
    void = lambda n: F.unhex(F.repeat(F.lit("00"), n.cast("int")))
    before, after = F.least(size, c["pad_left"]) * channels, F.least(size, c["pad_right"]) * channels

    def row(y: Column) -> Column:
        slice_ = F.substring(data, ((y * width + c["from_x"]) * channels + 1).cast("int"), wide.cast("int"))
        return F.when((y < 0) | (y >= height) | (wide == 0), void(size * channels)).otherwise(F.concat(void(before), slice_, void(after)))

    rows = F.transform(F.sequence(c["top"], c["top"] + size - 1), lambda y: row(y).cast("string"))
    return F.array_join(rows, "").cast("binary")


def rois(images: DataFrame, detections: DataFrame, scale: float = 1.2, least: int = 32) -> DataFrame:
    """(name, path, detection_index, size, channels, data) of the square around each detection (path, detection_index, x1, y1,
    x2, y2) of an image; not resampled. name is <stem>_roi_<index>.png."""
    r = G.roi(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), scale, least)
    x = detections.select("path", "detection_index", *(v.alias(f"_{k}") for k, v in r.items())).join(images.filter("data is not null"), "path")
    data = cut_out(F.col("_cx"), F.col("_cy"), F.col("_size"), F.col("width"), F.col("height"), F.col("channels"), F.col("data"))
    name = F.concat(N.without_extension(N.basename(F.col("path"))), F.lit("_roi_"), F.col("detection_index"), F.lit(".png"))
    return x.select(name.alias("name"), "path", "detection_index", F.col("_size").alias("size"), "channels", data.alias("data"))


def png(data: bytes, width: int, channels: int) -> bytes:
    """Pixels as rois() gives them as a PNG file, stored without compression."""
    kind = {1: 0, 3: 2, 4: 6}[channels]
    step = width * channels
    rows = []
    for k in range(0, len(data), step):
        row = bytearray(data[k : k + step])
        if channels >= 3:
            row[0::channels], row[2::channels] = row[2::channels], row[0::channels]
        rows.append(b"\0" + bytes(row))
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows), 0)) + chunk(b"IEND", b"")


def as_png(data: Column, width: Column, channels: Column) -> Column:
    @F.pandas_udf("binary")
    def encode(d: pd.Series, w: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([png(x, int(a), int(b)) for x, a, b in zip(d, w, c, strict=True)])

    return encode(data, width, channels)
