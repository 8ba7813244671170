"""From a folder of images to measurements: decode, detect, cut out, measure, and everything in between as tables and files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..shared import written
from ..sources import named_files as W
from ..sources import pictures as I
from ..sources import sinks as K
from . import measure as P


def gray_images(pictures: DataFrame) -> DataFrame:
    """(path, pixels, height, width) with gray values as doubles, of pictures that could be decoded."""
    values = F.transform(I.gray(F.col("data"), F.col("channels")), lambda v: v.cast("double"))
    return pictures.filter("data is not null").select("path", values.alias("pixels"), "height", "width")


def cut_out_folder(
    spark: SparkSession, folder: str, out: str, predictor: Callable[[], P.ThresholdPredictor], scale: float = 1.2, least: int = 32, conf_least: float = 0.25, radius: float | None = None,
) -> DataFrame:
    """Detects objects in the images of a folder and writes the square around each to <out>/roi_images/<stem>_roi_<i>.png and
    their catalog, one JSON line each, to <out>/roi_catalog. Returns the catalog.

    Images of one name in several formats would give files of one name, which is an error. Cut-outs keep the image's own
    pixels (scale factor 1). Images that can't be decoded, or where nothing is found, have no rows.
    """
    images = I.pictures(spark, folder)
    found = written(P.detect(gray_images(images), predictor, conf_least, radius).filter("x1 is not null"), "detections")
    cuts = I.rois(images, found, scale, least)
    W.write_files(cuts.select("name", I.as_png(F.col("data"), F.col("size"), F.col("channels")).alias("content")), f"{out}/roi_images", mode="overwrite")
    g = G.roi(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), scale, least)
    corner = G.crop(g["cx"], g["cy"], g["size"], F.col("width"), F.col("height"))
    stem = F.concat(N.without_extension(N.basename(F.col("path"))), F.lit("_roi_"), F.col("detection_index"))
    catalog = found.select(
        stem.alias("name"), F.col("path").alias("source_image"), F.col("width").alias("original_width"), F.col("height").alias("original_height"), "detection_index", "class_id",
        F.round("conf", 6).alias("confidence"), F.array(*(F.round(c, 2) for c in ("x1", "y1", "x2", "y2"))).alias("bbox_original"), F.array(F.round(g["cx"], 2), F.round(g["cy"], 2)).alias("roi_center_original"),
        F.array(corner["left"], corner["top"]).alias("roi_top_left"), g["size"].alias("roi_size_original"), g["size"].alias("output_image_size"), F.lit(1.0).alias("scale_factor"),
        F.concat(F.lit(f"{out}/roi_images/"), stem, F.lit(".png")).alias("output_image_path"),
    )
    K.json_lines(catalog, f"{out}/roi_catalog")
    return spark.read.schema(catalog.schema).json(f"{out}/roi_catalog")


def measure_folder(
    spark: SparkSession, folder: str, out: str, predictor: Callable[[], P.ThresholdPredictor], limit_s: float = 60, um_strict: bool = False, **options,
) -> DataFrame:
    """cut_out_folder, then the measurements of its cut-outs: <out>/measurements (CSV of the ten columns), <out>/log (text) and
    <out>/summary (one JSON line of counts). Returns a measured row a cut-out."""
    catalog = cut_out_folder(spark, folder, out, predictor, **options)
    measured = written(P.measure(gray_images(I.pictures(spark, f"{out}/roi_images")), predictor, limit_s), "measured")
    K.measurement_csv(P.measurement_rows(measured, catalog, um_strict), f"{out}/measurements")
    K.text_files(P.log_lines(measured), f"{out}/log")
    K.json_lines(P.run_counts(measured).coalesce(1), f"{out}/summary")
    return measured
