"""Intensity along an object: a centerline resampled by arc length, pixels of the outline by their nearest point on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import matching as X
from . import runs as Q
from . import tables as T


def resample_by_arc(vertices: DataFrame, per: str, order: str, n: int) -> DataFrame:
    """(per, k, x, y): n points, k from 0, at equal arc lengths along each line of vertices (per, order, x, y), ends included,
    linear between its vertices. A line without length is an error.

    A bracketing join without a join: vertices and wanted positions stand in one sequence by arc length, and the last vertex
    before and the first after each wanted one are windows over it.
    """
    line = Window.partitionBy(per).orderBy(order)
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(line), F.col("y") - F.lag("y").over(line)), F.lit(0.0))
    run = vertices.select(per, order, "x", "y", step.alias("_s")).withColumn("_at", F.sum("_s").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    length = run.groupBy(per).agg(F.max("_at").alias("_all"))
    length = length.withColumn("_all", F.when(F.col("_all") > 0, F.col("_all")).otherwise(F.raise_error(F.lit("a line without length can't be resampled")).cast("double")))
    k = F.col("k")
    at = F.when(k == n - 1, F.col("_all")).otherwise(F.col("_all") / max(n - 1, 1) * k) if n > 1 else F.lit(0.0)
    wanted = length.select(per, "_all", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("_at", at)
    both = run.select(per, "_at", F.lit(None).cast("int").alias("k"), F.struct("_at", "x", "y").alias("_v")).union(wanted.select(per, "_at", "k", F.lit(None).cast("struct<_at:double,x:double,y:double>")))
    by = Window.partitionBy(per).orderBy("_at", F.col("k").asc_nulls_first())
    a = F.last("_v", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("_v", True).over(by.rowsBetween(1, Window.unboundedFollowing))
    found = both.withColumns({"_a": a, "_b": b}).filter("k is not null")
    t = F.coalesce(F.try_divide(F.col("_at") - F.col("_a._at"), F.col("_b._at") - F.col("_a._at")), F.lit(0.0))
    between = lambda c: F.col(f"_a.{c}") + t * (F.coalesce(F.col(f"_b.{c}"), F.col(f"_a.{c}")) - F.col(f"_a.{c}"))
    return found.select(per, "k", between("x").alias("x"), between("y").alias("y"))


def same_shape(images: DataFrame, channels: DataFrame, per: str) -> DataFrame:
    """images (per, width, height), whose evaluation fails where the second channel has another shape or is missing."""
    c = channels.select(F.col(per).alias("_p"), F.col("width").alias("_w"), F.col("height").alias("_h"))
    ok = F.coalesce((F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")), F.lit(False))
    x = images.join(c, F.col(per) == F.col("_p"), "left").withColumn("_ok", F.when(ok, True).otherwise(F.raise_error(F.lit("the channels differ in shape")).cast("boolean")))
    return x.filter("_ok").select(*images.columns)


def intensity_profile(outlines: DataFrame, images: DataFrame, pixels: DataFrame, n: int, channel: DataFrame | None = None, channels: DataFrame | None = None) -> DataFrame:
    """(file, segment, mean, sd, n): mean and population SD of the pixels of each of n segments along the object.

    outlines: (file, section, part, pos, x, y) as sources.files.contour_text reads them, in fractions of the image; images:
    (file, width, height); pixels: (file, x, y, v). Of several contours the largest is taken, the one named first among
    equals. Its pixels, by the even-odd rule, go to the nearest of n points of the skeleton at equal arc lengths, ties to the
    first. `channel` (file, x, y, v) gives the values in place of pixels; its images are `channels`, of the same shapes.
    An empty segment has n 0 and no mean. A skeleton without length, or a file without contour or skeleton, is an error.
    """
    if channel is not None:
        images, pixels = same_shape(images, channels, "file"), channel
    scaled = outlines.join(images, "file").select("file", "section", "part", "pos", (F.col("x") * F.col("width")).alias("x"), (F.col("y") * F.col("height")).alias("y"))
    points = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    contours = scaled.filter("section = 'contour'").groupBy("file", "part").agg(points.alias("polygon"))
    largest = T.keep_first(contours.withColumn("_area", -G.shoelace(F.col("polygon"))), ["file"], ["_area", "part"])
    skeleton = scaled.filter("section = 'skeleton' and part = 0")
    there = images.select("file").join(largest.select(F.col("file").alias("_c")), F.col("file") == F.col("_c"), "left").join(skeleton.select(F.col("file").alias("_s")).distinct(), F.col("file") == F.col("_s"), "left")
    usable = F.when(F.col("_c").isNotNull() & F.col("_s").isNotNull(), True).otherwise(F.raise_error(F.lit("no contour or no skeleton")).cast("boolean"))
    checked = there.withColumn("_ok", usable).filter("_ok").select("file")
    anchors = resample_by_arc(skeleton, "file", "pos", n).select("file", F.col("k").alias("anchor"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    sized = largest.join(checked, "file").join(images, "file")
    mask = Q.from_polygons(sized, ["file"], width=F.col("width"), height=F.col("height"))
    lit = X.nearest_anchor(Q.inside(pixels, mask, ["file"]), anchors, "file").withColumnRenamed("anchor", "segment")
    got = lit.groupBy("file", "segment").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))
    grid = checked.select("file", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("segment"))
    return grid.join(got, ["file", "segment"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
