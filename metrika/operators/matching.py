"""One-to-one matching of two object sets: candidates by key and overlapping boxes, IoU, the rest after matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_iou, overlap

BOX = ("x1", "y1", "x2", "y2")


def candidates(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, cell: float | None = None) -> DataFrame:
    """(key, left id, right id, boxes) of pairs under one key whose boxes meet.

    With `cell` both sides are also dealt to the grid cells their boxes cover, so a key with very many objects is spread
    over many tasks and only neighbours are compared; a pair is reported by the one cell that holds the corner of the
    boxes' common part, hence once.
    """
    a = left.select(key, F.col(left_id).alias("a"), *(F.col(c).alias(f"a_{c}") for c in BOX))
    b = right.select(key, F.col(right_id).alias("b"), *(F.col(c).alias(f"b_{c}") for c in BOX))
    meet = overlap(tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX))
    if cell is None:
        return a.join(b, key).filter(meet)
    at = lambda v: F.floor(v / cell)
    for side in "ab":
        x = F.explode(F.sequence(at(F.col(f"{side}_x1")), at(F.col(f"{side}_x2")))).alias("gx")
        y = F.explode(F.sequence(at(F.col(f"{side}_y1")), at(F.col(f"{side}_y2")))).alias("gy")
        df = (a if side == "a" else b).filter(F.col(f"{side}_x1").isNotNull() & F.col(f"{side}_y1").isNotNull() & F.col(f"{side}_x2").isNotNull() & F.col(f"{side}_y2").isNotNull())
        df = df.select("*", x).select("*", y)
        a, b = (df, b) if side == "a" else (a, df)
    corner = (F.col("gx") == at(F.greatest("a_x1", "b_x1"))) & (F.col("gy") == at(F.greatest("a_y1", "b_y1")))
    return a.join(b, [key, "gx", "gy"]).filter(meet & corner).drop("gx", "gy")


def with_box_iou(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("iou", box_iou(tuple(F.col(f"a_{c}") for c in BOX), tuple(F.col(f"b_{c}") for c in BOX)))


def unmatched(objects: DataFrame, matches: DataFrame, object_id: str, side: str) -> DataFrame:
    return objects.join(matches.select(F.col(side).alias(object_id)), object_id, "left_anti")


def match_summary(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """One row of counts, mean and largest IoU (0 without matches)."""
    m = matches.agg(F.count("*").alias("num_matched"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.coalesce(F.max("iou"), F.lit(0.0)).alias("max_iou"))
    sizes = left.agg(F.count("*").alias("num_left")).join(right.agg(F.count("*").alias("num_right")))
    return m.join(sizes).withColumns({"num_unmatched_left": F.col("num_left") - F.col("num_matched"), "num_unmatched_right": F.col("num_right") - F.col("num_matched")})


def nearest_anchor(points: DataFrame, anchors: DataFrame, image: str) -> DataFrame:
    """points (image, x, y, ...) with `anchor`: the id of the nearest row of anchors (image, anchor, ax, ay) of the same image,
    ties to the smaller id, null where the image has none.

    The anchors of one image, the points of its centerline, are gathered into one array, which meets its points by the image.
    """
    own = anchors.groupBy(image).agg(F.sort_array(F.collect_list(F.struct("anchor", "ax", "ay"))).alias("_all"))
    d = F.transform("_all", lambda a: F.struct(((F.col("x") - a["ax"]) ** 2 + (F.col("y") - a["ay"]) ** 2).alias("d"), a["anchor"].alias("anchor")))
    return points.join(own, image, "left").withColumn("anchor", F.array_min(d)["anchor"]).drop("_all")
