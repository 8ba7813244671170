"""Detections: suppression of boxes that overlap a stronger one, and average precision against a truth."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import spent, written
from . import matching as X
from . import ranking as R

#: The IoU limits over which precision is averaged.
LIMITS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
RECALLS = 101


# --- suppression ------------------------------------------------------------------------------------------------------


def suppress(boxes: DataFrame, image: str, box_id: str, threshold: float, conf_least: float = 0.25, cell: float | None = None) -> DataFrame:
    """boxes with a confidence of conf_least or more, without those that a stronger box that stays overlaps by an IoU above
    the threshold: what greedy non-maximum suppression keeps. Ties go to the smaller x1, then y1, then id; ids are unique
    in an image.

    Conflicts are a table of pairs, made in grid cells where `cell` is given. A round drops the weaker side of all pairs
    whose stronger side has no undecided stronger neighbour, and with it the pairs it is in; rounds end when no pair is left,
    after as many as the longest chain of boxes that each wait for a stronger one. Boxes without a conflict are in no round.
    """
    some = boxes.filter(F.col("conf") >= conf_least)
    strength = F.struct((-F.col("conf")).alias("c"), F.col("x1"), F.col("y1"), F.col(box_id).alias("id"))
    own = some.select(F.col(image).alias("k"), strength.alias("s"), *X.BOX)
    pair = X.with_box_iou(X.candidates(own, own, "k", "s", "s", cell)).filter((F.col("iou") > threshold) & (F.col("a") < F.col("b")))
    left = written(pair.select("k", F.col("a.id").alias("a"), F.col("b.id").alias("b")), "conflicts")
    gone: list[DataFrame] = []
    while not left.isEmpty():
        weak = left.select("k", F.col("b").alias("a")).distinct()
        kept = left.join(weak, ["k", "a"], "left_anti")
        lost = written(kept.select("k", "b").distinct(), "suppressed")
        rest = left.join(lost, ["k", "b"], "left_anti").join(lost.select("k", F.col("b").alias("a")), ["k", "a"], "left_anti").select("k", "a", "b")
        rest, before = written(rest, "conflicts"), left
        spent(before)
        gone, left = [*gone, lost], rest
    if not gone:
        return some
    lost = reduce(DataFrame.union, gone).select(F.col("k").alias(image), F.col("b").alias(box_id))
    return some.join(lost, [image, box_id], "left_anti").select(*boxes.columns)


# --- average precision ------------------------------------------------------------------------------------------------


def running(df: DataFrame, by: Sequence[str], part: str, order: Sequence[str | Column], value: Column, name: str, far: bool = False) -> DataFrame:
    """df with the sum of value over the rows of its group up to each row, or with far the largest value from it to the end.

    `part` numbers ranges of the order. Inside a range rows are added up by a window, and only one total a range is added up
    over the group, so that a group of any size is spread over its ranges.
    """
    agg = F.max if far else F.sum
    whole, here = Window.partitionBy(*by).orderBy(part), Window.partitionBy(*by, part).orderBy(*order)
    totals = df.groupBy(*by, part).agg(agg(value).alias("_t"))
    frame = whole.rowsBetween(1, Window.unboundedFollowing) if far else whole.rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(c).alias(f"_b{k}") for k, c in enumerate([*by, part])), agg("_t").over(frame).alias("_base"))
    inside = agg(value).over(here.rowsBetween(0, Window.unboundedFollowing) if far else here.rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumn("_here", inside).join(base, R.same([(c, f"_b{k}") for k, c in enumerate([*by, part])]), "left")
    both = F.greatest("_here", F.coalesce("_base", "_here")) if far else F.col("_here") + F.coalesce("_base", F.lit(0))
    return x.withColumn(name, both).drop("_here", "_base", *(f"_b{k}" for k in range(len(by) + 1)))


def matched(pairs: DataFrame, limits: Sequence[float]) -> DataFrame:
    """(class, image, a, conf, limit) of predictions that count as found at each IoU limit, from pairs (class, image, a, b,
    conf, iou) of predictions a and truths b of one class.

    Each prediction takes the truth with the largest IoU, ties to the smaller id, and each truth keeps the most confident of
    those that took it, ties to the smaller id. A prediction's truth is the same at all limits it reaches; who keeps a truth
    is not.
    """
    best = pairs.groupBy("class", "image", "a", "conf").agg(F.max(F.struct("iou", (-F.col("b")).alias("nb"))).alias("m"))
    each = best.select("class", "image", "a", "conf", (-F.col("m.nb")).alias("b"), F.col("m.iou").alias("iou"), F.explode(F.array(*map(F.lit, limits))).alias("limit")).filter("iou >= limit")
    kept = each.groupBy("class", "image", "b", "limit").agg(F.max(F.struct("conf", (-F.col("a")).alias("na"))).alias("m"))
    return kept.select("class", "image", (-F.col("m.na")).alias("a"), F.col("m.conf").alias("conf"), "limit")


def average_precision(predictions: DataFrame, truths: DataFrame, pairs: DataFrame, limits: Sequence[float] = LIMITS) -> DataFrame:
    """(class, limit, truths, predictions, found, ap): average precision of each class at each IoU limit.

    predictions: (class, image, id, conf); truths: (class, image, id); pairs: (class, image, a, b, iou), ids of predictions
    and truths that may match. Predictions stand by confidence, ties by image and id. At each found one, precision is the
    found so far over the predictions so far; the envelope is the largest precision there or further on; ap is its mean over
    RECALLS evenly spaced recalls, 0 beyond the last. A class with truths and no predictions has 0; one without truths has
    NULL, whatever was predicted.
    """
    part, _ = R.ranges(predictions.withColumn("_neg", -F.col("conf")), "_neg")
    order = [F.col("_neg"), F.col("image"), F.col("id")]
    ranked = running(predictions.withColumn("_neg", -F.col("conf")).withColumn("_part", part), ["class"], "_part", order, F.lit(1), "_at")
    found = matched(pairs.join(predictions.select("class", "image", F.col("id").alias("a"), "conf"), ["class", "image", "a"]), limits)
    hits = found.select("class", "image", F.col("a").alias("id"), "limit").join(ranked.select("class", "image", "id", "_neg", "_part", "_at"), ["class", "image", "id"])
    hits = running(hits, ["class", "limit"], "_part", order, F.lit(1), "_tp")
    hits = running(hits.withColumn("_precision", F.col("_tp") / F.col("_at")), ["class", "limit"], "_part", order, F.col("_precision"), "_envelope", far=True)
    n = truths.groupBy("class").agg(F.count("*").alias("truths"))
    last = RECALLS - 1
    reached = lambda k: F.floor(k * last / F.col("truths"))
    recalls = reached(F.col("_tp")) - reached(F.col("_tp") - 1) + F.when(F.col("_tp") == 1, 1).otherwise(0)
    area = hits.join(n, "class").groupBy("class", "limit").agg(F.count("*").alias("found"), (F.sum(F.col("_envelope") * recalls) / RECALLS).alias("ap"))
    seen = predictions.groupBy("class").agg(F.count("*").alias("predictions"))
    every = n.join(seen, "class", "full").withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = every.join(area, ["class", "limit"], "left")
    ap = F.when(zero("truths") > 0, F.coalesce("ap", F.lit(0.0)))
    return out.select("class", "limit", zero("truths").alias("truths"), zero("predictions").alias("predictions"), zero("found").alias("found"), ap.alias("ap"))


def summary(precision: DataFrame) -> DataFrame:
    """(class, ap50, ap50_95) of average_precision's rows, and the means over the classes with truths as class NULL."""
    per = precision.groupBy("class").agg(F.max(F.when(F.col("limit") == 0.5, F.col("ap"))).alias("ap50"), F.avg("ap").alias("ap50_95"))
    return per.union(per.agg(F.lit(None).alias("class"), F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95")))
