"""Masks as runs: (by..., y, x1, x2) for the lit pixels x1 to x2 of row y, ends included; runs of a row don't overlap.

A mask costs rows by its outline and not by its area. Everything is joins and aggregates over runs; a mask of any size, or
any number of masks in an image, is spread over tasks by its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import components

#: Columns of a cell, in pixels: runs of a row meet inside their cells only.
CELL = 256


def _int(x: Column) -> Column:
    return x.cast("int")


def from_pixels(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs of lit pixels (by..., y, x); repeated pixels count once."""
    w = Window.partitionBy(*by, "y").orderBy("x")
    run = pixels.withColumn("_run", F.col("x") - F.dense_rank().over(w))
    return run.groupBy(*by, "y", "_run").agg(F.min("x").alias("x1"), F.max("x").alias("x2")).drop("_run")


def pixels_of(runs: DataFrame) -> DataFrame:
    """The lit pixels, with x in place of x1 and x2."""
    return runs.withColumn("x", F.explode(F.sequence("x1", "x2"))).drop("x1", "x2")


def from_polygons(polygons: DataFrame, by: Sequence[str], polygon: str = "polygon", width: Column | None = None, height: Column | None = None) -> DataFrame:
    """Runs of the pixels (x, y) inside polygons by the even-odd rule, clipped to width and height where these are given.

    An edge crosses the rows from its lower end, included, to its upper end, not included. A row's crossings in order bound
    its runs. Fewer than three points have no inside.
    """
    p = F.col(polygon)
    edges = F.zip_with(p, F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides = {"_w": width, "_h": height}
    size = [c.alias(n) for n, c in sides.items() if c is not None]
    each = polygons.filter(F.size(p) >= 3).select(*by, *size, F.explode(edges).alias("e"))
    each = each.select(*by, *(n for n, c in sides.items() if c is not None), "e.a.x", "e.a.y", F.col("e.b.x").alias("u"), F.col("e.b.y").alias("v"))
    low, high = F.ceil(F.least("y", "v")), F.ceil(F.greatest("y", "v")) - 1
    if height is not None:
        low, high = F.greatest(low, F.lit(0).cast("long")), F.least(high, F.col("_h").cast("long") - 1)
    each = each.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    rows = each.withColumn("_row", F.explode(F.sequence("_low", "_high")))
    rows = rows.withColumn("_cross", (F.col("u") - F.col("x")) * (F.col("_row") - F.col("y")) / (F.col("v") - F.col("y")) + F.col("x"))
    keep = [F.first("_w").alias("_w")] if width is not None else []
    crossed = rows.groupBy(*by, F.col("_row").alias("_y")).agg(F.sort_array(F.collect_list("_cross")).alias("_c"), *keep)
    pairs = F.transform(F.sequence(F.lit(0), F.size("_c") - 2, F.lit(2)), lambda i: F.struct(F.get("_c", i).alias("from"), F.get("_c", i + 1).alias("to")))
    out = crossed.withColumn("_p", F.explode(pairs))
    x1, x2 = F.ceil("_p.from"), F.ceil("_p.to") - 1
    if width is not None:
        x1, x2 = F.greatest(x1, F.lit(0).cast("long")), F.least(x2, F.col("_w").cast("long") - 1)
    return out.select(*by, _int(F.col("_y")).alias("y"), _int(x1).alias("x1"), _int(x2).alias("x2")).filter("x1 <= x2")


def merged(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of runs that may overlap or touch, as the fewest runs."""
    w = Window.partitionBy(*by, "y").orderBy("x1", "x2")
    before = F.max("x2").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(before, F.col("x1") - 2) + 1 < F.col("x1"), 1).otherwise(0)
    x = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*by, "y", "_run").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2")).drop("_run")


def measured(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., area, x1, y1, x2, y2): pixels and box of each mask; masks without a pixel have no row."""
    n = (F.col("x2") - F.col("x1") + 1).cast("long")
    return runs.groupBy(*by).agg(F.sum(n).alias("area"), F.min("x1").alias("x1"), F.min("y").alias("y1"), F.max("x2").alias("x2"), F.max("y").alias("y2"))


def scaled(runs: DataFrame, source: Column, target: Column) -> DataFrame:
    """Runs of masks on a canvas of `source` pixels a side, on one of `target` by nearest neighbour: pixel x shows pixel
    floor(x source / target). Sides are integers."""
    first = lambda v: F.floor((v.cast("long") * target.cast("long") + source.cast("long") - 1) / source.cast("long"))
    y1, y2 = first(F.col("y")), first(F.col("y") + 1) - 1
    x = runs.withColumns({"_y1": _int(y1), "_y2": _int(y2), "_x1": _int(first(F.col("x1"))), "_x2": _int(first(F.col("x2") + 1) - 1)}).filter("_y1 <= _y2 and _x1 <= _x2")
    return x.withColumn("y", F.explode(F.sequence("_y1", "_y2"))).withColumns({"x1": F.col("_x1"), "x2": F.col("_x2")}).drop("_y1", "_y2", "_x1", "_x2")


def pasted(runs: DataFrame, left: Column, top: Column, width: Column, height: Column) -> DataFrame:
    """Runs moved right by left and down by top, clipped to a canvas."""
    x = runs.withColumns({"y": _int(F.col("y") + top), "x1": _int(F.greatest(F.lit(0), F.col("x1") + left)), "x2": _int(F.least(width - 1, F.col("x2") + left))})
    return x.filter((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x1") <= F.col("x2")))


def _celled(runs: DataFrame, cell: int) -> DataFrame:
    return runs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("x1") / cell), F.floor(F.col("x2") / cell))))


def shared_pixels(left: DataFrame, right: DataFrame, key: str, cell: int = CELL) -> DataFrame:
    """(key, a, b, both): pixels that masks (key, id, y, x1, x2) of two sides have in common; pairs without any have no row.

    Runs of a row meet by cells of `cell` columns, each pair of runs in the one where their common part begins.
    """
    a, b = (_celled(r.select(key, F.col("id").alias(n), "y", "x1", "x2"), cell).select(key, n, "y", "_cell", F.col("x1").alias(f"{n}1"), F.col("x2").alias(f"{n}2")) for r, n in ((left, "a"), (right, "b")))
    low, high = F.greatest("a1", "b1"), F.least("a2", "b2")
    met = a.join(b, [key, "y", "_cell"]).filter((low <= high) & (F.floor(low / cell) == F.col("_cell")))
    return met.groupBy(key, "a", "b").agg(F.sum((high - low + 1).cast("long")).alias("both"))


def mask_iou(pairs: DataFrame, left: DataFrame, right: DataFrame, key: str, same_shape: Column | None = None) -> DataFrame:
    """pairs (key, a, b) with `iou` of the masks of the two sides; 0 where nothing is lit, nothing is shared, or where
    same_shape, an expression over pairs, is false."""
    both = shared_pixels(left, right, key)
    size = lambda r, n: measured(r.select(key, "id", "y", "x1", "x2"), [key, "id"]).select(key, F.col("id").alias(n), F.col("area").alias(f"_{n}"))
    x = pairs.join(both, [key, "a", "b"], "left").join(size(left, "a"), [key, "a"], "left").join(size(right, "b"), [key, "b"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    iou = F.coalesce(F.try_divide(n("both").cast("double"), n("_a") + n("_b") - n("both")), F.lit(0.0))
    iou = iou if same_shape is None else F.when(same_shape, iou).otherwise(0.0)
    return x.withColumn("iou", iou).select(*pairs.columns, "iou")


def inside(points: DataFrame, runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The points (by..., x, y, ...) that a mask of the same key covers; x and y are whole numbers. Each point once, as runs
    of a row don't overlap."""
    r = runs.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("y").alias("_y"), "x1", "x2")
    on = F.col("y") == F.col("_y")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return points.join(r, on & F.col("x").between(F.col("x1"), F.col("x2")), "left_semi")


# --- connected parts --------------------------------------------------------------------------------------------------


def parts(runs: DataFrame, by: Sequence[str], diagonal: bool = True, cell: int = CELL) -> DataFrame:
    """runs with `part`: a name that runs of one mask share if they hang together, by sides and, if diagonal, by corners.

    Runs of neighbouring rows that meet are the edges of a graph, found in cells of columns; its components are rounds of
    joins over all masks at once, so a mask of any size is spread over tasks. Runs of a row must not touch (merged()).
    """
    by, reach = list(by), 1 if diagonal else 0
    node = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in by), "y", "x1")
    x = runs.withColumn("_node", node)
    side = lambda n, grow: _celled(x.select(*by, "y", (F.col("x1") - grow).alias("x1"), (F.col("x2") + grow).alias("x2"), "_node"), cell).select(
        *(F.col(c).alias(f"_{n}by{k}") for k, c in enumerate(by)), F.col("y").alias(f"_{n}y"), F.col("_cell").alias(f"_{n}c"), F.col("x1").alias(f"_{n}1"), F.col("x2").alias(f"_{n}2"), F.col("_node").alias(n)
    )
    a, b = side("a", reach), side("b", 0)
    on = (F.col("_ay") + 1 == F.col("_by")) & (F.col("_ac") == F.col("_bc"))
    for k in range(len(by)):
        on = on & F.col(f"_aby{k}").eqNullSafe(F.col(f"_bby{k}"))
    edges = a.join(b, on).filter((F.col("_a1") <= F.col("_b2")) & (F.col("_b1") <= F.col("_a2"))).select("a", "b")
    label = components(edges)
    out = x.join(label, F.col("_node") == F.col("node"), "left").withColumn("part", F.coalesce("component", "_node"))
    return out.drop("_node", "node", "component")


def part_table(runs: DataFrame, by: Sequence[str], diagonal: bool = True) -> DataFrame:
    """(by..., part, area, row, col): pixels and middle of every connected part."""
    n = (F.col("x2") - F.col("x1") + 1).cast("long")
    got = parts(runs, by, diagonal).groupBy(*by, "part").agg(F.sum(n).alias("area"), F.sum(n * F.col("y")).alias("_y"), F.sum(n * (F.col("x1") + F.col("x2"))).alias("_x"))
    return got.select(*by, "part", "area", (F.col("_y") / F.col("area")).alias("row"), (F.col("_x") / (2 * F.col("area"))).alias("col"))


def complement(runs: DataFrame, masks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs of the pixels that are not lit, of masks (by..., width, height); runs must be merged()."""
    own = masks.select(*by, "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    ends = own.select(*by, "y", F.explode(F.array(F.lit(-1), F.col("width").cast("int"))).alias("x1")).withColumn("x2", F.col("x1") + 0)
    all_runs = runs.select(*by, "y", "x1", "x2").union(ends)
    w = Window.partitionBy(*by, "y").orderBy("x1")
    gap = all_runs.withColumns({"_from": F.lag("x2").over(w) + 1, "_to": F.col("x1") - 1})
    return gap.filter("_from <= _to").select(*by, "y", F.col("_from").alias("x1"), F.col("_to").alias("x2"))


def filled(runs: DataFrame, masks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs of masks (by..., width, height) with their holes: parts of the background, by sides alone, that don't reach the
    edge of the image."""
    dark = parts(complement(runs, masks, by), by, diagonal=False)
    size = masks.select(*(F.col(c).alias(f"_m{k}") for k, c in enumerate(by)), "width", "height")
    on = F.lit(True)
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_m{k}"))
    edge = (F.col("y") == 0) | (F.col("x1") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x2") == F.col("width") - 1)
    sized = dark.join(size, on).select(*by, "part", edge.alias("_edge"))
    holes = sized.groupBy(*by, "part").agg(F.max("_edge").alias("_open")).filter("not _open").select("part")
    return merged(runs.select(*by, "y", "x1", "x2").union(dark.join(holes, "part", "left_semi").select(*by, "y", "x1", "x2")), by)
