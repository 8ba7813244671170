"""Boxes, regions of interest, polylines and masks as expressions over doubles and arrays of (x, y) structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(values: Column) -> Column:
    """A flat array x0, y0, x1, y1, ... as (x, y) structs."""
    n = F.floor(F.size(values) / 2).cast("int")
    at = lambda i: F.struct(F.get(values, 2 * i).cast("double").alias("x"), F.get(values, 2 * i + 1).cast("double").alias("y"))
    return F.when(n == 0, F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), at))


def roi(x1: Column, y1: Column, x2: Column, y2: Column, scale: float = 1.2, least: int = 32) -> dict[str, Column]:
    """Centre of a box, and the side of the square around it: the longer side times scale, truncated, `least` at least."""
    side = F.greatest(F.lit(least), (F.greatest(x2 - x1, y2 - y1) * scale).cast("int"))
    return {"cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "size": side}


def crop(cx: Column, cy: Column, size: Column, width: Column, height: Column) -> dict[str, Column]:
    """Bounds of a square cut-out, clipped to the image, and how much padding each side needs."""
    half = F.floor(size / 2).cast("int")
    left, top = cx.cast("int") - half, cy.cast("int") - half
    right, bottom = left + size, top + size
    zero = F.lit(0)
    return {
        "left": left, "top": top, "from_x": F.greatest(zero, left), "from_y": F.greatest(zero, top), "to_x": F.least(width, right), "to_y": F.least(height, bottom),
        "pad_left": F.greatest(zero, -left), "pad_top": F.greatest(zero, -top), "pad_right": F.greatest(zero, right - width), "pad_bottom": F.greatest(zero, bottom - height),
    }


def resample_kind(size: Column, out: Column) -> Column:
    return F.when(size > out, "area").otherwise("lanczos")


def scale_factor(size: Column, out: Column) -> Column:
    return F.round(out / size, 6)


def field_ratio(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Distance of a centre from the image's, in half widths."""
    return F.hypot(cx - width / 2, cy - height / 2) / (width / 2)


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (x1, y1, x2, y2) meet; touching edges count, a NULL side doesn't."""
    return F.coalesce((a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3]), F.lit(False))


def area(b: tuple[Column, ...]) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union; 0 where nothing is shared."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def to_fraction(px: Column, top_left: Column, size: Column, roi_px: Column, original: Column) -> Column:
    """A coordinate inside a rescaled cut-out as a fraction of the original image's side."""
    return (top_left + px * size / roi_px) / original


def to_pixel_centre(fraction: Column, side: Column) -> Column:
    return fraction * side - 0.5


def segment_lengths(line: Column) -> Column:
    n = F.size(line)
    step = lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(line, 1, n - 1), F.slice(line, 2, n - 1), step))


def arc_length(line: Column) -> Column:
    return F.aggregate(segment_lengths(line), F.lit(0.0), lambda a, x: a + x)


def body_length(line: Column, inside: Column) -> Column:
    """Arc length over the segments both ends of which are inside (array of booleans)."""
    n = F.size(inside)
    both = F.when(n < 2, F.array().cast("array<boolean>")).otherwise(F.zip_with(F.slice(inside, 1, n - 1), F.slice(inside, 2, n - 1), lambda a, b: a & b))
    kept = F.zip_with(segment_lengths(line), both, lambda x, k: F.when(k, x).otherwise(0.0))
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)


def mean_width(mask_area: Column, body: Column) -> Column:
    return F.try_divide(mask_area, body)


def arc_index(line: Column, target: Column, from_end: bool = False) -> Column:
    """First index, from the chosen end, by which the line has run `target`; the last one if it never does."""
    x = F.reverse(line) if from_end else line
    n = F.size(x)
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("hit"))

    def step(a, d):
        run, i = a["run"] + d, a["i"] + 1
        return F.struct(run.alias("run"), i.alias("i"), F.coalesce(a["hit"], F.when(run >= target, i)).alias("hit"))

    k = F.when(target <= 0, 0).otherwise(F.coalesce(F.aggregate(segment_lengths(x), start, step)["hit"], n - 1))
    return n - 1 - k if from_end else k


def resample(line: Column, k: int) -> Column:
    """k elements at evenly spaced indices, halves to even, ends included."""
    if k == 1:
        return F.slice(line, 1, 1)
    n = F.size(line)
    pick = lambda i: F.get(line, F.rint(i * (n - 1) / F.lit(float(k - 1))).cast("int"))
    return F.when(n == 0, line).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), pick))


def bounds(polygon: Column) -> dict[str, Column]:
    """Box of a polygon, its middle, width and height."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return {"x1": x1, "y1": y1, "x2": x2, "y2": y2, "cx": (x1 + x2) / 2, "cy": (y1 + y2) / 2, "w": x2 - x1, "h": y2 - y1}


def rotated(polygon: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    a = F.radians(degrees)
    turn = lambda p: F.struct(
        (cx + (p["x"] - cx) * F.cos(a) - (p["y"] - cy) * F.sin(a)).alias("x"), (cy + (p["x"] - cx) * F.sin(a) + (p["y"] - cy) * F.cos(a)).alias("y")
    )
    return F.transform(polygon, turn)


def shoelace(polygon: Column) -> Column:
    n = F.size(polygon)
    term = lambda i: F.get(polygon, i)["x"] * F.get(polygon, (i + 1) % n)["y"] - F.get(polygon, (i + 1) % n)["x"] * F.get(polygon, i)["y"]
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0.0), lambda a, x: a + x)) / 2)


def contains(polygon: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against a closed polygon."""
    n = F.size(polygon)

    def crosses(i):
        a, b = F.get(polygon, i), F.get(polygon, (i + 1) % n)
        return ((a["y"] > y) != (b["y"] > y)) & (x < F.coalesce(F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]), F.lit(0.0)) + a["x"])

    hits = F.size(F.filter(F.transform(F.sequence(F.lit(0), n - 1), crosses), lambda c: c))
    return F.when(n < 3, False).otherwise(hits % 2 == 1)


def meets_roi(polygon: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A vertex inside the square, or one of its corners inside the polygon."""
    vertex = F.exists(polygon, lambda p: (p["x"] >= x1) & (p["x"] <= x2) & (p["y"] >= y1) & (p["y"] <= y2))
    corner = contains(polygon, x1, y1) | contains(polygon, x2, y1) | contains(polygon, x1, y2) | contains(polygon, x2, y2)
    return vertex | corner


def normalized(segment: Column, width: Column, height: Column) -> Column:
    """Flat pixel coordinates over the image's sides, clipped to [0, 1]; NULL for fewer than three points."""
    side = lambda i: F.when(i % 2 == 0, width).otherwise(height)
    clip = lambda v, i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / side(i)))
    return F.when(F.size(segment) >= 6, F.transform(segment, clip))


def rle_pixels(counts: Column) -> Column:
    """Uncompressed run lengths, background first, as an array of 0 and 1."""
    return F.flatten(F.transform(counts, lambda c, i: F.array_repeat(i % 2, c.cast("int"))))


def without_repeats(line: Column, tolerance: float = 1e-6) -> Column:
    """Points that lie within tolerance of the last point kept, in x and y, are left out."""
    none = F.slice(line, 1, 0)
    last = lambda a: F.get(a, F.size(a) - 1)
    near = lambda a, p: (F.abs(last(a)["x"] - p["x"]) <= tolerance) & (F.abs(last(a)["y"] - p["y"]) <= tolerance)
    return F.aggregate(line, none, lambda a, p: F.when((F.size(a) > 0) & near(a, p), a).otherwise(F.concat(a, F.array(p))))


def stretched(pixels: Column) -> Column:
    """Values to 0..255 by their smallest and largest; all 0 if they are equal."""
    lo, hi = F.array_min(pixels), F.array_max(pixels)
    return F.transform(pixels, lambda v: F.coalesce(F.try_divide((v - lo) * 255.0, hi - lo), F.lit(0.0)))


def gap_cost(dx: Column, dy: Column, cos_a: Column, cos_b: Column, far: float, turn: float) -> Column:
    """d^2 plus what the turns at both ends add; infinite beyond a distance or an angle (degrees)."""
    d2, least = dx * dx + dy * dy, F.cos(F.radians(F.lit(turn)))
    bad = (F.sqrt(d2) > far) | (cos_a < least) | (cos_b < least)
    return F.when(bad, float("inf")).otherwise(d2 + (1 - cos_a) * d2 + (1 - cos_b) * d2)


def field_of_view(size: Column, um_per_px: float) -> Column:
    return size * um_per_px


# --- repair and clipping of polygons ----------------------------------------------------------------------------------

POINTS = "array<struct<x:double,y:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def crosses_itself(polygon: Column) -> Column:
    """Two edges that are not neighbours meet: cross, touch or lie on each other."""
    n = F.size(polygon)
    side = lambda o, a, b: F.signum(_cross(o, a, b))
    edge = lambda p, i: F.struct(i.alias("i"), p.alias("a"), F.get(polygon, (i + 1) % n).alias("b"))

    def near(a: Column, b: Column, c: Column, d: Column) -> Column:
        """The boxes around the edges meet."""
        apart = [(F.greatest(a[k], b[k]) < F.least(c[k], d[k])) | (F.greatest(c[k], d[k]) < F.least(a[k], b[k])) for k in "xy"]
        return ~(apart[0] | apart[1])

    def on(o: Column, a: Column, b: Column) -> Column:
        """b, in line with o and a, is between them."""
        return (b["x"] >= F.least(o["x"], a["x"])) & (b["x"] <= F.greatest(o["x"], a["x"])) & (b["y"] >= F.least(o["y"], a["y"])) & (b["y"] <= F.greatest(o["y"], a["y"]))

    def meet(e: Column, f: Column) -> Column:
        a, b, c, d = e["a"], e["b"], f["a"], f["b"]
        sides = F.struct(side(a, b, c).alias("p"), side(a, b, d).alias("q"), side(c, d, a).alias("r"), side(c, d, b).alias("s"))

        def found(t: Column) -> Column:
            p, q, r, s = t["p"], t["q"], t["r"], t["s"]
            touch = ((p == 0) & on(a, b, c)) | ((q == 0) & on(a, b, d)) | ((r == 0) & on(c, d, a)) | ((s == 0) & on(c, d, b))
            return ((p != q) & (r != s) & (p * q * r * s != 0)) | touch

        return near(a, b, c, d) & let(sides, found)

    later = lambda e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == n - 1))
    some = lambda edges: F.exists(edges, lambda e: F.exists(edges, lambda f: later(e, f) & meet(e, f)))
    return F.when(n < 4, False).otherwise(let(F.transform(polygon, edge), some))


def hull(points: Column) -> Column:
    """The convex hull, counter-clockwise from the leftmost point: the lower and the upper chain of the points in order, each
    a fold that first drops from its end what would turn the wrong way."""

    def chain(order: Column) -> Column:
        def add(done: Column, p: Column) -> Column:
            keeps = lambda m: (m < 2) | (_cross(F.get(done, m - 2), F.get(done, m - 1), p) > 0)
            m = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.size(done)), keeps)), F.lit(0))
            return F.when(F.size(done) == 0, F.array(p)).otherwise(F.concat(F.slice(done, 1, m), F.array(p)))

        return F.aggregate(order, F.array().cast(POINTS), add)

    ends = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    whole = lambda p: F.concat(let(chain(p), ends), let(chain(F.reverse(p)), ends))
    return let(F.array_sort(F.array_distinct(points)), lambda p: F.when(F.size(p) < 3, p).otherwise(whole(p)))


def signed_area(polygon: Column) -> Column:
    """Half the shoelace sum: above 0 counter-clockwise where y points up."""
    n = F.size(polygon)
    term = lambda p, i: p["x"] * F.get(polygon, (i + 1) % n)["y"] - F.get(polygon, (i + 1) % n)["x"] * p["y"]
    return F.when(n < 3, 0.0).otherwise(F.aggregate(F.transform(polygon, term), F.lit(0.0), lambda a, x: a + x) / 2)


def repaired(polygon: Column) -> Column:
    """A polygon without repeated points (the first after the last included) that goes counter-clockwise; one whose edges
    meet is replaced by its hull."""
    closed = lambda p: (F.size(p) > 1) & (F.get(p, 0) == F.get(p, F.size(p) - 1))
    once = F.filter(polygon, lambda p, i: (i == 0) | (F.get(polygon, i - 1) != p))
    open_ = let(once, lambda p: F.when(closed(p), F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    return let(open_, lambda p: F.when(crosses_itself(p), hull(p)).when(signed_area(p) < 0, F.reverse(p)).otherwise(p))


def clipped(polygon: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The part of a simple polygon inside a rectangle, cut along one side after the other. Separate parts of a polygon that
    isn't convex stay connected along the sides, by edges without area."""
    out = polygon
    for axis, limit, sign in (("x", x1, 1), ("x", x2, -1), ("y", y1, 1), ("y", y2, -1)):
        out = let(out, (lambda a, v, k: lambda p: _cut(p, a, v, k))(axis, limit, sign))
    return out


def _cut(polygon: Column, axis: str, limit: Column, sign: int) -> Column:
    def kept(p: Column, i: Column) -> Column:
        q = F.get(polygon, F.when(i == 0, F.size(polygon) - 1).otherwise(i - 1))
        a, b = sign * (q[axis] - limit), sign * (p[axis] - limit)
        t = F.try_divide(a, a - b)
        own, other = F.lit(1.0) * limit, (lambda c: q[c] + t * (p[c] - q[c]))
        on = _point(own, other("y")) if axis == "x" else _point(other("x"), own)
        entry = F.when((a >= 0) != (b >= 0), F.array(on)).otherwise(F.array().cast(POINTS))
        return F.concat(entry, F.when(b >= 0, F.array(_point(p["x"], p["y"]))).otherwise(F.array().cast(POINTS)))

    return F.flatten(F.transform(polygon, kept))
