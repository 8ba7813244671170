"""Queries of the geometry, matching, curation, file and image operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import measures as M
from ..functions import names as N
from ..operators import curation as C
from ..operators import assignment as H
from ..operators import masks as Z
from ..operators import matching as X
from ..operators import tables as T
from ..shared import spread
from ..sources import files as S
from ..sources import sinks as K
from . import measure
from .registry import query, table

# --- boxes from embeddings: x = e[0], y = e[1], w = |e[2]|, h = |e[3]|, in tenths of a unit -------------------------------

BOXES = """b AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS y1, CAST(embedding[1] AS DOUBLE) + abs(CAST(embedding[3] AS DOUBLE)) AS x2,
  CAST(embedding[2] AS DOUBLE) + abs(CAST(embedding[4] AS DOUBLE)) AS y2 FROM embeddings)"""
PAIRS = BOXES + """, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM b a JOIN b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1
  WHERE a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2)"""


def e(i: int):
    return F.get("embedding", i).cast("double")


def boxes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", e(0).alias("x1"), e(1).alias("y1"), (e(0) + F.abs(e(2))).alias("x2"), (e(1) + F.abs(e(3))).alias("y2"))


def sides(s, d) -> tuple[DataFrame, DataFrame]:
    b = boxes(s, d)
    return b.filter("vec_id % 2 = 0"), b.filter("vec_id % 2 = 1")


def r(c, n: int = 6):
    return F.round(c, n)


@query(f"WITH {PAIRS} SELECT label, a, b FROM p")
def j11_f11_candidates(s, d):
    return X.candidates(*sides(s, d), "label", "vec_id", "vec_id").select("label", "a", "b")


@query(f"WITH {PAIRS} SELECT label, a, b FROM p")
def j11_candidates_by_cell(s, d):
    return X.candidates(*sides(s, d), "label", "vec_id", "vec_id", cell=0.25).select("label", "a", "b")


@query(f"WITH {PAIRS} SELECT a, b, round(coalesce(i / nullif(s + t - i, 0), 0.0), 8) AS iou FROM p")
def j13_box_iou(s, d):
    return X.with_box_iou(X.candidates(*sides(s, d), "label", "vec_id", "vec_id")).select("a", "b", r("iou", 8).alias("iou"))


def assigned(left: DataFrame, right: DataFrame) -> DataFrame:
    """The one-to-one matches; all pairs of a label are looked through in blocks, so that the few labels keep all cores."""
    return H.assign_boxes(left, right, "label", "vec_id", "vec_id", 0.3)


@query()
def j14_assignment(s, d):
    return assigned(*sides(s, d))


@query()
def a28_a29_match_summary(s, d):
    left, right = sides(s, d)
    m = assigned(left, right)
    return X.match_summary(m, left, right)


@query()
def u4_k11_unmatched_objects(s, d):
    left, right = sides(s, d)
    m = assigned(left, right)
    return X.unmatched(left, m, "vec_id", "a").select("vec_id").union(X.unmatched(right, m, "vec_id", "b").select("vec_id"))


@query(f"WITH {PAIRS} SELECT a, b, round(coalesce(i / nullif(s + t - i, 0), 0.0), 8) AS iou FROM p WHERE i / nullif(s + t - i, 0) >= 0.3 ORDER BY iou DESC")
def w10_sorted_matches(s, d):
    return X.with_box_iou(X.candidates(*sides(s, d), "label", "vec_id", "vec_id")).filter("iou >= 0.3").select("a", "b", r("iou", 8).alias("iou")).orderBy(F.desc("iou"))


@query(f"WITH {BOXES} SELECT vec_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, CAST(greatest(32, trunc(greatest(x2 - x1, y2 - y1) * 100 * 1.3)) AS INTEGER) AS size FROM b")
def p2_roi_geometry(s, d):
    b = boxes(s, d)
    g = G.roi(*(F.col(c) for c in X.BOX), 130.0)
    return b.select("vec_id", g["cx"].alias("cx"), g["cy"].alias("cy"), F.greatest(F.lit(32), (F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * 100 * 1.3).cast("int")).alias("size"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 640 AS cx, o_custkey % 480 AS cy, 32 + o_orderkey % 97 AS size FROM orders), g AS (SELECT *, cx - size // 2 AS l, cy - size // 2 AS t FROM o)
SELECT o_orderkey, l AS "left", t AS top, greatest(0, l) AS from_x, greatest(0, t) AS from_y, least(640, l + size) AS to_x, least(480, t + size) AS to_y, greatest(0, -l) AS pad_left, greatest(0, -t) AS pad_top,
greatest(0, l + size - 640) AS pad_right, greatest(0, t + size - 480) AS pad_bottom, round(512 / size, 6) AS scale_factor, CASE WHEN size > 64 THEN 'area' ELSE 'lanczos' END AS kind FROM g""")
def p3_p4_crop_bounds(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 640).alias("cx"), (F.col("o_custkey") % 480).alias("cy"), (32 + F.col("o_orderkey") % 97).alias("size"))
    c = G.crop(F.col("cx"), F.col("cy"), F.col("size"), F.lit(640), F.lit(480))
    return o.select("o_orderkey", *(v.cast("long").alias(k) for k, v in c.items()), G.scale_factor(F.col("size"), F.lit(512)).alias("scale_factor"), G.resample_kind(F.col("size"), F.lit(64)).alias("kind"))


@query(f"WITH {BOXES} SELECT vec_id FROM b WHERE sqrt(((x1 + x2) / 2 - 0.5) ** 2 + ((y1 + y2) / 2 - 0.5) ** 2) / 0.5 <= 0.94")
def f2_circular_field(s, d):
    b = boxes(s, d)
    one = F.lit(1.0)
    return b.filter(G.field_ratio((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, one, one) <= 0.94).select("vec_id")


@query(f"WITH {BOXES} SELECT label, vec_id, round(sqrt(((x1 + x2) / 2 - 0.5) ** 2 + ((y1 + y2) / 2 - 0.5) ** 2), 8) AS dist FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(sqrt(((x1 + x2) / 2 - 0.5) ** 2 + ((y1 + y2) / 2 - 0.5) ** 2), 8), vec_id) = 1")
def j18_w12_nearest_to_centre(s, d):
    b = boxes(s, d).withColumn("dist", r(F.hypot((F.col("x1") + F.col("x2")) / 2 - 0.5, (F.col("y1") + F.col("y2")) / 2 - 0.5), 8))
    return T.keep_first(b, ["label"], ["dist", "vec_id"]).select("label", "vec_id", "dist")


@query(f"WITH {BOXES} SELECT vec_id, round((10 + x1 * 64 / 512) / 640, 8) AS fx, round((x1 * 640) - 0.5, 6) AS px, round((x2 - x1) * (y2 - y1), 8) AS area, round(64 * 3.2937 / 8, 4) AS fov FROM b")
def p9_p21_p41_p42_coordinates(s, d):
    b = boxes(s, d)
    box = tuple(F.col(c) for c in X.BOX)
    fov = G.field_of_view(F.lit(64), M.UM_PER_PX / 8)
    return b.select("vec_id", r(G.to_fraction(F.col("x1"), F.lit(10), F.lit(64), F.lit(512), F.lit(640)), 8).alias("fx"), r(G.to_pixel_centre(F.col("x1"), F.lit(640))).alias("px"), r(G.area(box), 8).alias("area"), r(fov, 4).alias("fov"))


# --- polylines: 64 floats as 32 points ------------------------------------------------------------------------------------

POINTS = "pt AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(32) t(i))"
SEGMENTS = POINTS + ", sg AS (SELECT vec_id, i, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM pt WINDOW w AS (PARTITION BY vec_id ORDER BY i)), cu AS (SELECT vec_id, i, d, sum(d) OVER (PARTITION BY vec_id ORDER BY i) AS run FROM sg)"


def lines(s, d) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", "label", G.points(F.col("embedding")).alias("line"))


@query(f"WITH {SEGMENTS} SELECT vec_id, round(sum(d), 5) AS length FROM cu GROUP BY vec_id")
def p11_w1_arc_length(s, d):
    return lines(s, d).select("vec_id", r(G.arc_length(F.col("line")), 5).alias("length"))


@query(f"""WITH {SEGMENTS}, f AS (SELECT vec_id, i, x > 0 AS ins FROM pt), b AS (SELECT vec_id, i, ins AND lag(ins) OVER (PARTITION BY vec_id ORDER BY i) AS both_in FROM f)
SELECT vec_id, round(sum(CASE WHEN both_in THEN d ELSE 0 END), 5) AS body, round(100.0 / nullif(sum(CASE WHEN both_in THEN d ELSE 0 END), 0), 3) AS width FROM cu JOIN b USING (vec_id, i) GROUP BY vec_id""")
def p11_body_and_width(s, d):
    inside = F.transform("line", lambda p: p["x"] > 0)
    body = G.body_length(F.col("line"), inside)
    return lines(s, d).select("vec_id", r(body, 5).alias("body"), r(G.mean_width(F.lit(100.0), body), 3).alias("width"))


@query(f"WITH {SEGMENTS} SELECT vec_id, i, round(coalesce(run, 0.0), 5) AS run FROM cu")
def w2_cumulative_arc(s, d):
    p = lines(s, d).select("vec_id", F.posexplode("line").alias("i", "p")).select("vec_id", "i", "p.x", "p.y")
    w = Window.partitionBy("vec_id").orderBy("i")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    run = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("step", step).select("vec_id", F.col("i").cast("long").alias("i"), r(F.coalesce(run, F.lit(0.0)), 5).alias("run"))


@query(f"WITH {SEGMENTS} SELECT vec_id, CAST(coalesce(min(i) FILTER (run >= 1.0), 31) AS INTEGER) AS at FROM cu GROUP BY vec_id")
def p15_arc_index(s, d):
    return lines(s, d).select("vec_id", G.arc_index(F.col("line"), F.lit(1.0)).alias("at"))


@query("SELECT vec_id, k, round(CAST(embedding[2 * CAST(round_even(k * 31 / 9.0, 0) AS INTEGER) + 1] AS DOUBLE), 6) AS x FROM embeddings, range(10) t(k)")
def p13_uniform_resample(s, d):
    x = lines(s, d).select("vec_id", F.posexplode(G.resample(F.col("line"), 10)).alias("k", "p"))
    return x.select("vec_id", F.col("k").cast("long").alias("k"), r("p.x").alias("x"))


@query(f"WITH {POINTS} SELECT vec_id, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, round((min(x) + max(x)) / 2, 8) AS cx, round(max(y) - min(y), 8) AS h FROM pt GROUP BY vec_id")
def p16_polygon_bounds(s, d):
    b = G.bounds(F.col("line"))
    return lines(s, d).select("vec_id", *(b[c].alias(c) for c in X.BOX), r(b["cx"], 8).alias("cx"), r(b["h"], 8).alias("h"))


@query(f"""WITH {POINTS}, q AS (SELECT vec_id, x * cos(radians(30)) - y * sin(radians(30)) AS u, x * sin(radians(30)) + y * cos(radians(30)) AS v FROM pt)
SELECT vec_id, round(min(u), 6) AS x1, round(max(v), 6) AS y2, round((max(u) - min(u)) * (max(v) - min(v)), 6) AS area FROM q GROUP BY vec_id""")
def p17_rotation(s, d):
    x = lines(s, d).withColumn("line", G.rotated(F.col("line"), F.lit(30), F.lit(0.0), F.lit(0.0)))
    b = G.bounds(F.col("line"))
    return x.select("vec_id", r(b["x1"]).alias("x1"), r(b["y2"]).alias("y2"), r(b["w"] * b["h"]).alias("area"))


@query("SELECT vec_id, [round(CAST(least(1.0, greatest(0.0, CAST(v AS DOUBLE) / 0.5)) AS DOUBLE), 6) FOR v IN embedding[1:8]] AS xy FROM embeddings")
def p19_normalize_and_clip(s, d):
    xy = F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double"))
    return table(s, d, "embeddings").select("vec_id", F.transform(G.normalized(xy, F.lit(0.5), F.lit(0.5)), lambda v: F.round(v, 6)).alias("xy"))


@query("SELECT o_orderkey, CAST(o_orderkey % 3 + 2 AS BIGINT) AS background, CAST(o_custkey % 5 AS BIGINT) AS foreground FROM orders")
def p20_rle_decode(s, d):
    counts = F.array(F.lit(2), (F.col("o_custkey") % 5).cast("int"), (F.col("o_orderkey") % 3).cast("int"))
    px = G.rle_pixels(counts)
    return table(s, d, "orders").select("o_orderkey", F.size(F.filter(px, lambda v: v == 0)).cast("long").alias("background"), F.size(F.filter(px, lambda v: v == 1)).cast("long").alias("foreground"))


@query(f"WITH {POINTS}, q AS (SELECT vec_id, i, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM pt WINDOW w AS (PARTITION BY vec_id ORDER BY i)), f AS (SELECT vec_id, x AS fx, y AS fy FROM pt WHERE i = 0) SELECT vec_id, round(abs(sum(x * coalesce(v, fy) - coalesce(u, fx) * y)) / 2, 6) AS area FROM q JOIN f USING (vec_id) GROUP BY vec_id")
def g24_polygon_area(s, d):
    return lines(s, d).select("vec_id", r(G.shoelace(F.col("line"))).alias("area"))


@query(f"""WITH {POINTS}, g AS (SELECT vec_id, i, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS u, coalesce(lead(y) OVER w, first(y) OVER w) AS v FROM pt WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
c(px, py) AS (VALUES (0.1, 0.1), (0.2, 0.1), (0.1, 0.2), (0.2, 0.2)), k AS (SELECT vec_id, px, py, count(*) FILTER ((y > py) <> (v > py) AND px < (u - x) * (py - y) / nullif(v - y, 0) + x) % 2 = 1 AS ins FROM g, c GROUP BY vec_id, px, py)
SELECT vec_id FROM pt WHERE x BETWEEN 0.1 AND 0.2 AND y BETWEEN 0.1 AND 0.2 UNION SELECT vec_id FROM k WHERE ins""")
def f12_polygon_meets_roi(s, d):
    return lines(s, d).filter(G.meets_roi(F.col("line"), F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.2))).select("vec_id")


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, round(value / 50) AS v, lag(round(value / 50)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR v <> p GROUP BY 1")
def w8_without_repeats(s, d):
    x = table(s, d, "events").select("user_id", "event_id", F.round(F.col("value") / 50).alias("v"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda z: F.struct(z["v"].alias("x"), F.lit(0.0).alias("y")))
    return x.groupBy("user_id").agg(line.alias("line")).select("user_id", F.size(G.without_repeats(F.col("line"))).cast("long").alias("n"))


@query("""WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (SELECT user_id, min(event_id) + (max(event_id) - min(event_id)) // 4 AS a, max(event_id) - (max(event_id) - min(event_id)) // 4 AS b FROM events GROUP BY 1)
SELECT k.user_id, min(i) AS lo, max(i) AS hi FROM g JOIN k ON g.user_id = k.user_id AND event_id BETWEEN a AND b GROUP BY 1""")
def w7_ranges_to_indices(s, d):
    """The middle half of each user's range of events, as positions among the user's events."""
    ev = table(s, d, "events").select("user_id", "event_id")
    k = ev.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    span = F.floor((F.max("event_id") - F.min("event_id")) / 4)
    g = ev.groupBy("user_id").agg((F.min("event_id") + span).alias("a"), (F.max("event_id") - span).alias("b"))
    return k.join(g, "user_id").filter("event_id between a and b").groupBy("user_id").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))


# --- masks: 64 floats as an 8 x 8 grid --------------------------------------------------------------------------------------


@query("SELECT vec_id, count(*) AS area, CAST(min(i % 8) AS INTEGER) AS x1, CAST(min(i // 8) AS INTEGER) AS y1, CAST(max(i % 8) AS INTEGER) AS x2, CAST(max(i // 8) AS INTEGER) AS y2 FROM (SELECT vec_id, i, embedding[i + 1] AS v FROM embeddings, range(64) t(i)) WHERE v > 0 GROUP BY vec_id")
def a36_s28_mask_area_and_box(s, d):
    p = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).filter("v > 0")
    c, q = F.col("i") % 8, F.floor(F.col("i") / 8).cast("int")
    return p.groupBy("vec_id").agg(F.count("*").alias("area"), F.min(c).alias("x1"), F.min(q).alias("y1"), F.max(c).alias("x2"), F.max(q).alias("y2"))


@query("SELECT vec_id, round(min(v), 4) AS lo, round(max(v), 4) AS hi, round(avg(v), 4) AS mean FROM (SELECT vec_id, (CAST(x AS DOUBLE) - list_min(embedding)) * 255.0 / (CAST(list_max(embedding) AS DOUBLE) - CAST(list_min(embedding) AS DOUBLE)) AS v FROM (SELECT vec_id, embedding, unnest(embedding) AS x FROM embeddings)) GROUP BY 1")
def p1_depth_normalize(s, d):
    px = F.transform("embedding", lambda v: v.cast("double"))
    x = table(s, d, "embeddings").select("vec_id", F.explode(G.stretched(px)).alias("v"))
    return x.groupBy("vec_id").agg(r(F.min("v"), 4).alias("lo"), r(F.max("v"), 4).alias("hi"), r(F.avg("v"), 4).alias("mean"))


ANCHORS = "an(anchor, ax, ay) AS (VALUES (0, 1.0, 1.0), (1, 5.5, 1.25), (2, 1.5, 6.0), (3, 6.0, 6.5))"


def pixels(s, d) -> DataFrame:
    p = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return p.select("vec_id", (F.col("i") % 8).cast("double").alias("x"), F.floor(F.col("i") / 8).cast("double").alias("y"), F.col("v").cast("double").alias("v"))


@query(f"""WITH {ANCHORS}, px AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)),
n AS (SELECT vec_id, v, arg_min(anchor, ((x - ax) ** 2 + (y - ay) ** 2, anchor)) AS seg FROM px, an GROUP BY vec_id, x, y, v)
SELECT vec_id, seg, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, count(*) AS n FROM n GROUP BY vec_id, seg UNION ALL SELECT vec_id, 4, NULL, NULL, 0 FROM embeddings""")
def j17_a23_g25_intensity_profile(s, d):
    four = [(0, 1.0, 1.0), (1, 5.5, 1.25), (2, 1.5, 6.0), (3, 6.0, 6.5)]
    each = F.array(*(F.struct(F.lit(k).alias("anchor"), F.lit(x).alias("ax"), F.lit(y).alias("ay")) for k, x, y in four))
    an = table(s, d, "embeddings").select("vec_id", F.inline(each))
    x = X.nearest_anchor(pixels(s, d), an, "vec_id").withColumnRenamed("anchor", "seg")
    return T.profile(x, "vec_id", "seg", "v", 5).select("vec_id", "seg", r("mean").alias("mean"), r("sd").alias("sd"), "n")


@query("SELECT vec_id, CAST(list_sum([CASE WHEN v > 0 THEN 1 ELSE 0 END FOR v IN embedding]) AS BIGINT) AS kept FROM embeddings")
def p10_f9_foreground(s, d):
    return table(s, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda v: v > 0)).cast("long").alias("kept"))


@query(f"""WITH en AS (SELECT vec_id // 16 AS image, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS sx, CAST(embedding[2] AS DOUBLE) AS sy, CAST(embedding[3] AS DOUBLE) AS ex, CAST(embedding[4] AS DOUBLE) AS ey FROM embeddings),
f AS (SELECT a.id AS a, b.id AS b, fa, fb, CASE WHEN fa = 1 THEN a.sx ELSE a.ex END AS ax, CASE WHEN fa = 1 THEN a.sy ELSE a.ey END AS ay, CASE WHEN fa = 1 THEN a.sx - a.ex ELSE a.ex - a.sx END AS dax, CASE WHEN fa = 1 THEN a.sy - a.ey ELSE a.ey - a.sy END AS day,
 CASE WHEN fb = 1 THEN b.ex ELSE b.sx END AS bx, CASE WHEN fb = 1 THEN b.ey ELSE b.sy END AS byy, CASE WHEN fb = 1 THEN b.sx - b.ex ELSE b.ex - b.sx END AS dbx, CASE WHEN fb = 1 THEN b.sy - b.ey ELSE b.ey - b.sy END AS dby
 FROM en a JOIN en b ON a.image = b.image AND a.id <> b.id, range(2) x(fa), range(2) y(fb)),
g AS (SELECT *, bx - ax AS gx, byy - ay AS gy FROM f), k AS (SELECT *, (dax * gx + day * gy) / (sqrt(dax ** 2 + day ** 2) * sqrt(gx ** 2 + gy ** 2)) AS ca, (dbx * gx + dby * gy) / (sqrt(dbx ** 2 + dby ** 2) * sqrt(gx ** 2 + gy ** 2)) AS cb FROM g)
SELECT a, b, fa, fb, round(sqrt(gx ** 2 + gy ** 2), 6) AS gap, round(ca, 6) AS cos_a, round(cb, 6) AS cos_b, sqrt(gx ** 2 + gy ** 2) <= 0.3 AND ca >= cos(radians(110)) AND cb >= cos(radians(110)) AS passed FROM k""")
def g18_g29_gap_costs(s, d):
    v = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("image"), F.col("vec_id").alias("id"), *(e(i).alias(n) for i, n in enumerate(("sx", "sy", "ex", "ey"))))
    a, b = (v.select("image", *(F.col(c).alias(f"{k}_{c}") for c in ("id", "sx", "sy", "ex", "ey"))) for k in "ab")
    flip = F.explode(F.array(F.lit(0), F.lit(1)))
    x = a.join(b, "image").filter("a_id <> b_id").select("*", flip.alias("fa")).select("*", flip.alias("fb"))
    fa, fb = F.col("fa") == 1, F.col("fb") == 1
    pick = lambda f, p, q: F.when(f, F.col(p)).otherwise(F.col(q))
    gx, gy = pick(fb, "b_ex", "b_sx") - pick(fa, "a_sx", "a_ex"), pick(fb, "b_ey", "b_sy") - pick(fa, "a_sy", "a_ey")
    sign = lambda f: F.when(f, -1).otherwise(1)
    dax, day = (F.col("a_ex") - F.col("a_sx")) * sign(fa), (F.col("a_ey") - F.col("a_sy")) * sign(fa)
    dbx, dby = (F.col("b_ex") - F.col("b_sx")) * sign(fb), (F.col("b_ey") - F.col("b_sy")) * sign(fb)
    n = F.sqrt(gx**2 + gy**2)
    x = x.withColumns({"gx": gx, "gy": gy, "ca": (dax * gx + day * gy) / (F.sqrt(dax**2 + day**2) * n), "cb": (dbx * gx + dby * gy) / (F.sqrt(dbx**2 + dby**2) * n)})
    cost = G.gap_cost(F.col("gx"), F.col("gy"), F.col("ca"), F.col("cb"), 0.3, 110.0)
    gap = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)
    return x.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("fa").cast("long").alias("fa"), F.col("fb").cast("long").alias("fb"), r(gap).alias("gap"), r("ca").alias("cos_a"), r("cb").alias("cos_b"), (cost < float("inf")).alias("passed"))


# --- names ------------------------------------------------------------------------------------------------------------------

NAME = "n AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m%d') || '-e' || (o_custkey % 7) || '-p' || (o_orderkey % 5) || '-4x_' || chr(CAST(65 + (o_orderkey % 96) // 12 AS INTEGER)) || lpad(CAST((o_orderkey % 12) + 1 AS VARCHAR), 2, '0') || '_roi_' || (o_orderkey % 4) || '.png' AS name FROM orders)"


def named(s, d) -> DataFrame:
    o = table(s, d, "orders")
    well = N.well_name(F.col("o_orderkey") % 96)
    k = F.col("o_orderkey")
    name = N.synthesized(F.date_format("o_orderdate", "yyyyMMdd"), F.concat(F.lit("e"), F.col("o_custkey") % 7), F.concat(F.lit("p"), k % 5), F.lit("4x"), well, k % 4)
    return o.select(k.alias("k"), name.alias("name"))


@query(f"WITH {NAME} SELECT k, name FROM n")
def s21_k20_synthesized_names(s, d):
    return named(s, d)


@query(f"""WITH {NAME}, f AS (SELECT k, name, regexp_extract(name, '^([0-9]+)-([^-]+)-([^-]+)-([^-_]+)_([^_]+)_roi_([0-9]+)[.]png$', ['date', 'experiment', 'plate', 'magnification', 'well', 'object_id']) AS g FROM n)
SELECT k, g.date AS date, g.experiment AS experiment, g.plate AS plate, g.magnification AS magnification, g.well AS well, g.object_id AS object_id FROM f""")
def p6_name_metadata(s, d):
    return named(s, d).select("k", *(v.alias(c) for c, v in N.metadata(F.col("name")).items()))


@query(f"""WITH {NAME} SELECT k, regexp_replace(name, '_roi_[0-9]+[.]png$', '') AS stem, split_part(name, '_roi_', 1) AS prefix, lower(regexp_replace(name, '[.]png$', '')) AS mapped, regexp_replace(name, '[.]png$', '.tif') AS tif,
regexp_replace(name, '^[0-9]+-([^-]+)-([^-]+)-[^_]+_([A-H][0-9]+)_roi_.*$', '\\1/\\2/\\3.tif') AS restored FROM n""")
def p27_p29_p30_p31_p42_names(s, d):
    n = F.col("name")
    return named(s, d).select("k", N.source_stem(n).alias("stem"), N.roi_prefix(n).alias("prefix"), N.mapped_key(n).alias("mapped"), N.as_tif(n).alias("tif"), N.restored(n).alias("restored"))


@query("SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS number, 'img' || o_orderkey || '.png' AS hosted FROM orders")
def p28_p30_image_numbers(s, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("img"), k, F.when(k % 2 == 0, "_png").otherwise("_jpg"), F.lit(".rf.ab12.jpg"))
    back = N.hosted_name(F.concat(F.lit("img"), k, F.lit("_png.rf.0f3a.jpg")))
    return table(s, d, "orders").select(k.alias("k"), N.image_number(name).alias("number"), back.alias("hosted"))


@query("SELECT DISTINCT p_type, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' curly' AS label, p_type || '_a_b' AS folder FROM part")
def p34_p37_labels(s, d):
    t = F.col("p_type")
    return table(s, d, "part").select("p_type", N.label_text(F.concat(t, F.lit("_worm_curly"))).alias("label"), N.folder_name(F.concat(t, F.lit(" a/b. "))).alias("folder")).distinct()


@query("SELECT p_partkey, 'part' || p_partkey || '_aug_' || (p_partkey % 200) || '.png' AS name, true AS made FROM part")
def p39_augmented_names(s, d):
    k = F.col("p_partkey")
    name = N.augmented_name(F.concat(F.lit("part"), k), F.lit("_aug"), k % 200, F.lit(".png"))
    return table(s, d, "part").select("p_partkey", name.alias("name"), N.is_augmented(name).alias("made"))


@query("SELECT l_returnflag AS flag, count(*) AS n, CASE l_returnflag WHEN 'A' THEN 'GAP;RING' WHEN 'N' THEN '' ELSE 'RING' END AS codes FROM lineitem GROUP BY 1")
def p8_warning_codes(s, d):
    m = F.when(F.col("flag") == "A", F.array(F.lit("a gap too far"), F.lit("ring seen"), F.lit("gap again"))).when(F.col("flag") == "N", F.array().cast("array<string>")).otherwise(F.array(F.lit("other"), F.lit("ring")))
    x = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    return x.withColumn("codes", M.flag_codes(m, {"gap": "GAP", "ring": "RING"}))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN l_quantity / l_discount * 3.2937 ELSE l_quantity * 3.2937 END, 7) AS um, round(CASE WHEN l_discount > 0 THEN l_quantity / l_discount * 3.2937 END, 7) AS strict FROM lineitem")
def p12_scale_back(s, d):
    px, sc = F.col("l_quantity"), F.col("l_discount")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", r(M.micrometres(px, sc), 7).alias("um"), r(M.micrometres(px, sc, strict=True), 7).alias("strict"))


@query("SELECT p_partkey, round(p_retailprice / p_size, 6) AS aspect FROM part WHERE p_size > 10")
def p36_aspect(s, d):
    return table(s, d, "part").filter("p_size > 10").select("p_partkey", r(M.aspect(F.col("p_retailprice"), F.col("p_size"))).alias("aspect"))


# --- annotation sets ----------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag AS category, count(*) AS n, round(avg(l_extendedprice), 3) AS area_mean, round(stddev_pop(l_extendedprice), 3) AS area_sd, min(l_extendedprice) AS area_min, max(l_extendedprice) AS area_max,
round(quantile_cont(l_extendedprice, 0.5), 3) AS area_median, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent FROM lineitem GROUP BY 1""")
def a24_category_stats(s, d):
    x = C.category_stats(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "category"), "category", "l_extendedprice")
    return x.withColumns({"area_mean": r("area_mean", 3), "area_sd": r("area_sd", 3), "area_median": r("area_median", 3), "percent": r("percent")})


@query("""WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS annotated, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd, min(n) AS min, max(n) AS max, quantile_cont(n, 0.5) AS median,
(SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS empty FROM n""")
def a25_annotations_per_image(s, d):
    x = C.per_image(table(s, d, "orders").select(F.col("o_orderkey").alias("i")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("i")), "i")
    return x.withColumns({"mean": r("mean"), "sd": r("sd")})


@query("SELECT (SELECT count(*) FROM orders) AS images, (SELECT count(*) FROM lineitem) AS annotations, count(*) AS categories, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT l_returnflag AS name FROM lineitem)")
def a26_a27_totals(s, d):
    li = table(s, d, "lineitem")
    return C.totals(table(s, d, "orders"), li, li.select(F.col("l_returnflag").alias("name")).distinct())


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY 1")
def f10_without_augmented(s, d):
    img = table(s, d, "orders").select(F.col("o_orderkey").alias("i"), F.concat(F.lit("im"), "o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, "_aug_7").otherwise(""), F.lit(".png")).alias("name"))
    _, ann = C.without_augmented(img, table(s, d, "lineitem").select(F.col("l_orderkey").alias("i")), "i", "name")
    return ann.groupBy(F.col("i").alias("l_orderkey")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (p_size <> 0) AS changed FROM part")
def r5_flatten_categories(s, d):
    return T.flattened(table(s, d, "part"), "p_size").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query("SELECT 'train' AS split, CAST(floor(count(*) * 0.8) AS BIGINT) AS n, round(floor(count(*) * 0.8) / count(*), 6) AS ratio FROM part UNION ALL SELECT 'valid', count(*) - CAST(floor(count(*) * 0.8) AS BIGINT), round((count(*) - floor(count(*) * 0.8)) / count(*), 6) FROM part")
def r6_a34_split_summary(s, d):
    return C.split_summary(T.split(table(s, d, "part"), "p_partkey", 0.8)).withColumn("ratio", r("ratio"))


@query("SELECT p_partkey, p_type FROM part ORDER BY md5(p_partkey || ':42'), p_partkey LIMIT 50")
def r8_seeded_sample(s, d):
    """Fifty parts: the sample is the feature."""
    return T.sample(table(s, d, "part"), "p_partkey", 50).select("p_partkey", "p_type")


@query("SELECT o_orderkey, CASE (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 WHEN 0 THEN 'intensity' WHEN 1 THEN 'noise' ELSE 'rotation' END AS aug_type, true AS in_range FROM orders")
def r9_g26_augmentation_plan(s, d):
    x = C.augmentation_plan(table(s, d, "orders"), "o_orderkey")
    return x.select("o_orderkey", "aug_type", (F.col("factor").between(0.7, 1.3) & F.col("noise_sd").between(5, 20) & F.col("degrees").between(-15, 15)).alias("in_range"))


@query("SELECT event_id, ts, user_id, event_type, value, 1000 + row_number() OVER (ORDER BY event_id) AS new_id FROM events")
def w14_new_ids(s, d):
    return T.new_ids(table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value"), "event_id", 1000)


@query("SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def w15_grouped_files(s, d):
    ids = F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return table(s, d, "documents").groupBy("source").agg(F.array_join(ids, ",").alias("ids"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS version FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)")
def w16_k17_latest_version(s, d):
    return K.latest(table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("version")))


@query("SELECT page_id FROM pages ORDER BY page_id LIMIT 25")
def w17_first_images(s, d):
    return table(s, d, "pages").select("page_id").orderBy("page_id").limit(25)


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def k21_copy_status(s, d):
    docs = table(s, d, "documents").select(F.col("doc_id").alias("name"))
    return K.copy_status(docs, table(s, d, "labels").select(F.col("doc_id").alias("name")), docs.filter("name % 5 = 0"))


REGIONS = """pt AS (SELECT vec_id, i, 200 * CAST(embedding[2 * i + 1] AS DOUBLE) AS x, 200 * CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(32) t(i)),
ed AS (SELECT vec_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS u, coalesce(lead(y) OVER w, first(y) OVER w) AS v FROM pt WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
bx AS (SELECT vec_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM pt GROUP BY 1), sz AS (SELECT *, greatest(32, CAST(trunc(greatest(x2 - x1, y2 - y1) * 1.3) AS INTEGER)) AS size FROM bx),
rg AS (SELECT vec_id, size, CAST(trunc((x1 + x2) / 2) AS INTEGER) - size // 2 AS l, CAST(trunc((y1 + y2) / 2) AS INTEGER) - size // 2 AS t FROM sz),
pr AS (SELECT r.vec_id AS target, n.vec_id AS ann_id, r.vec_id // 8 AS image_id, r.size, r.l, r.t FROM rg r JOIN rg n ON r.vec_id // 8 = n.vec_id // 8),
vx AS (SELECT DISTINCT target, ann_id FROM pr JOIN pt ON pt.vec_id = ann_id WHERE x BETWEEN l AND l + size AND y BETWEEN t AND t + size),
cn AS (SELECT DISTINCT target, ann_id FROM (SELECT target, ann_id, px, py FROM (SELECT target, ann_id, l + dx * size AS px, t + dy * size AS py FROM pr, range(2) a(dx), range(2) b(dy)) JOIN ed ON ed.vec_id = ann_id
  WHERE (y > py) <> (v > py) AND px < (u - x) * (py - y) / (v - y) + x GROUP BY ALL HAVING count(*) % 2 = 1)),
me AS (SELECT pr.* FROM pr WHERE target = ann_id OR (target, ann_id) IN (SELECT (target, ann_id) FROM vx) OR (target, ann_id) IN (SELECT (target, ann_id) FROM cn))"""


def annotated(s, d) -> DataFrame:
    scaled = F.transform("line", lambda p: F.struct((p["x"] * 200).alias("x"), (p["y"] * 200).alias("y")))
    x = lines(s, d).select(F.floor(F.col("vec_id") / 8).alias("image_id"), F.col("vec_id").alias("ann_id"), F.col("label").alias("category_id"), scaled.alias("polygon"))
    return spread(x, "image_id")


@query(f"WITH {REGIONS} SELECT image_id, target, ann_id, size, round(512 / size, 6) AS scale_factor FROM me")
def g27_roi_dataset(s, d):
    return C.roi_dataset(annotated(s, d)).select("image_id", "target", "ann_id", "size", "scale_factor")


@query(f"WITH {REGIONS} SELECT a.label AS data_set, target, ann_id, 0 AS category_id FROM me JOIN embeddings a ON a.vec_id = target JOIN embeddings b ON b.vec_id = ann_id WHERE a.label = b.label")
def r7_class_routing(s, d):
    return C.roi_dataset(annotated(s, d), by_class=True).select("data_set", "target", "ann_id", "category_id")


@query("""SELECT 'im' || vec_id || '.png' AS file_name, CASE WHEN vec_id % 4 = 0 THEN '' ELSE label || ' ' || array_to_string([printf('%.6f', least(1.0, greatest(0.0, CAST(v AS DOUBLE) / 0.5))) FOR v IN embedding[1:8]], ' ') END AS text FROM embeddings""")
def k6_k7_yolo_text(s, d):
    x = table(s, d, "embeddings")
    img = x.select(F.col("vec_id").alias("image_id"), F.concat(F.lit("im"), "vec_id", F.lit(".png")).alias("file_name"), F.lit(0.5).alias("width"), F.lit(0.5).alias("height"))
    ann = x.filter("vec_id % 4 <> 0").select(F.col("vec_id").alias("image_id"), F.lit(1).alias("ann_id"), F.col("label").alias("category_id"), F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("double")).alias("segment"))
    return C.to_yolo(img, ann)


# --- files and JSON -------------------------------------------------------------------------------------------------------------


@query()
def s5_k2_roi_catalog(s, d):
    rows = boxes(s, d).select("label", F.concat(F.lit("im_roi_"), "vec_id").alias("name"), F.lit("im").alias("source_image"), F.col("vec_id").cast("int").alias("detection_index"), r("x1", 2).alias("confidence"), F.array(*(r(c, 2) for c in X.BOX)).alias("bbox_original"))
    return S.from_catalog_text(K.catalog_json(rows, per="label")).select("name", "source_image", "detection_index", "bbox_original")


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS v, json_keys(props)[1] AS k FROM events WHERE props IS NOT NULL AND len(json_keys(props)) > 0")
def s8_s15_json_fields(s, d):
    x = table(s, d, "events").filter("props is not null").select("event_id", F.from_json("props", "map<string,string>").alias("m")).filter(F.size("m") > 0)
    return x.select("event_id", F.map_values("m")[0].alias("v"), F.map_keys("m")[0].alias("k"))


@query("SELECT vec_id AS file, 0 AS line, label AS class_id, 4 AS points FROM embeddings WHERE vec_id % 3 <> 0")
def s6_s7_yolo_lines(s, d):
    x = table(s, d, "embeddings")
    good = F.concat_ws(" ", F.col("label"), F.array_join(F.transform(F.slice("embedding", 1, 8), lambda v: v.cast("string")), " "))
    text = x.select(F.col("vec_id").alias("file"), F.lit(0).alias("line"), F.when(F.col("vec_id") % 3 == 0, F.lit("1 0.5 0.5 0.1")).otherwise(good).alias("value"))
    return S.yolo_lines(text, clip=True).select("file", "line", "class_id", F.size("pts").alias("points"))


@query("SELECT vec_id AS file, 'contour' AS section, 0 AS part, CAST(i AS INTEGER) AS pos, round(CAST(embedding[2 * i + 1] AS DOUBLE), 6) AS x FROM embeddings, range(4) t(i) UNION ALL SELECT vec_id, 'skeleton', 0, CAST(i - 4 AS INTEGER), round(CAST(embedding[2 * i + 1] AS DOUBLE), 6) FROM embeddings, range(4, 8) t(i)")
def s9_k3_contour_text(s, d):
    p = lines(s, d).select(F.col("vec_id").alias("file"), F.posexplode(F.slice("line", 1, 8)).alias("i", "p"))
    kind = F.when(F.col("i") < 4, "contour").otherwise("skeleton")
    rows = p.select("file", kind.alias("section"), F.lit(0).alias("part"), (F.col("i") % 4).alias("pos"), "p.x", "p.y")
    back = S.contour_text(K.contour_lines(rows).withColumnRenamed("text", "value"))
    return back.select("file", "section", "part", "pos", F.round("x", 6).alias("x"))


@query("SELECT n_name AS hosted, 'r' || n_regionkey || '.tif' AS original FROM nation")
def s12_s13_s14_name_maps(s, d):
    text = table(s, d, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit("\tr"), "n_regionkey", F.lit(".tif"))).otherwise(F.concat(F.lit(" "), "n_name", F.lit("  r"), "n_regionkey", F.lit(".tif "))).alias("value"))
    return S.name_map(text.union(s.createDataFrame([("lonely",), ("",)], "value string")))


@query("SELECT user_id AS img, event_type AS module, round(value, 2) AS wall FROM events")
def s16_timing_log(s, d):
    ev = table(s, d, "events")
    rec = F.concat(F.lit("noise\nImage # "), "user_id", F.lit(", module "), "event_type", F.lit(" # 3: CPU_time = 0.10 secs, Wall_time = "), F.format_string("%.2f", "value"), F.lit(" secs\n"))
    files = ev.select(F.lit("log").alias("path"), F.encode(rec, "UTF-16LE").alias("content"))
    return S.timing_records(S.decoded_log(files)).select("img", "module", "wall").withColumn("img", F.col("img").cast("long"))


@query("SELECT DISTINCT c_mktsegment AS stem FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def s22_f4_censor_list(s, d):
    text = table(s, d, "customer").select(F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("# gone")).otherwise(F.concat(F.lit(" dir/"), "c_mktsegment", F.lit(".png "))).alias("value"))
    return S.censored(text)


@query("SELECT s_suppkey AS i, 'raw/' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.jpg' ELSE '.tif' END AS path FROM supplier")
def s24_raw_image_candidates(s, d):
    k = F.col("s_suppkey")
    x = table(s, d, "supplier")
    files = x.select(F.concat(F.lit("raw/"), k, F.lit(".tif")).alias("path")).union(x.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("raw/"), k, F.lit(".jpg"))))
    rois = x.select(F.concat(k, F.lit("_roi_3.png")).alias("name"))
    return S.raw_candidates(rois, files).select(N.source_stem(F.col("name")).cast("long").alias("i"), "path")


@query("SELECT s_suppkey, 'a/images/b/labels/' || s_suppkey || '.txt' AS path FROM supplier")
def s26_label_paths(s, d):
    return table(s, d, "supplier").select("s_suppkey", S.label_path(F.concat(F.lit("a/images/b/images/"), "s_suppkey", F.lit(".png"))).alias("path"))


@query("SELECT i, CAST(i // 96 + 1 AS BIGINT) AS plate, chr(CAST(65 + (i % 96) // 12 AS INTEGER)) || lpad(CAST(i % 12 + 1 AS VARCHAR), 2, '0') AS well FROM range(300) t(i)")
def s21_plate_wells(s, d):
    return S.plate_wells(s, 300)


@query("SELECT 'f' || l_orderkey AS file, CAST(trunc(l_quantity) AS INTEGER) AS x1, CAST(trunc(l_extendedprice) AS INTEGER) AS y2, l_tax AS length_um FROM lineitem")
def s11_p22_p23_external_tool(s, d):
    x = table(s, d, "lineitem").select(
        F.concat(F.lit("f"), "l_orderkey").alias("FileName_ RoboFlow"), F.col("l_quantity").cast("string").alias("po_AreaShape_BoundingBoxMinimum_X\r"), F.col("l_quantity").alias("po_AreaShape_BoundingBoxMinimum_Y"),
        F.col("l_quantity").alias("po_AreaShape_BoundingBoxMaximum_X"), F.col("l_extendedprice").alias("po_AreaShape_BoundingBox Maximum_Y"), F.col("l_tax").cast("string").alias("worm_length_um"))
    return S.external_tool(x).select("file", "x1", "y2", "length_um")


@query("SELECT rpad(p_type, 40, ' ') || lpad(printf('%.3f', CAST(count(*) AS DOUBLE)), 12, ' ') || lpad(printf('%.3f', CAST(sum(p_size) AS DOUBLE)), 12, ' ') || lpad(printf('%.3f', CAST(max(p_size) AS DOUBLE)), 12, ' ') AS text FROM part GROUP BY p_type")
def k12_report_lines(s, d):
    x = table(s, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"), F.max("p_size").alias("most"))
    return K.report(x, "p_type", ["n", "total", "most"])


@query("""WITH b AS (SELECT vec_id, vec_id // 4 AS image, vec_id % 4 AS i, label, CAST(embedding[1] AS DOUBLE) AS x1, len(list_filter(embedding, lambda v: v > 0)) AS lit FROM embeddings)
SELECT 'im' || image || '.png' AS path, CAST(i AS INTEGER) AS pos, round(x1, 8) AS x1, 'Class ' || label AS class_name, CASE WHEN i <> 2 THEN CAST(lit AS BIGINT) END AS mask_area FROM b""")
def k19_predictions_json(s, d):
    """Written as JSON an image and read back; one detection of four has no mask."""
    x = table(s, d, "embeddings").withColumn("lit", F.size(F.filter("embedding", lambda v: v > 0)))
    x = x.select(F.concat(F.lit("im"), F.floor(F.col("vec_id") / 4), F.lit(".png")).alias("path"), (F.col("vec_id") % 4).cast("int").alias("detection_index"), *(e(k).alias(c) for k, c in enumerate(X.BOX)), F.lit(0.5).alias("conf"), F.col("label").alias("class_id"), F.col("lit").alias("area"))
    text = K.predictions_json(x, x.filter("detection_index <> 2"))
    back = text.select("path", F.posexplode(F.from_json("content", "array<struct<box:array<double>,class_name:string,mask_area:bigint>>")).alias("pos", "p"))
    return back.select("path", "pos", r(F.get("p.box", 0), 8).alias("x1"), "p.class_name", "p.mask_area")


@query(f"""WITH {NAME}, m AS (SELECT k, name, o_totalprice / 100 AS px, o_orderstatus AS st FROM n JOIN orders ON o_orderkey = k)
SELECT name AS "Filename", split_part(name, '-', 1) AS "Date", split_part(name, '-', 2) AS "Metadata_Experiment", split_part(name, '-', 3) AS "Metadata_Plate", '4x' AS "Magnification", regexp_extract(name, '_([A-H][0-9]+)_roi', 1) AS "Metadata_Well",
regexp_extract(name, '_roi_([0-9]+)', 1) AS "Worm_ID", round(px / CASE WHEN k % 3 = 0 THEN 1.0 ELSE 2.0 END * 3.2937, 3) AS "Length_um", round(CASE WHEN st <> 'P' THEN px / 10 / CASE WHEN k % 3 = 0 THEN 1.0 ELSE 2.0 END * 3.2937 END, 3) AS "Width_um",
CASE WHEN st = 'F' THEN 'ring;gap: far' ELSE '' END AS "Topology_Warnings" FROM m""")
def p7_measurement_row(s, d):
    o = named(s, d).join(table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), F.col("k") == F.col("o_orderkey"))
    px = F.col("o_totalprice") / 100
    m = o.select("k", F.concat(F.lit("out/"), "name").alias("path"), px.alias("length_px"), F.when(F.col("o_orderstatus") != "P", px / 10).alias("width_px"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("ring"), F.lit("gap: far"))).otherwise(F.array()).alias("warnings"))
    # names repeat between orders, so that each gets its order's key
    keyed = m.withColumn("path", F.concat(F.regexp_replace("path", r"[.]png$", ""), F.lit("#"), "k", F.lit(".png")))
    catalog = named(s, d).filter("k % 3 <> 0").select(F.concat(N.without_extension(F.col("name")), F.lit("#"), "k").alias("name"), F.lit(2.0).alias("scale_factor"))
    out = measure.measurement_rows(keyed, catalog)
    return out.withColumns({"Filename": F.regexp_replace("Filename", r"#[0-9]+", ""), "Worm_ID": F.regexp_replace("Worm_ID", r"#[0-9]+", ""), "Length_um": r("Length_um", 3), "Width_um": r("Width_um", 3)})


@query("""SELECT rank, 'rank' || lpad(CAST(rank AS VARCHAR), 2, '0') || '_abs' || lpad(printf('%.3f', abs(percent)), 7, '0') || 'pct_' || CASE WHEN percent < 0 THEN 'neg' ELSE 'pos' END
 || '_' || p_type || '_' || p_partkey || '.png' AS target
FROM (SELECT p_type, p_partkey, p_size - 25.5 AS percent, row_number() OVER (ORDER BY abs(p_size - 25.5) DESC, p_partkey) AS rank FROM part) WHERE rank <= 60""")
def k22_ranked_names(s, d):
    """The names of the 60 largest errors: a top-n report."""
    x = table(s, d, "part").select((F.col("p_size") - 25.5).alias("percent"), F.col("p_type").alias("category"), "p_partkey")
    x = x.orderBy(F.abs("percent").desc(), "p_partkey").limit(60)
    x = x.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("percent").desc(), "p_partkey"))).withColumn("file", F.concat("p_partkey", F.lit(".png")))
    return K.ranked_manifest(x).select(F.col("rank").cast("long").alias("rank"), "target")


# --- images ---------------------------------------------------------------------------------------------------------------------


def images(s, d) -> DataFrame:
    """Deterministic 64 x 64 pictures of a bar, one for each vector: placed and turned by its first components."""
    return spread(table(s, d, "embeddings"), "vec_id").select(
        F.concat(F.lit("20200101-e1-p1-4x_A01_roi_"), "vec_id", F.lit(".png")).alias("path"), F.lit(64).alias("height"), F.lit(64).alias("width"),
        F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.when((F.abs(i % 64 - 32) < 24) & (F.abs(F.floor(i / 64) - 32 - F.get("embedding", 0) * 10) < 4), 1.0).otherwise(0.0)).alias("pixels"),
    )


@query()
def g1_f1_detect(s, d):
    return measure.detect(images(s, d), measure.ThresholdPredictor, radius=0.94)


@query()
def g4_g17_g28_measure(s, d):
    return measure.measure(images(s, d), measure.ThresholdPredictor).drop("started", "elapsed_ms")


@query()
def p7_k1_measurement_rows(s, d):
    return measure.measurement_rows(measure.measure(images(s, d), measure.ThresholdPredictor))


# --- mask kernels over 8 x 8 grids ------------------------------------------------------------------------------------------------


def grids(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query()
def g5_g9_g22_shapes(s, d):
    return Z.shape_table(grids(s, d))


@query()
def p18_clip_polygons(s, d):
    return C.clip_polygons(C.roi_dataset(annotated(s, d))).select("image_id", "target", "ann_id", F.size("clip").alias("points"))


@query()
def p38_augment_pixels(s, d):
    x = C.augmentation_plan(grids(s, d).withColumn("pixels", F.transform("pixels", lambda v: F.abs(v) * 400)), "id")
    return Z.augmented(x).select("id", "aug_type", F.array_max("changed").alias("most"))


@query()
def p40_inside_well(s, d):
    return Z.inside_well(grids(s, d).withColumn("pixels", F.transform("pixels", lambda v: F.floor(F.abs(v) * 10000).cast("double"))))


@query()
def g20_g21_stitch(s, d):
    x = lines(s, d).select(F.concat(F.lit("im"), F.floor(F.col("vec_id") / 3)).alias("image"), (F.col("vec_id") % 3).cast("int").alias("idx"), F.transform(F.slice("line", 1, 4), lambda p: F.struct((p["x"] * 100).alias("x"), (p["y"] * 100).alias("y"))).alias("line"))
    return Z.stitched(x)


@query()
def g10_g17_centerlines(s, d):
    return measure.measure(images(s, d), measure.ThresholdPredictor).select("path", "length_px", "width_px", "topology", "fragments")
