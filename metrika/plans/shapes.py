"""Queries of run-length masks, intensity profiles, suppression and average precision over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection as D
from ..operators import matching as X
from ..operators import profiles as P
from ..operators import runs as Q
from ..sources import files as S
from ..sources import sinks as K
from .objects import BOXES, SEGMENTS, boxes, e, lines, r
from .registry import query, table

# --- masks: 64 floats as an 8 x 8 grid ------------------------------------------------------------------------------------


def grid(s: SparkSession, d: str, least: float = 0.0) -> DataFrame:
    """Lit pixels (id, y, x)."""
    p = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("i", "v")).filter(F.col("v") > least)
    return p.select("id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"))


def imaged(runs: DataFrame, n: int = 16) -> DataFrame:
    return runs.withColumn("image", F.floor(F.col("id") / n))


@query("""WITH m AS (SELECT vec_id, vec_id // 16 AS image, [CASE WHEN v > 0 THEN 1 ELSE 0 END FOR v IN embedding] AS px FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(coalesce(list_sum([a.px[i] * b.px[i] FOR i IN range(1, 65)]) / nullif(list_sum(a.px) + list_sum(b.px) - list_sum([a.px[i] * b.px[i] FOR i IN range(1, 65)]), 0), 0.0), 8) AS iou
FROM m a JOIN m b ON a.image = b.image AND a.vec_id < b.vec_id""")
def j12_mask_iou(s, d):
    runs = imaged(Q.from_pixels(grid(s, d), ["id"]))
    m = imaged(table(s, d, "embeddings").select(F.col("vec_id").alias("id")))
    p = m.select("image", F.col("id").alias("a")).join(m.select("image", F.col("id").alias("b")), "image").filter("a < b")
    return Q.mask_iou(p, runs, runs, "image").select("a", "b", r("iou", 8).alias("iou"))


@query("""WITH px AS (SELECT vec_id AS id, i // 8 AS y, i % 8 AS x FROM embeddings, range(64) t(i) WHERE embedding[i + 1] > 0),
g AS (SELECT id, y, x, x - row_number() OVER (PARTITION BY id, y ORDER BY x) AS k FROM px) SELECT id, CAST(y AS INTEGER) AS y, CAST(min(x) AS INTEGER) AS x1, CAST(max(x) AS INTEGER) AS x2 FROM g GROUP BY id, y, k""")
def k4_mask_runs(s, d):
    """What a mask is stored as: its runs."""
    return Q.from_pixels(grid(s, d), ["id"]).select("id", "y", "x1", "x2")


@query("""SELECT vec_id AS id, count(*) FILTER (v > 0) AS area, min(i % 8 + vec_id % 20) FILTER (v > 0) AS x1, min(i // 8 + 2) FILTER (v > 0) AS y1,
 max(i % 8 + vec_id % 20) FILTER (v > 0) AS x2, max(i // 8 + 2) FILTER (v > 0) AS y2
FROM (SELECT vec_id, i, embedding[i + 1] AS v FROM embeddings, range(64) t(i)) GROUP BY vec_id""")
def p10_k4_masks_on_canvas(s, d):
    runs = Q.pasted(Q.from_pixels(grid(s, d), ["id"]), (F.col("id") % 20).cast("int"), F.lit(2), F.lit(32), F.lit(32))
    m = Q.measured(runs, ["id"])
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id")).join(m, "id", "left").select("id", F.coalesce("area", F.lit(0)).alias("area"), *(F.col(c).cast("long").alias(c) for c in X.BOX))


@query("""WITH px AS (SELECT vec_id AS id, X, Y FROM embeddings, range(21) a(X), range(21) b(Y) WHERE embedding[1 + (Y * 8 // 21) * 8 + X * 8 // 21] > 0),
c AS (SELECT id, X - 3 AS x, Y + vec % 9 AS y FROM (SELECT *, id AS vec FROM px)) SELECT id, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM c WHERE x BETWEEN 0 AND 15 AND y BETWEEN 0 AND 19 GROUP BY id""")
def p10_scaled_and_clipped(s, d):
    """Cut-outs of 8 pixels a side, shown at 21 by nearest neighbour, pasted over the edges of a canvas of 16 x 20."""
    runs = Q.scaled(Q.from_pixels(grid(s, d), ["id"]), F.lit(8), F.lit(21))
    m = Q.measured(Q.pasted(runs, F.lit(-3), (F.col("id") % 9).cast("int"), F.lit(16), F.lit(20)), ["id"])
    return m.select("id", "area", *(F.col(c).cast("long").alias(c) for c in X.BOX))


@query("""WITH pt AS (SELECT vec_id, i, CAST(embedding[2 * i + 1] AS DOUBLE) * 60 + 32 AS x, CAST(embedding[2 * i + 2] AS DOUBLE) * 60 + 32 AS y FROM embeddings, range(32) t(i)),
g AS (SELECT vec_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS u, coalesce(lead(y) OVER w, first(y) OVER w) AS v FROM pt WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
c AS (SELECT vec_id, py, (u - x) * (py - y) / (v - y) + x AS cx FROM g, range(64) b(py) WHERE (y > py) <> (v > py)),
k AS (SELECT vec_id, py, px FROM c, range(64) a(px) WHERE px < cx GROUP BY vec_id, py, px HAVING count(*) % 2 = 1)
SELECT vec_id, count(*) AS area, min(px) AS x1, min(py) AS y1, max(px) AS x2, max(py) AS y2 FROM k GROUP BY vec_id""")
def g23_rasterize(s, d):
    poly = F.transform("line", lambda p: F.struct((p["x"] * 60 + 32).alias("x"), (p["y"] * 60 + 32).alias("y")))
    runs = Q.from_polygons(lines(s, d).select("vec_id", poly.alias("polygon")), ["vec_id"], width=F.lit(64), height=F.lit(64))
    return Q.measured(runs, ["vec_id"]).select("vec_id", "area", *(F.col(c).cast("long").alias(c) for c in X.BOX))


@query("""WITH RECURSIVE px AS (SELECT vec_id AS id, i // 8 AS y, i % 8 AS x, i FROM embeddings, range(64) t(i) WHERE embedding[i + 1] > 0),
e AS (SELECT a.id, a.i AS a, b.i AS b FROM px a JOIN px b ON a.id = b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
w AS (SELECT id, i AS a, i AS b FROM px UNION SELECT w.id, w.a, e.b FROM w JOIN e ON w.id = e.id AND w.b = e.a),
m AS (SELECT id, a, min(b) AS first FROM w GROUP BY 1, 2)
SELECT id, count(*) AS area, round(avg(a // 8), 6) AS row, round(avg(a % 8), 6) AS col FROM m GROUP BY id, first""")
def g3_components(s, d):
    return Q.part_table(Q.from_pixels(grid(s, d), ["id"]), ["id"]).select("id", "area", r("row").alias("row"), r("col").alias("col"))


@query("""WITH RECURSIVE px AS (SELECT vec_id AS id, i // 8 AS y, i % 8 AS x, i, embedding[i + 1] > -0.05 AS lit FROM embeddings, range(64) t(i)), bg AS (SELECT * FROM px WHERE NOT lit),
e AS (SELECT a.id, a.i AS a, b.i AS b FROM bg a JOIN bg b ON a.id = b.id AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
w AS (SELECT id, i FROM bg WHERE x IN (0, 7) OR y IN (0, 7) UNION SELECT w.id, e.b FROM w JOIN e ON w.id = e.id AND w.i = e.a)
SELECT id, count(*) AS area, count(*) FILTER (NOT lit) AS holes FROM px WHERE lit OR (id, i) NOT IN (SELECT (id, i) FROM w) GROUP BY id""")
def g5_filled_holes(s, d):
    """Pixels of each mask with its holes, and of the holes."""
    runs = Q.from_pixels(grid(s, d, -0.05), ["id"])
    masks = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    whole, own = Q.measured(Q.filled(runs, masks, ["id"]), ["id"]), Q.measured(runs, ["id"]).select("id", F.col("area").alias("lit"))
    return whole.join(own, "id", "left").select("id", "area", (F.col("area") - F.coalesce("lit", F.lit(0))).alias("holes"))


# --- intensity profiles -----------------------------------------------------------------------------------------------------


@query(f"""WITH {SEGMENTS}, v AS (SELECT vec_id, i, x, y, coalesce(run, 0.0) AS pos FROM pt JOIN cu USING (vec_id, i)), n AS (SELECT vec_id, max(pos) AS total FROM v GROUP BY 1),
w AS (SELECT vec_id, k, CASE WHEN k = 9 THEN total ELSE total / 9 * k END AS t FROM n, range(10) q(k)),
s AS (SELECT a.vec_id, a.i, a.x, a.y, a.pos, b.x AS u, b.y AS v, b.pos AS til FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = a.i + 1)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(x + (u - x) * (t - pos) / (til - pos), 6) AS x, round(y + (v - y) * (t - pos) / (til - pos), 6) AS y FROM w JOIN s USING (vec_id) WHERE pos <= t
QUALIFY row_number() OVER (PARTITION BY vec_id, k ORDER BY i DESC) = 1""")
def p14_arc_resample(s, d):
    p = lines(s, d).select("vec_id", F.posexplode("line").alias("i", "p")).select("vec_id", "i", "p.x", "p.y")
    return P.resample_by_arc(p, "vec_id", "i", 10).select("vec_id", "k", r("x").alias("x"), r("y").alias("y"))


def u(i: int, n: int = 16):
    """A component of the vector as one of n steps of 1/64, which six decimals hold exactly."""
    return F.floor(F.abs(e(i)) * 640).cast("long") % n / 64.0


OUTLINE = """m AS (SELECT vec_id, embedding, [CAST(floor(abs(CAST(v AS DOUBLE)) * 640) AS BIGINT) % 16 / 64.0 FOR v IN embedding[1:4]] AS q FROM embeddings),
poly AS (SELECT vec_id, 0 AS i, 8 * q[1] AS x, 8 * q[2] AS y FROM m UNION ALL SELECT vec_id, 1, 8 * (1 - q[3]), 1.0 FROM m UNION ALL SELECT vec_id, 2, 8 * (1 - q[1]), 8 * (1 - q[4]) FROM m UNION ALL SELECT vec_id, 3, 8 * q[3], 8 * (1 - q[2]) FROM m),
bone AS (SELECT vec_id, 0 AS i, 8 * q[1] AS x, 2.0 AS y FROM m UNION ALL SELECT vec_id, 1, 4.0, 8 * (0.25 + q[2]) FROM m UNION ALL SELECT vec_id, 2, 6.0, 4.0 FROM m UNION ALL SELECT vec_id, 3, 8 * (1 - q[3]), 6.0 FROM m),
g AS (SELECT vec_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS u, coalesce(lead(y) OVER w, first(y) OVER w) AS v FROM poly WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
c AS (SELECT vec_id, py, (u - x) * (py - y) / (v - y) + x AS cx FROM g, range(8) b(py) WHERE (y > py) <> (v > py)),
lit AS (SELECT vec_id, py, px FROM c, range(8) a(px) WHERE px < cx GROUP BY vec_id, py, px HAVING count(*) % 2 = 1),
sg AS (SELECT vec_id, i, x, y, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0.0) AS d FROM bone WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
v AS (SELECT vec_id, i, x, y, sum(d) OVER (PARTITION BY vec_id ORDER BY i) AS pos FROM sg), n AS (SELECT vec_id, max(pos) AS total FROM v GROUP BY 1),
w AS (SELECT vec_id, k, CASE WHEN k = 4 THEN total ELSE total / 4 * k END AS t FROM n, range(5) q(k)),
st AS (SELECT a.vec_id, a.i, a.x, a.y, a.pos, b.x AS u, b.y AS v, b.pos AS til FROM v a JOIN v b ON a.vec_id = b.vec_id AND b.i = a.i + 1),
an AS (SELECT vec_id, k, x + (u - x) * (t - pos) / (til - pos) AS ax, y + (v - y) * (t - pos) / (til - pos) AS ay FROM w JOIN st USING (vec_id) WHERE pos <= t QUALIFY row_number() OVER (PARTITION BY vec_id, k ORDER BY i DESC) = 1),
near AS (SELECT vec_id, py, px, arg_min(k, ((px - ax) ** 2 + (py - ay) ** 2, k)) AS k FROM lit JOIN an USING (vec_id) GROUP BY vec_id, py, px),
val AS (SELECT near.vec_id, k, CAST(embedding[{0}] AS DOUBLE) AS v FROM near JOIN m USING (vec_id)),
out AS (SELECT vec_id, k, avg(v) AS mean, stddev_pop(v) AS sd, count(*) AS n FROM val GROUP BY 1, 2)
SELECT vec_id AS file, CAST(k AS INTEGER) AS segment, round(mean, 6) AS mean, round(sd, 6) AS sd, coalesce(out.n, 0) AS n FROM w LEFT JOIN out USING (vec_id, k)"""


def outline_text(s: SparkSession, d: str) -> DataFrame:
    """Contour and skeleton of each vector as a text file, written and read back by the library."""
    one, half, quarter = F.lit(1.0), F.lit(0.5), F.lit(0.25)
    places = {"contour": [(u(0), u(1)), (one - u(2), F.lit(0.125)), (one - u(0), one - u(3)), (u(2), one - u(1))], "skeleton": [(u(0), quarter), (half, quarter + u(1)), (F.lit(0.75), half), (one - u(2), F.lit(0.75))]}
    all_of = F.array(*(F.struct(F.lit(k).alias("section"), F.lit(i).alias("pos"), x.cast("double").alias("x"), y.cast("double").alias("y")) for k, pos in places.items() for i, (x, y) in enumerate(pos)))
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("file"), F.lit(0).alias("part"), F.inline(all_of))
    return K.contour_lines(rows.select("file", "section", "part", "pos", "x", "y"))


def image_pixels(s: SparkSession, d: str, turned: bool = False) -> DataFrame:
    p = table(s, d, "embeddings").select(F.col("vec_id").alias("file"), F.posexplode(F.reverse("embedding") if turned else F.col("embedding")).alias("i", "v"))
    return p.select("file", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


def shapes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("file"), F.lit(8).alias("width"), F.lit(8).alias("height"))


@query("WITH " + OUTLINE.format("1 + py * 8 + px"))
def g25_intensity_profile(s, d):
    out = P.intensity_profile(S.contour_text(outline_text(s, d).withColumnRenamed("text", "value")), shapes(s, d), image_pixels(s, d), 5)
    return out.select("file", "segment", r("mean").alias("mean"), r("sd").alias("sd"), "n")


@query("WITH " + OUTLINE.format("64 - py * 8 - px"))
def g25_second_channel(s, d):
    outlines = S.contour_text(outline_text(s, d).withColumnRenamed("text", "value"))
    out = P.intensity_profile(outlines, shapes(s, d), image_pixels(s, d), 5, image_pixels(s, d, turned=True), shapes(s, d))
    return out.select("file", "segment", r("mean").alias("mean"), r("sd").alias("sd"), "n")


# --- detections -------------------------------------------------------------------------------------------------------------

IOU = "greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


@query(f"""WITH RECURSIVE {BOXES}, c AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(x1) * 2 DESC, x1, y1, vec_id) AS k FROM b WHERE abs(x1) * 2 >= 0.05),
g AS (SELECT DISTINCT label, 0::BIGINT AS k, []::STRUCT(vec_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM c UNION ALL
 SELECT g.label, c.k, CASE WHEN len(list_filter(g.kept, lambda z: {IOU.format(a="z", b="c")} / ((z.x2 - z.x1) * (z.y2 - z.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - {IOU.format(a="z", b="c")}) > 0.2)) > 0 THEN g.kept
  ELSE list_append(g.kept, {{'vec_id': c.vec_id, 'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2}}) END FROM g JOIN c ON c.label = g.label AND c.k = g.k + 1)
SELECT label, unnest([z.vec_id FOR z IN kept]) AS vec_id FROM (SELECT label, kept FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1)""")
def f1_suppress_boxes(s, d):
    b = boxes(s, d).withColumn("conf", F.abs(F.col("x1")) * 2)
    return D.suppress(b, "label", "vec_id", 0.2, 0.05, cell=0.25).select("label", "vec_id")


DETECTED = BOXES + """, o AS (SELECT label, vec_id // 8 AS image, vec_id AS id, x1, y1, x2, y2, CAST(embedding[5] AS DOUBLE) AS dx, CAST(embedding[6] AS DOUBLE) AS dy, CAST(embedding[7] AS DOUBLE) AS c1, CAST(embedding[8] AS DOUBLE) AS c2 FROM b JOIN embeddings USING (vec_id, label)),
t AS (SELECT label AS class, image, id, x1, y1, x2, y2 FROM o WHERE id % 5 <> 0),
p AS (SELECT CASE WHEN id % 11 = 0 THEN (label + 1) % 10 ELSE label END AS class, image, id, abs(c1) AS conf, x1 + dx * (x2 - x1) AS x1, y1 + dy * (y2 - y1) AS y1, x2 + dx * (x2 - x1) AS x2, y2 + dy * (y2 - y1) AS y2 FROM o WHERE id % 7 <> 0
 UNION ALL SELECT label, image, id + 1000000, abs(c2), x1 + dy * (x2 - x1), y1, x2 + dy * (x2 - x1), y2 FROM o WHERE id % 3 = 0)"""
BOX_PAIRS = DETECTED + f""", i AS (SELECT class, image, p.id AS a, t.id AS b, conf, {IOU.format(a="p", b="t")} AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s FROM p JOIN t USING (class, image)),
pr AS (SELECT class, image, a, b, conf, i / (s - i) AS iou FROM i WHERE i > 0)"""
MASK_PAIRS = DETECTED + """, mk AS (SELECT vec_id, [CASE WHEN v > 0 THEN 1 ELSE 0 END FOR v IN embedding] AS t, [CASE WHEN v > 0.05 THEN 1 ELSE 0 END FOR v IN embedding] AS p FROM embeddings),
pr AS (SELECT class, image, p.id AS a, t.id AS b, conf, list_sum([x.p[k] * y.t[k] FOR k IN range(1, 65)]) / (list_sum(x.p) + list_sum(y.t) - list_sum([x.p[k] * y.t[k] FOR k IN range(1, 65)])) AS iou
 FROM p JOIN t USING (class, image) JOIN mk x ON x.vec_id = p.id % 1000000 JOIN mk y ON y.vec_id = t.id)"""
PRECISION = """, lim AS (SELECT round(0.5 + 0.05 * k, 2) AS lim FROM range(10) q(k)),
best AS (SELECT class, image, a, conf, arg_max(b, (iou, -b)) AS b, max(iou) AS iou FROM pr GROUP BY ALL),
kept AS (SELECT class, image, b, lim, arg_max(a, (conf, -a)) AS id FROM best, lim WHERE iou >= lim GROUP BY class, image, b, lim),
rk AS (SELECT class, image, id, row_number() OVER (PARTITION BY class ORDER BY conf DESC, image, id) AS pos FROM p),
h AS (SELECT class, lim, pos, row_number() OVER (PARTITION BY class, lim ORDER BY pos) AS tp FROM kept JOIN rk USING (class, image, id)),
en AS (SELECT *, max(tp / pos) OVER (PARTITION BY class, lim ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM h),
nt AS (SELECT class, count(*) AS truths FROM t GROUP BY 1), np AS (SELECT class, count(*) AS predictions FROM p GROUP BY 1),
ar AS (SELECT class, lim, count(*) AS found, sum(env * (floor(tp * 100 / truths) - floor((tp - 1) * 100 / truths) + CASE WHEN tp = 1 THEN 1 ELSE 0 END)) / 101 AS ap FROM en JOIN nt USING (class) GROUP BY 1, 2),
ap AS (SELECT class, CAST(lim AS DOUBLE) AS "limit", coalesce(truths, 0) AS truths, coalesce(predictions, 0) AS predictions, coalesce(found, 0) AS found, CASE WHEN truths > 0 THEN coalesce(ap, 0.0) END AS ap
 FROM (nt FULL JOIN np USING (class)) CROSS JOIN lim LEFT JOIN ar USING (class, lim))"""


def detected(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Predictions and truths: each box moved by a part of its size, some twice, some under another class, some not at all."""
    b = boxes(s, d).join(table(s, d, "embeddings").select("vec_id", *(e(k).alias(n) for k, n in ((4, "dx"), (5, "dy"), (6, "c1"), (7, "c2")))), "vec_id")
    b = b.withColumn("image", F.floor(F.col("vec_id") / 8))
    i, w, h = F.col("vec_id"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    truth = b.filter(i % 5 != 0).select(F.col("label").alias("class"), "image", i.alias("id"), *X.BOX)
    one = b.filter(i % 7 != 0).select(
        F.when(i % 11 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("class"), "image", i.alias("id"), F.abs("c1").alias("conf"),
        *((F.col(c) + F.col(by) * side).alias(c) for c, by, side in (("x1", "dx", w), ("y1", "dy", h), ("x2", "dx", w), ("y2", "dy", h))),
    )
    two = b.filter(i % 3 == 0).select(F.col("label").alias("class"), "image", (i + 1_000_000).alias("id"), F.abs("c2").alias("conf"), (F.col("x1") + F.col("dy") * w).alias("x1"), "y1", (F.col("x2") + F.col("dy") * w).alias("x2"), "y2")
    return one.union(two), truth


def box_precision(s: SparkSession, d: str) -> DataFrame:
    p, t = detected(s, d)
    key = F.concat_ws(":", "class", "image")
    pairs = X.with_box_iou(X.candidates(p.withColumn("key", key), t.withColumn("key", key), "key", "id", "id")).filter("iou > 0")
    part = F.split("key", ":")
    pairs = pairs.select(part[0].cast("int").alias("class"), part[1].cast("long").alias("image"), "a", "b", "iou")
    return D.average_precision(p.select("class", "image", "id", "conf"), t.select("class", "image", "id"), pairs)


def mask_precision(s: SparkSession, d: str) -> DataFrame:
    """Masks of the truths against those of the predictions, which are smaller."""
    p, t = detected(s, d)
    of = lambda x, least: x.select("class", "image", F.col("id").alias("own")).join(Q.from_pixels(grid(s, d, least), ["id"]), F.col("own") % 1_000_000 == F.col("id")).select(F.struct("class", "image").alias("key"), F.col("own").alias("id"), "y", "x1", "x2")
    pairs = p.select(F.struct("class", "image").alias("key"), F.col("id").alias("a")).join(t.select(F.struct("class", "image").alias("key"), F.col("id").alias("b")), "key")
    pairs = Q.mask_iou(pairs, of(p, 0.05), of(t, 0.0), "key").select("key.class", "key.image", "a", "b", "iou")
    return D.average_precision(p.select("class", "image", "id", "conf"), t.select("class", "image", "id"), pairs)


@query(f'WITH {BOX_PAIRS}{PRECISION} SELECT class, "limit", truths, predictions, found, round(ap, 8) AS ap FROM ap')
def a44_box_precision(s, d):
    return box_precision(s, d).withColumn("ap", r("ap", 8))


SUMMARY = 'pc AS (SELECT class, max(CASE WHEN "limit" = 0.5 THEN ap END) AS ap50, avg(ap) AS ap50_95 FROM ap GROUP BY 1) SELECT class, round(ap50, 8) AS ap50, round(ap50_95, 8) AS ap50_95 FROM pc UNION ALL SELECT NULL, round(avg(ap50), 8), round(avg(ap50_95), 8) FROM pc'


@query(f"WITH {BOX_PAIRS}{PRECISION}, {SUMMARY}")
def a44_box_summary(s, d):
    return D.summary(box_precision(s, d)).select("class", r("ap50", 8).alias("ap50"), r("ap50_95", 8).alias("ap50_95"))


@query(f"WITH {MASK_PAIRS}{PRECISION}, {SUMMARY}")
def a44_mask_summary(s, d):
    return D.summary(mask_precision(s, d)).select("class", r("ap50", 8).alias("ap50"), r("ap50_95", 8).alias("ap50_95"))
