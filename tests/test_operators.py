"""Operators of the library on small frames with answers worked out by hand, and properties."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.functions import geometry as G
from metrika.functions import measures as M
from metrika.functions import names as N
from metrika.operators import curation as C
from metrika.operators import inference as I
from metrika.operators import kernels as K
from metrika.operators import matching as X
from metrika.operators import ranking as R
from metrika.operators import tables as T
from metrika.plans import measure
from metrika.sources import files as S
from metrika.sources import sinks


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


# --- expressions ------------------------------------------------------------------------------------------------------


def test_name_metadata(spark):
    m = N.metadata(F.lit("20200101-exp-p1-4x_A01_roi_3.png"))
    assert [one(spark, m[k]) for k in ("date", "experiment", "plate", "magnification", "well", "object_id")] == ["20200101", "exp", "p1", "4x", "A01", "3"]
    for bad in ("nothing.png", "a-b-c_A01_roi_3.png", "20200101-exp-p1-4x_roi_3.png"):
        assert {one(spark, v) for v in N.metadata(F.lit(bad)).values()} == {"NA"}


def test_name_helpers(spark):
    assert one(spark, N.source_stem(F.lit("a_roi_b_roi_12.PNG"))) == "a_roi_b"
    assert one(spark, N.roi_prefix(F.lit("no marker.png"))) == "no marker.png"
    assert one(spark, N.species_key(F.lit("Img 3_overlay copy.TIF"))) == "img 3"
    assert one(spark, N.hosted_name(F.lit("a_b_png.rf.12ab.jpg"))) == "a_b.png"
    assert one(spark, N.image_number(F.lit("x12_jpg_34_png"))) == "34" and one(spark, N.image_number(F.lit("x"))) is None
    assert one(spark, N.label_text(F.lit("curly_worm_tiny"))) == "Curly tiny"
    assert one(spark, N.is_augmented(F.lit("a_aug_12.png"))) and not one(spark, N.is_augmented(F.lit("a_aug_1234.png")))
    assert one(spark, N.well_name(F.lit(95))) == "H12"
    assert one(spark, N.ranked_name(F.lit(3), F.lit(-2.5), F.lit("c"), F.lit("f.png"))) == "rank03_abs002.500pct_neg_c_f.png"


def test_measures(spark):
    assert one(spark, M.percent_difference(F.lit(11.0), F.lit(10.0))) == pytest.approx(10) and one(spark, M.percent_difference(F.lit(1.0), F.lit(0.0))) is None
    assert [one(spark, M.number(F.lit(v))) for v in ("1.5", "abc", "NaN", "inf")] == [1.5, None, None, None]
    assert [one(spark, M.flagged(F.lit(v), F.lit(None).cast("string"))) for v in (" None", "0", "x", "")] == [False, False, True, False]
    assert [one(spark, M.stars(F.lit(p))) for p in (0.2, 0.04, 0.001, 0.0005, 0.00001)] == ["ns", "*", "**", "***", "****"]
    assert one(spark, M.micrometres(F.lit(10.0), F.lit(2.0))) == pytest.approx(5 * 3.2937)
    assert one(spark, M.micrometres(F.lit(10.0), F.lit(0.0), strict=True)) is None
    assert one(spark, M.scientific(F.lit(0.00123), F.lit(0.1))) == "1.23e-03 ± 1.00e-01"


def test_safe_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, None)], "g string, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(M.correlation(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["a"] == pytest.approx(1) and got["b"] is None and got["c"] is None


def line(*pts):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts))


def test_polylines(spark):
    p = line((0, 0), (3, 4), (3, 5))
    assert one(spark, G.arc_length(p)) == 6 and one(spark, G.arc_length(line((1, 1)))) == 0
    assert one(spark, G.body_length(p, F.array(F.lit(True), F.lit(True), F.lit(False)))) == 5
    assert [one(spark, G.arc_index(p, F.lit(v))) for v in (0.0, 5.0, 5.5, 9.0)] == [0, 1, 2, 2]
    assert one(spark, G.arc_index(p, F.lit(1.0), from_end=True)) == 1
    assert [r["x"] for r in one(spark, G.resample(p, 2))] == [0.0, 3.0] and len(one(spark, G.resample(p, 1))) == 1
    assert one(spark, G.shoelace(line((0, 0), (2, 0), (2, 2), (0, 2)))) == 4
    sq = line((0, 0), (2, 0), (2, 2), (0, 2))
    assert one(spark, G.contains(sq, F.lit(1.0), F.lit(1.0))) and not one(spark, G.contains(sq, F.lit(3.0), F.lit(1.0)))
    assert one(spark, G.meets_roi(sq, F.lit(0.5), F.lit(0.5), F.lit(0.6), F.lit(0.6))) and not one(spark, G.meets_roi(sq, F.lit(5.0), F.lit(5.0), F.lit(6.0), F.lit(6.0)))
    assert len(one(spark, G.without_repeats(line((0, 0), (0, 1e-7), (0, 2e-7), (1, 0), (0, 0))))) == 3
    assert one(spark, G.rle_pixels(F.array(F.lit(2), F.lit(1), F.lit(1)))) == [0, 0, 1, 0]


def test_boxes(spark):
    b = lambda *v: tuple(F.lit(float(x)) for x in v)
    assert one(spark, G.overlap(b(0, 0, 1, 1), b(1, 1, 2, 2))) and not one(spark, G.overlap(b(0, 0, 1, 1), b(1.1, 0, 2, 2)))
    assert not one(spark, G.overlap((F.lit(None).cast("double"), *b(0, 1, 1)), b(0, 0, 1, 1)))
    assert one(spark, G.box_iou(b(0, 0, 2, 2), b(1, 1, 3, 3))) == pytest.approx(1 / 7) and one(spark, G.box_iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == 0
    r = random.Random(1)
    for _ in range(5):
        p, q = ([x, y, x + r.random(), y + r.random()] for x, y in ((r.random(), r.random()), (r.random(), r.random())))
        x, y = one(spark, G.box_iou(b(*p), b(*q))), one(spark, G.box_iou(b(*q), b(*p)))
        assert x == pytest.approx(y) and 0 <= x <= 1


# --- tables -----------------------------------------------------------------------------------------------------------


def test_lookups_and_errors(spark):
    df = spark.createDataFrame([("a",), ("B",), ("z",)], "k string")
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k2 string, v int")
    assert {r.k: r.o for r in T.two_stage_lookup(df, "k", t, "k2", "v", "o").collect()} == {"a": 1, "B": 2, "z": None}
    with pytest.raises(Exception, match="no match"):
        T.known_or_error(T.lookup(df, "k", t, "k2", "v", "o"), "o", "map").collect()
    with pytest.raises(Exception, match="duplicate key"):
        T.unique_or_error(spark.createDataFrame([(1,), (1,)], "k int"), ["k"], "t").collect()
    first = spark.createDataFrame([("x", 2, "l"), ("x", 1, "f"), ("y", 5, "o")], "k string, n int, v string")
    assert {r.k: r.v for r in T.keep_first(first, ["k"], ["n"]).collect()} == {"x": "f", "y": "o"}


def test_taxonomy(spark):
    from metrika.operators import taxonomy as Y

    assert len(Y.CLASSES) == 16 and Y.axes_of("self-overlapping_tiny_worm") == {"size": "tiny", "completeness": "complete", "occlusion": "self-overlapping"}
    assert Y.axes_of("incomplete_curly_worm") == {"curvature": "curly", "size": "normal", "completeness": "incomplete", "occlusion": "isolated"}
    assert [Y.bucket_of(c)[1] for c in ("incomplete_tiny_worm", "tiny_bent_worm", "tiny_worm")] == ["Overlapping", "Bent or curly", "Straight and isolated"]
    # Groups of the axes and buckets.
    of = lambda axis, group: {c for c in Y.CLASSES if Y.axes_of(c).get(axis) == group}
    assert of("curvature", "bent") == {"bent_worm", "tiny_bent_worm"} and of("curvature", "straight") == {"straight_worm"}
    assert of("curvature", "curly") == {"curly_worm", "curly_tiny_worm", "incomplete_curly_worm", "overlapping_curly_worm", "overlapping_curly_tiny_worm"}
    assert of("completeness", "incomplete") == {"incomplete_worm", "incomplete_curly_worm", "incomplete_tiny_worm", "overlapping_incomplete_worm"}
    assert of("occlusion", "self-overlapping") == {"self-overlapping_worm", "self-overlapping_tiny_worm"}
    assert of("size", "tiny") == {"tiny_worm", "tiny_bent_worm", "curly_tiny_worm", "incomplete_tiny_worm", "overlapping_tiny_worm", "overlapping_curly_tiny_worm", "self-overlapping_tiny_worm"}
    assert {c for c in Y.CLASSES if Y.bucket_of(c)[1] == "Bent or curly"} == {"bent_worm", "tiny_bent_worm", "curly_worm", "curly_tiny_worm"}
    df = spark.createDataFrame([(c,) for c in Y.CLASSES], "category string")
    first = T.relabel(df, "category", Y.merge_map(spark))
    assert first.select("category").distinct().count() == 13 and T.relabel(first, "category", Y.merge_map(spark, later=True)).select("category").distinct().count() == 8
    assert T.on_axes(df, "category", Y.axes(spark)).groupBy("axis").count().filter("axis <> 'curvature'").agg(F.min("count")).first()[0] == 16
    assert T.bucket(df, "category", Y.buckets(spark)).count() == 16


def test_box_stats_and_total(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    got = {r.g: r for r in T.box_stats(df, "g", "v", "all").collect()}
    assert (got["a"].mean, got["a"].median, got["a"].sd) == (2.0, 2.0, pytest.approx(math.sqrt(2))) and got["b"].sd == 0 and got["all"].n == 3


def test_split_is_exact(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    got = {r["split"]: r["count"] for r in T.split(df, "k", 0.8).groupBy("split").count().collect()}
    assert got == {"train": 82, "valid": 21}
    first = {r.k for r in T.split(df, "k", 0.8).filter("split = 'train'").collect()}
    assert first == {r.k for r in T.split(df.repartition(5), "k", 0.8).filter("split = 'train'").collect()}


def test_profile_and_histogram(spark):
    df = spark.createDataFrame([("f", 0, 1.0), ("f", 0, 3.0), ("f", 2, 5.0)], "f string, s int, v double")
    assert [(r.s, r["mean"], r.sd, r.n) for r in T.profile(df, "f", "s", "v", 3).orderBy("s").collect()] == [(0, 2.0, 1.0, 2), (1, None, None, 0), (2, 5.0, 0.0, 1)]
    assert sum(r.n for r in T.histogram(df, "v").collect()) == 3 and T.histogram(df.filter("v = 1"), "v").first().n == 1


# --- inference --------------------------------------------------------------------------------------------------------


def test_distributions():
    assert I.f_tail(4.0, 2, 10) == pytest.approx(0.05279, abs=2e-4)
    assert I.t_two_sided(2.0, 10) == pytest.approx(0.07339, abs=1e-4)
    for q, k, df, p in ((3.877, 3, 10, 0.05), (3.773, 3, 12, 0.05), (3.314, 3, 10**6, 0.05), (5.270, 3, 10, 0.01)):
        assert I.studentized_tail(q, k, df) == pytest.approx(p, abs=6e-4)
    assert I.exact_u_two_sided(0, 3, 3) == pytest.approx(0.1) and I.exact_u_two_sided(4.0, 3, 3) == pytest.approx(1.0, abs=0.3)


def test_rank_sum_symmetry(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(g, float(r.randint(0, 20))) for g in "ab" for _ in range(40)], "g string, v double")
    a, b = I.rank_sum(df, "g", "v", "a", "b").first(), I.rank_sum(df, "g", "v", "b", "a").first()
    assert a.u1 + b.u1 == a.n1 * a.n2 and a.p == pytest.approx(b.p)


def test_anova_of_equal_and_different_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("c", 1.0), ("c", 2.0)], "g string, v double")
    r = I.anova(df, "g", "v").first()
    assert r.f == pytest.approx(0) and r.p == pytest.approx(1)
    r = I.anova(df.withColumn("v", F.when(F.col("g") == "c", F.col("v") + 100).otherwise(F.col("v"))), "g", "v").first()
    assert r.p < 1e-3


def test_dose_response_finds_the_curve(spark):
    rng, rows = np.random.default_rng(5), []
    for s, b, e in (("x", 0.8, 0.002), ("y", 1.4, 0.01)):
        for dose in (0.0, 0.0003, 0.001, 0.003, 0.01, 0.03, 0.1):
            rows += [(s, dose, float(I.ll4(np.array([dose]), b, 0.08, 1.0, e)[0] + rng.normal(0, 0.005))) for _ in range(8)]
    got = {r.strain: r for r in I.dose_response(spark.createDataFrame(rows, "strain string, dose double, v double"), "strain", "dose", "v", 0.08).collect()}
    for s, b, e in (("x", 0.8, 0.002), ("y", 1.4, 0.01)):
        r = got[s]
        assert r.b == pytest.approx(b, rel=0.1) and r.EC50 == pytest.approx(e, rel=0.1) and r.d_shared == pytest.approx(1, abs=0.02)
        assert r.EC10 == pytest.approx(r.EC50 * 9 ** (-1 / r.b)) and r.EC90 == pytest.approx(r.EC50 * 9 ** (1 / r.b))


def test_dose_response_leaves_open_what_the_data_leave_open(spark):
    """A strain without a response, and one with a single dose, have no half-way dose; the other is as good as alone."""
    rng, doses = np.random.default_rng(7), (0.0, 0.001, 0.003, 0.01, 0.03, 0.1)
    rows = [("good", x, float(I.ll4(np.array([x]), 1.2, 0.1, 1.0, 0.01)[0] if x else 1.0) + rng.normal(0, 0.002)) for x in doses for _ in range(6)]
    rows += [("flat", x, 1.0) for x in doses for _ in range(6)] + [("lone", 0.0, 1.0)] * 3
    got = {r.strain: r for r in I.dose_response(spark.createDataFrame(rows, "strain string, dose double, v double"), "strain", "dose", "v", 0.1).collect()}
    assert got["good"].status == "ok" and got["good"].EC50 == pytest.approx(0.01, rel=0.1)
    for s in ("flat", "lone"):
        assert got[s].status == "not settled" and got[s].EC50 is None and got[s].b is None and got[s].EC90_se is None
    finite = [v for r in got.values() for v in r if isinstance(v, float)]
    assert all(math.isfinite(v) and abs(v) < 1e6 for v in finite)


def test_dose_response_of_rising_and_steep_curves(spark):
    """Slopes have no bounds; estimates do not depend on the direction of the curve."""
    doses = (0.0, 0.001, 0.002, 0.004, 0.006, 0.01, 0.02, 0.04)
    curves = (("steep", 6.0, 0.005), ("rising", -1.5, 0.004))
    rows = [(s, x, float(I.ll4(np.array([x]), b, 0.2, 1.0, e)[0]) if x else (1.0 if b > 0 else 0.2)) for s, b, e in curves for x in doses]
    got = {r.strain: r for r in I.dose_response(spark.createDataFrame(rows, "strain string, dose double, v double"), "strain", "dose", "v", 0.2).collect()}
    for s, b, e in curves:
        assert got[s].b == pytest.approx(b, rel=0.02) and got[s].EC50 == pytest.approx(e, rel=0.02)


def test_positions_and_ids(spark):
    df = spark.createDataFrame([(i * 7 % 100,) for i in range(100)], "k int").repartition(7)
    assert sorted((r.k, r.at) for r in R.numbered(df, "k", "at").collect()) == [(i, i + 1) for i in range(100)]
    assert {(r.k, r.new_id) for r in T.new_ids(df, "k", 1000).collect()} == {(i, 1001 + i) for i in range(100)}
    assert R.numbered(df.limit(0), "k", "at").count() == 0


def test_nearest_anchor_of_the_same_image(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 9.0, 9.0), ("b", 0.0, 0.0), ("c", 1.0, 1.0)], "image string, x double, y double")
    anchors = spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, -1.0, 0.0), ("a", 3, 8.0, 8.0), ("b", 4, 50.0, 50.0)], "image string, anchor int, ax double, ay double")
    got = {(r.image, r.x): r.anchor for r in X.nearest_anchor(points, anchors, "image").collect()}
    assert got == {("a", 0.0): 1, ("a", 9.0): 3, ("b", 0.0): 4, ("c", 1.0): None}


# --- matching ---------------------------------------------------------------------------------------------------------


def test_candidates_by_cell_are_the_same(spark):
    r = random.Random(4)
    rows = lambda: [("k", i, x := r.uniform(-3, 3), y := r.uniform(-3, 3), x + r.random(), y + r.random()) for i in range(80)]
    a, b = (spark.createDataFrame(rows(), "k string, id int, x1 double, y1 double, x2 double, y2 double") for _ in "ab")
    plain, cells = ({(p.a, p.b) for p in X.candidates(a, b, "k", "id", "id", c).collect()} for c in (None, 0.7))
    assert plain == cells and plain


# --- kernels ----------------------------------------------------------------------------------------------------------


def bar(h=40, w=120, y=18, thick=5, x1=10, x2=110):
    m = np.zeros((h, w), bool)
    m[y : y + thick, x1:x2] = True
    return m


def ring(n=80, r=25, thick=3):
    y, x = np.mgrid[0:n, 0:n]
    d = np.hypot(x - n / 2, y - n / 2)
    return np.abs(d - r) <= thick


def test_components_and_holes():
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[5, 5] = True
    assert K.label(m)[1] == 2 and K.label(m, eight=False)[1] == 3
    r = ring()
    assert K.fill_holes(r).sum() > r.sum() and K.is_ring(r, 3, 0.5) and not K.is_ring(bar(), 3, 0.5)


def test_distance_is_exact():
    rng = np.random.default_rng(1)
    m = rng.random((12, 15)) > 0.3
    big = np.pad(m, 1)
    zeros = np.argwhere(~big)
    want = np.array([[np.hypot(*(zeros - (r + 1, c + 1)).T).min() if m[r, c] else 0 for c in range(15)] for r in range(12)])
    assert np.allclose(K.distance(m), want)


def test_centerline_of_a_bar_and_a_ring():
    line_, width, kind = K.centerline(bar())
    length = np.hypot(*np.diff(line_, axis=0).T).sum()
    assert kind == "line" and 90 <= length <= 100 and 3 <= np.median(width) <= 7
    line_, _, kind = K.centerline(ring())
    length = np.hypot(*np.diff(line_, axis=0).T).sum()
    assert kind == "ring" and length == pytest.approx(2 * math.pi * 25, rel=0.1)
    assert K.centerline(np.zeros((5, 5), bool))[2] == "none"


def test_stitch_joins_and_falls_back():
    a, b = (np.column_stack([np.zeros(20), np.arange(x, x + 20)]).astype(float) for x in (0, 30))
    line_, used, failed = K.stitch([a, b[::-1]])
    assert sorted(used) == [0, 1] and failed == "" and np.hypot(*np.diff(line_, axis=0).T).sum() == pytest.approx(49)
    far = b + np.array([0, 500])
    line_, used, failed = K.stitch([a, far])
    assert used == [0] and "distance" in failed
    assert K.stitch([])[2] == "no fragments"


def test_stitch_of_seven_and_against_all_orders():
    line_ = [np.column_stack([np.zeros(12), np.arange(x, x + 12)]).astype(float) for x in range(0, 140, 20)]
    order = [3, 0, 6, 2, 5, 1, 4]
    points, used, failed = K.stitch([line_[k][::-1] if k % 2 else line_[k] for k in order])
    assert failed == "" and [order[k] for k in used] in ([*range(7)], [*range(6, -1, -1)]) and len(points) == 7 * 12 + 6 * 12
    rng = np.random.default_rng(9)
    for _ in range(20):
        frags = [np.cumsum(rng.normal(0, 3, (15, 2)), axis=0) + rng.normal(0, 40, 2) for _ in range(4)]
        least = min(
            sum(K.gap_cost(a, b, 110, 110) for a, b in itertools.pairwise([frags[i][::-1] if f else frags[i] for i, f in zip(o, flips, strict=True)]))
            for o in itertools.permutations(range(4)) for flips in itertools.product((0, 1), repeat=4)
        )
        cost = K.cheapest_chains(frags, 110, 110).get(15, (math.inf,))[0]
        assert cost == pytest.approx(least) or cost == least


def test_tangled_skeletons():
    grid = [(a, b) for a in range(25) for b in range(25) if b - a in (1, 5) and (b % 5 or b - a == 5)]
    edges = [(a, b, [(a // 5 * 9, a % 5 * 9), (b // 5 * 9, b % 5 * 9)]) for a, b in grid]
    with pytest.raises(K.Tangled):
        K.longest_path(edges, most=1000)
    forest = K.break_cycles(edges)
    assert len(forest) == 24 and len(K.longest_path(forest, most=1)) > 5
    ring_ = [(0, 0), (0, 5), (5, 5), (5, 0), (0, 0)]
    width = np.full((6, 6), 4.0)
    width[5, 5] = 1
    assert K.turned_ring(ring_, width) == [(5, 5), (5, 0), (0, 0), (0, 5)]


def test_contours_and_rasters():
    m = bar()
    c = K.contour(m)
    assert len(c) == 2 * (100 + 5) - 4 and all(m[p] for p in c)
    assert K.rasterize([(0.5, 0.5), (4.5, 0.5), (4.5, 3.5), (0.5, 3.5)], 6, 6).sum() == 12
    assert K.paste(np.ones((4, 4), bool), -2, -2, 4, 10, 10).sum() == 4 * 255
    assert K.nearest_resize(np.eye(2, dtype=bool), 4, 4).sum() == 8


def test_measure_keeps_every_image(spark):
    good = bar(64, 64, 30, 5, 5, 60).astype(float)
    df = spark.createDataFrame([("20200101-e-p-4x_A01_roi_1.png", good.ravel().tolist(), 64, 64), ("empty.png", [0.0] * 64, 8, 8), ("broken.png", [1.0], 8, 8)], "path string, pixels array<double>, height int, width int")
    m = measure.measure(df, measure.ThresholdPredictor)
    got = {r.path: r for r in m.collect()}
    assert got["empty.png"].status == "nothing found" and got["broken.png"].status.startswith("failed") and 45 <= got["20200101-e-p-4x_A01_roi_1.png"].length_px <= 56
    assert measure.run_counts(m).first().asDict() == {"total": 3, "measured": 1, "empty": 1, "timed_out": 0, "failed": 1}
    late = measure.measure(df, measure.ThresholdPredictor, limit_s=-1).filter("path like '2020%'").first()
    assert late.status == "TIMEOUT"
    rows = {r.Filename: r for r in measure.measurement_rows(m).collect()}
    assert rows["20200101-e-p-4x_A01_roi_1.png"].Metadata_Well == "A01" and rows["empty.png"].Length_um is None
    det = {r.path: r for r in measure.detect(df, measure.ThresholdPredictor).collect()}
    assert det["broken.png"].status.startswith("failed") and (det["20200101-e-p-4x_A01_roi_1.png"].x1, det["20200101-e-p-4x_A01_roi_1.png"].x2) == (5.0, 60.0)


# --- curation and files -----------------------------------------------------------------------------------------------


def test_dataset(spark, tmp_path):
    doc = '{"images": [{"id": 1, "width": 10, "height": 10, "file_name": "a.png"}, {"id": 2, "width": 10, "height": 10, "file_name": "b_aug_1.png"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 3, "bbox": [0, 0, 2, 2], "area": 4.0, "segmentation": "x"}, {"id": 2, "image_id": 2, "category_id": 4, "bbox": [0, 0, 1, 1], "area": 1.0, "segmentation": "x"}], "categories": [{"id": 3, "name": "c"}]}'
    (tmp_path / "coco.json").write_text(doc)
    ds = C.Dataset.from_coco(S.coco(spark, str(tmp_path / "coco.json")))
    assert {r.kind: r.n for r in ds.verify().collect()} == {"no image": 0, "no category": 1, "repeated id": 0}
    assert [r.file_name for r in ds.remove_augmented().images.collect()] == ["a.png"] and ds.remove_augmented().annotations.count() == 1
    assert {r.category_id for r in ds.flatten().annotations.collect()} == {0}
    a, b = ds.split(0.5)
    assert a.images.count() == b.images.count() == 1 and a.annotations.count() == 1


def test_folders_and_lists(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "c.txt", "d.tif"):
        (tmp_path / "raw").mkdir(exist_ok=True)
        (tmp_path / "raw" / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in S.image_files(spark, str(tmp_path / "raw")).collect()] == ["a.jpg", "b.PNG", "d.tif"]
    assert S.short_image_files(spark, str(tmp_path / "raw")).count() == 2
    with pytest.raises(FileNotFoundError):
        S.inputs(spark, str(tmp_path))
    (tmp_path / "batch_1.txt").write_text(" /x/a.png \n\n/x/b.doc\n")
    assert [r.path for r in S.inputs(spark, str(tmp_path)).collect()] == ["/x/a.png"]
    assert S.folders(spark, str(tmp_path)) == ["raw"]
    with pytest.raises(FileNotFoundError):
        S.folders(spark, str(tmp_path / "gone"))
    assert S.roi_catalog(spark, str(tmp_path / "gone.json")).count() == 0
    assert S.first_there(spark, str(tmp_path / "no"), str(tmp_path / "raw")) == str(tmp_path / "raw") and S.data_set_format(spark, str(tmp_path)) == "unknown"
    with pytest.raises(FileNotFoundError):
        S.checked_splits(spark, str(tmp_path))


def test_specifications():
    assert S.class_names({"names": {0: "a", 2: "c"}}) == ["a", "class_1", "c"] and S.class_names({"nc": 2}) == ["class_0", "class_1"]
    assert S.broadcast_runs(a=[1, 2], b="x") == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    with pytest.raises(ValueError):
        S.broadcast_runs(a=[1, 2], b=[1, 2, 3])
    assert "nc: 2" in sinks.data_yaml(["a", "b"])


def test_measurement_csv_round_trip(spark, tmp_path):
    rows = [("f_roi_1.png", "d", "e", "p", "m", "w", "1", 1.5, float("nan"), "")]
    from metrika import schemas

    sinks.measurement_csv(spark.createDataFrame(rows, schemas.MEASUREMENTS), str(tmp_path / "cat" / "out"))
    back = S.measurements(spark, str(tmp_path / "cat" / "out")).first()
    assert back.Length_um == 1.5 and back.Width_um is None and back.category == "out"
    df = spark.createDataFrame([("1", " "), ("x", "2")], "Length_um string, width_um string")
    assert [tuple(r) for r in S.sized_measurements(df).select("length_um", "width_um").collect()] == [(1.0, None), (None, 2.0)]
    with pytest.raises(KeyError):
        S.external_tool(df)


def test_sizes_that_are_doubles_never_become_text(spark):
    rows = [(1.5, 2.0), (float("nan"), float("-inf")), (None, 0.1), (1e-320, -0.0)]
    x = S.sized_measurements(spark.createDataFrame(rows, "Length_um double, Width_um double")).select("length_um", "width_um")
    assert [tuple(r) for r in x.collect()] == [(1.5, 2.0), (None, None), (None, 0.1), (1e-320, 0.0)]
    assert "string" not in x._jdf.queryExecution().optimizedPlan().toString()


def test_stream(spark, tmp_path):
    from metrika.streaming import incremental as St

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, 'e' as k, 1.0D as v from range(10)").write.parquet(src)
    stream = St.arriving(spark, src, "ts timestamp, k string, v double")
    for _ in range(2):
        St.drain(St.windowed(stream, "ts", "1 minute", "2 minutes", "k", "v"), str(tmp_path / "cp"), lambda df, i: df.write.mode("append").parquet(out))
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [2, 2, 2, 2]


def test_label_numbers_components_in_row_order():
    r = np.random.default_rng(5)

    def plain(mask, eight):
        out, n = np.zeros(mask.shape, int), 0
        for at in zip(*np.nonzero(mask), strict=True):
            if not out[at]:
                n, todo = n + 1, [at]
                while todo:
                    y, x = todo.pop()
                    if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                        out[y, x] = n
                        todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if eight or not a or not b]
        return out, n

    for _ in range(200):
        m = r.random(r.integers(1, 12, 2)) < r.random()
        for eight in (True, False):
            want, got = plain(m, eight), K.label(m, eight)
            assert want[1] == got[1] and (want[0] == got[0]).all()


def test_pictures_are_dealt_over_all_cores(spark):
    from metrika.plans import objects

    assert objects.images(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
