"""Run-length masks, arc-length resampling, profiles, suppression and average precision against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.operators import detection as D
from metrika.operators import matching as X
from metrika.operators import profiles as P
from metrika.operators import runs as Q

POLY = "id long, polygon array<struct<x:double,y:double>>"


def even_odd(poly, x, y):
    hits = 0
    for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1], strict=True):
        if (ay > y) != (by > y):
            hits += x < (bx - ax) * (y - ay) / (by - ay) + ax
    return hits % 2 == 1


def lit(rows):
    return {(r["id"], x, r["y"]) for r in rows for x in range(r["x1"], r["x2"] + 1)}


# --- runs -------------------------------------------------------------------------------------------------------------


def test_polygons_against_every_pixel(spark):
    r, polys = random.Random(1), {}
    for i in range(60):
        k = r.choice([3, 4, 7, 12])
        whole = r.random() < 0.4  # vertices on pixels, level edges, repeated points
        polys[i] = [(float(r.randint(-4, 24)), float(r.randint(-4, 24))) if whole else (r.uniform(-4, 24), r.uniform(-4, 24)) for _ in range(k)]
    polys |= {100: [(0.0, 0.0), (5.0, 5.0)], 101: [], 102: [(2.0, 3.0)] * 4, 103: [(0.0, 0.0), (19.0, 0.0), (19.0, 17.0), (0.0, 17.0)]}
    df = spark.createDataFrame(list(polys.items()), POLY)
    got = Q.from_polygons(df, ["id"], width=F.lit(20), height=F.lit(18)).collect()
    want = {(i, x, y) for i, p in polys.items() if len(p) > 2 for y in range(18) for x in range(20) if even_odd(p, x, y)}
    assert lit(got) == want and sum(g["x2"] - g["x1"] + 1 for g in got) == len(want)
    free = lit(Q.from_polygons(df, ["id"]).collect())
    assert {p for p in free if 0 <= p[1] < 20 and 0 <= p[2] < 18} == want and len(free) > len(want)


@pytest.fixture(scope="module")
def masks():
    r = np.random.default_rng(2)
    return {i: r.random((11, 13)) < r.choice([0.1, 0.5, 0.9]) for i in range(20)} | {20: np.zeros((11, 13), bool), 21: np.ones((11, 13), bool)}


def runs_of(spark, masks, key=0):
    px = [(key, i, int(y), int(x)) for i, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return Q.from_pixels(spark.createDataFrame(px + px[:50], "image int, id int, y int, x int"), ["image", "id"])


def test_pixels_to_runs_and_back(spark, masks):
    runs = runs_of(spark, masks)
    assert lit(runs.collect()) == {(i, int(x), int(y)) for i, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)}
    assert {(p["id"], p["x"], p["y"]) for p in Q.pixels_of(runs).collect()} == lit(runs.collect())
    got = {m["id"]: tuple(m)[2:] for m in Q.measured(runs, ["image", "id"]).collect()}
    for i, m in masks.items():
        y, x = np.nonzero(m)
        assert got.get(i) == ((len(x), x.min(), y.min(), x.max(), y.max()) if len(x) else None)


@pytest.mark.parametrize("target", [5, 11, 13, 30])
def test_scaling_by_nearest_neighbour(spark, masks, target):
    square = {i: m[:11, :11] for i, m in masks.items()}
    got = lit(Q.scaled(runs_of(spark, square), F.lit(11), F.lit(target)).collect())
    want = {(i, x, y) for i, m in square.items() for y in range(target) for x in range(target) if m[y * 11 // target, x * 11 // target]}
    assert got == want


def test_pasting_clips(spark, masks):
    got = lit(Q.pasted(runs_of(spark, masks), F.lit(-4), F.lit(6), F.lit(7), F.lit(12)).collect())
    assert got == {(i, x - 4, y + 6) for i, x, y in lit(runs_of(spark, masks).collect()) if 0 <= x - 4 < 7 and 0 <= y + 6 < 12}


def test_merging_overlaps_and_touches(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(4), a, a + r.randrange(6)) for i in range(3) for a in (r.randrange(60) for _ in range(40))]
    got = Q.merged(spark.createDataFrame(rows, "id int, y int, x1 int, x2 int"), ["id"]).collect()
    assert lit(got) == {(i, x, y) for i, y, a, b in rows for x in range(a, b + 1)}
    by = {}
    for g in got:
        by.setdefault((g["id"], g["y"]), []).append((g["x1"], g["x2"]))
    assert all(a[1] + 1 < b[0] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))


@pytest.mark.parametrize("cell", [2, 256])
def test_iou_by_intervals(spark, masks, monkeypatch, cell):
    monkeypatch.setattr(Q, "CELL", cell)
    runs = runs_of(spark, masks)
    both = {(p["a"], p["b"]): p["both"] for p in Q.shared_pixels(runs, runs, "image", cell).collect()}
    assert both == {(a, b): n for a, p in masks.items() for b, q in masks.items() if (n := int((p & q).sum()))}
    pairs = spark.createDataFrame([(0, a, b) for a in masks for b in masks], "image int, a int, b int")
    got = {(p["a"], p["b"]): p["iou"] for p in Q.mask_iou(pairs, runs, runs, "image", F.col("a") != 3).collect()}
    for (a, p), (b, q) in ((x, y) for x in masks.items() for y in masks.items()):
        union = (p | q).sum()
        assert got[(a, b)] == pytest.approx(0 if a == 3 or not union else (p & q).sum() / union)


def test_long_runs_meet_once(spark):
    a = spark.createDataFrame([(0, 1, 0, 0, 99_999)], "image int, id int, y int, x1 int, x2 int")
    assert [tuple(x) for x in Q.shared_pixels(a, a, "image").collect()] == [(0, 1, 1, 100_000)]


def flood(m, diagonal):
    """Labels of the lit pixels by flooding."""
    lab, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if not lab[y, x]:
            n, stack = n + 1, [(y, x)]
            lab[y, x] = n
            while stack:
                a, b = stack.pop()
                for c in (-1, 0, 1):
                    for d in (-1, 0, 1):
                        if (c or d) and (diagonal or not (c and d)) and 0 <= a + c < m.shape[0] and 0 <= b + d < m.shape[1] and m[a + c, b + d] and not lab[a + c, b + d]:
                            lab[a + c, b + d] = n
                            stack.append((a + c, b + d))
    return lab


@pytest.mark.parametrize("diagonal", [True, False])
def test_connected_parts_against_flooding(spark, masks, diagonal):
    spiral = np.zeros((31, 31), bool)
    for k in range(0, 15, 2):  # one long thin part
        spiral[k, k : 31 - k] = spiral[k : 31 - k, 30 - k] = spiral[30 - k, k : 31 - k] = spiral[k + 2 : 31 - k, k] = True
        spiral[k + 2, k : k + 3] = True
    some = {**{i: m for i, m in masks.items() if i < 8 or i > 19}, 50: spiral}
    got = Q.part_table(runs_of(spark, some), ["image", "id"], diagonal).collect()
    want = []
    for i, m in some.items():
        lab = flood(m, diagonal)
        for k in range(1, lab.max() + 1):
            y, x = np.nonzero(lab == k)
            want.append((i, len(x), round(float(y.mean()), 9), round(float(x.mean()), 9)))
    assert sorted((g["id"], g["area"], round(g["row"], 9), round(g["col"], 9)) for g in got) == sorted(want)


def test_holes_are_filled(spark, masks):
    ring = np.zeros((11, 13), bool)
    ring[2:9, 2:11] = True
    ring[4:7, 4:9] = False
    ring[5, 6] = True  # an island in the hole
    some = {**{i: m for i, m in masks.items() if i < 6 or i > 19}, 60: ring}
    sizes = spark.createDataFrame([(0, i, 13, 11) for i in some], "image int, id int, width int, height int")
    got = lit(Q.filled(runs_of(spark, some), sizes, ["image", "id"]).collect())
    want = set()
    for i, m in some.items():
        dark = flood(~m, False)
        open_ = set(dark[[0, -1]].ravel()) | set(dark[:, [0, -1]].ravel())
        want |= {(i, int(x), int(y)) for y in range(11) for x in range(13) if m[y, x] or dark[y, x] not in open_}
    assert got == want and {p for p in got if p[0] == 60} == {(60, x, y) for x in range(2, 11) for y in range(2, 9)}


# --- profiles ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_resampling_is_linear_interpolation(spark, n):
    r = np.random.default_rng(4)
    lines = {i: r.normal(size=(k, 2)) for i, k in enumerate([2, 3, 10, 40])}
    lines[9] = np.array([[0, 0], [1, 0], [1, 0], [1, 0], [1, 2]], float)  # repeated vertices
    df = spark.createDataFrame([(i, k, float(x), float(y)) for i, p in lines.items() for k, (x, y) in enumerate(p)], "id int, pos int, x double, y double")
    got = {(g["id"], g["k"]): (g["x"], g["y"]) for g in P.resample_by_arc(df, "id", "pos", n).collect()}
    assert len(got) == n * len(lines)
    for i, p in lines.items():
        at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
        want = np.linspace(0, at[-1], n)
        assert np.allclose([got[(i, k)] for k in range(n)], np.stack([np.interp(want, at, p[:, c]) for c in (0, 1)], 1), atol=1e-12)


@pytest.mark.parametrize("line", [[(1.0, 1.0)], [(1.0, 1.0)] * 3])
def test_resampling_no_length_is_an_error(spark, line):
    df = spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate(line)], "id int, pos int, x double, y double")
    with pytest.raises(Exception, match="without length"):
        P.resample_by_arc(df, "id", "pos", 5).collect()


def outline(spark):
    big, small = [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9)], [(0.0, 0.0), (0.05, 0.0), (0.05, 0.05)]
    rows = [("f", "contour", part, k, x, y) for part, c in enumerate([small, big]) for k, (x, y) in enumerate(c)]
    rows += [("f", "skeleton", 0, k, x, 0.5) for k, x in enumerate((0.1, 0.3, 0.9))]
    return spark.createDataFrame(rows, "file string, section string, part int, pos int, x double, y double")


def test_profile_takes_the_largest_contour_and_the_second_channel(spark):
    n, w, h = 8, 40, 20
    r = np.random.default_rng(5)
    one, two = r.random((h, w)), r.random((h, w))
    px = lambda a: spark.createDataFrame([("f", x, y, float(a[y, x])) for y in range(h) for x in range(w)], "file string, x int, y int, v double")
    sizes = spark.createDataFrame([("f", w, h)], "file string, width int, height int")
    poly = [(4.0, 2.0), (36.0, 2.0), (36.0, 18.0), (4.0, 18.0)]
    at = np.linspace(4, 36, n)
    for channel, values in ((None, one), (px(two), two)):
        got = {g["segment"]: g for g in P.intensity_profile(outline(spark), sizes, px(one), n, channel, sizes if channel else None).collect()}
        of = {}
        for y in range(h):
            for x in range(w):
                if even_odd(poly, x, y):
                    of.setdefault(int(np.argmin(np.round((at - x) ** 2 + (10 - y) ** 2, 9))), []).append(values[y, x])
        assert set(got) == set(range(n))
        for k in range(n):
            assert got[k]["n"] == len(of[k]) and got[k]["mean"] == pytest.approx(np.mean(of[k])) and got[k]["sd"] == pytest.approx(np.std(of[k]))


def test_profile_errors_and_empty_segments(spark):
    sizes = spark.createDataFrame([("f", 40, 20)], "file string, width int, height int")
    px = spark.createDataFrame([("f", 5, 10, 2.0), ("f", 39, 19, 9.0)], "file string, x int, y int, v double")
    got = [tuple(g) for g in P.intensity_profile(outline(spark), sizes, px, 3).orderBy("segment").collect()]
    assert got == [("f", 0, 2.0, 0.0, 1), ("f", 1, None, None, 0), ("f", 2, None, None, 0)]
    other = spark.createDataFrame([("f", 41, 20)], "file string, width int, height int")
    with pytest.raises(Exception, match="differ in shape"):
        P.intensity_profile(outline(spark), sizes, px, 3, px, other).collect()
    with pytest.raises(Exception, match="no contour or no skeleton"):
        P.intensity_profile(outline(spark).filter("section = 'contour'"), sizes, px, 3).collect()


# --- detections -------------------------------------------------------------------------------------------------------


def box_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def greedy(rows, threshold, least):
    out = {}
    for i, img, conf, *box in sorted(rows, key=lambda x: (-x[2], x[3], x[4], x[0])):
        if conf >= least and all(box_iou(box, o) <= threshold for o in out.setdefault(img, {}).values()):
            out[img][i] = box
    return {(img, i) for img, kept in out.items() for i in kept}


@pytest.mark.parametrize("cell", [None, 7.0])
def test_suppression_is_greedy(spark, cell):
    r, rows = random.Random(6), []
    for i in range(600):
        x, y = r.uniform(0, 60), r.uniform(0, 60)
        rows.append((i, f"im{i % 3}", r.choice([0.2, 0.3, 0.5, 0.5, 0.9, r.random()]), x, y, x + r.uniform(1, 12), y + r.uniform(1, 12)))
    rows += [(700 + k, "im0", 0.5, 5.0, 5.0, 9.0, 9.0) for k in range(20)]  # equal boxes
    rows += [(800 + k, "chain", 0.9 - k / 1000, 2.0 * k, 0.0, 2.0 * k + 5, 5.0) for k in range(40)]  # each waits for the one before
    df = spark.createDataFrame(rows, "id long, image string, conf double, x1 double, y1 double, x2 double, y2 double")
    got = D.suppress(df, "image", "id", 0.3, 0.25, cell)
    assert got.columns == df.columns and {(g["image"], g["id"]) for g in got.collect()} == greedy(rows, 0.3, 0.25)
    assert D.suppress(df.limit(0), "image", "id", 0.3).count() == 0


def brute_precision(pred, truth, limit):
    """{class: (truths, predictions, found, ap)} by a loop over predictions."""
    out = {}
    for c in {p[0] for p in pred} | {t[0] for t in truth}:
        ts, ps = [t for t in truth if t[0] == c], sorted((p for p in pred if p[0] == c), key=lambda p: (-p[3], p[1], p[2]))
        took = {}
        for p in ps:
            near = [(box_iou(p[4:], t[3:]), -t[2]) for t in ts if t[1] == p[1] and box_iou(p[4:], t[3:]) > 0]
            if near and max(near)[0] >= limit:
                took[(p[1], p[2])] = (p[1], -max(near)[1])
        owner = {}
        for p in sorted(ps, key=lambda p: (-p[3], p[2])):
            if (p[1], p[2]) in took:
                owner.setdefault(took[(p[1], p[2])], (p[1], p[2]))
        hit = np.array([(p[1], p[2]) in owner.values() for p in ps], float)
        tp = np.cumsum(hit)
        precision, recall = tp / np.arange(1, len(ps) + 1), tp / max(len(ts), 1)
        ap = np.mean([max((q for q, x in zip(precision, recall, strict=True) if x >= k / 100 - 1e-12), default=0.0) for k in range(101)])
        out[c] = (len(ts), len(ps), int(hit.sum()), float(ap) if ts else None)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_average_precision_against_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    truth, pred = [], []
    for i in range(120):
        c, img, x, y = r.choice("aab"), i % 5, r.uniform(0, 30), r.uniform(0, 30)
        truth.append((c, img, i, x, y, x + 6, y + 6))
        for k in range(r.choice([0, 1, 1, 2])):
            dx, dy = r.gauss(0, 0.8), r.gauss(0, 0.8)
            pred.append((c, img, 1000 + 10 * i + k, r.choice([0.5, r.random()]), x + dx, y + dy, x + 6 + dx, y + 6 + dy))
    pred += [("only predicted", 0, 9000 + k, 0.5, 0.0, 0.0, 5.0, 5.0) for k in range(3)]
    truth += [("only true", 0, 9100, 0.0, 0.0, 5.0, 5.0)]
    p = spark.createDataFrame(pred, "class string, image int, id long, conf double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(truth, "class string, image int, id long, x1 double, y1 double, x2 double, y2 double")
    pairs = [(a[0], a[1], a[2], b[2], box_iou(a[4:], b[3:])) for a in pred for b in truth if a[:2] == b[:2] and box_iou(a[4:], b[3:]) > 0]
    pairs = spark.createDataFrame(pairs, "class string, image int, a long, b long, iou double")
    got = D.average_precision(p.select("class", "image", "id", "conf"), t.select("class", "image", "id"), pairs).collect()
    assert len(got) == 4 * len(D.LIMITS)
    for limit in D.LIMITS:
        want = brute_precision(pred, truth, limit)
        for g in got:
            if g["limit"] == limit:
                n, m, found, ap = want[g["class"]]
                assert (g["truths"], g["predictions"], g["found"]) == (n, m, found)
                assert g["ap"] == (None if ap is None else pytest.approx(ap)), (g, ap)
    whole = {s["class"]: s for s in D.summary(D.average_precision(p.select("class", "image", "id", "conf"), t.select("class", "image", "id"), pairs)).collect()}
    assert whole["only predicted"]["ap50"] is None and whole["only true"]["ap50"] == 0
    assert whole[None]["ap50"] == pytest.approx(np.mean([whole[c]["ap50"] for c in ("a", "b", "only true")]))


def test_average_precision_of_nothing(spark):
    p = spark.createDataFrame([], "class string, image int, id long, conf double")
    t = spark.createDataFrame([("a", 0, 1)], "class string, image int, id long")
    pairs = spark.createDataFrame([], "class string, image int, a long, b long, iou double")
    assert {(g["ap"], g["found"]) for g in D.average_precision(p, t, pairs).collect()} == {(0.0, 0)}
    assert D.average_precision(p, t.limit(0), pairs).count() == 0


def test_running_sums_of_a_hot_group(spark):
    df = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id").alias("o"), F.floor(F.col("id") / 700).alias("p"), ((F.col("id") * 7919) % 101).alias("v"))
    got = D.running(D.running(df, ["g"], "p", ["o"], F.col("v"), "sum"), ["g"], "p", ["o"], F.col("v"), "most", far=True).orderBy("o").collect()
    v = np.arange(5000) * 7919 % 101
    assert [x["sum"] for x in got] == np.cumsum(v).tolist() and [x["most"] for x in got] == np.maximum.accumulate(v[::-1])[::-1].tolist()


def test_candidates_still_meet(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0), (2, 0, 1.0, 1.0, 3.0, 3.0)], "id int, k int, x1 double, y1 double, x2 double, y2 double")
    assert X.with_box_iou(X.candidates(df, df, "k", "id", "id")).filter("a < b").first()["iou"] == pytest.approx(1 / 7) and math.isclose(1, 1)


def test_annotations_are_dealt_over_all_cores(spark):
    from metrika.plans import objects

    assert objects.annotated(spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
