"""Trees of data sets, images and cut-outs, file sinks, publishing, streaming copies, polygon repair."""

import json
import os
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from metrika.functions import geometry as G
from metrika.operators import curation as C
from metrika.plans import exchange as X
from metrika.sources import files as S
from metrika.sources import named_files as W
from metrika.sources import pictures as I
from metrika.sources import sinks as K
from metrika.sources import trees as T
from metrika.streaming import incremental as R

# --- trees ------------------------------------------------------------------------------------------------------------


@pytest.fixture
def tree(tmp_path):
    def put(path, text="x"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)

    for i in range(3):
        put(f"one/train/images/im{i}.PNG")
        put(f"one/train/labels/im{i}.txt")
    put("one/train/images/notes.md")
    put("one/train/roi_catalog.json", "{}")
    put("one/valid/images/v.jpg")
    put("two/train/labels/a.txt")
    put("three/train/images/a.jpg")
    put("three/train/labels/a.txt")
    put("three/train/deep/er/a.jpg")
    put("three/train/images/sub/b.jpg")
    put("stray.txt")
    (tmp_path / "four").mkdir()
    return tmp_path


def test_data_sets_of_a_tree(spark, tree):
    got = {(r["subset"], r["split"]): r for r in T.data_sets(spark, str(tree)).collect()}
    assert set(got) == {("one", "train"), ("one", "valid"), ("two", "train"), ("three", "train")}
    one = got[("one", "train")]
    assert (one["n_images"], one["n_labels"], one["status"]) == (3, 3, "ok") and one["catalog"].endswith("one/train/roi_catalog.json") and one["output"].endswith("one/train/skeleton")
    assert got[("one", "valid")]["status"] == "missing: labels" and got[("two", "train")]["status"] == "missing: images" and got[("two", "train")]["images"] is None
    assert got[("three", "train")]["catalog"] is None
    names = {(r["subset"]) for r in T.usable(T.data_sets(spark, str(tree), "train")).collect()}
    assert names == {"one", "three"}


def test_data_sets_push_down_what_is_asked_for(spark, tree):
    some = T.data_sets(spark, str(tree), "train", ["one", "two", "nine"])
    assert {r["subset"] for r in some.collect()} == {"one", "two"} and some.rdd.getNumPartitions() == 2
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert {r["subset"] for r in T.data_sets(spark, str(tree), "train", ["one", "two"]).collect()} == {"one", "two"}
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    assert T.data_sets(spark, str(tree), "nothing").count() == 0


def test_data_sets_that_are_not_there(spark, tree):
    with pytest.raises(Exception, match="nowhere"):
        T.data_sets(spark, str(tree / "nowhere")).collect()
    with pytest.raises(Exception, match="no data set"):
        T.usable(T.data_sets(spark, str(tree), "valid")).collect()


def test_images_by_name_with_fallbacks(spark, tree):
    names = spark.createDataFrame([("a.jpg",), ("images/a.jpg",), ("sub/b.jpg",), ("b.jpg",), ("none.jpg",), ("er/a.jpg",)], "file_name string")
    got = {r["file_name"]: r["path"] for r in T.found_images(spark, names, str(tree / "three/train")).collect()}
    end = lambda n: got[n] and got[n].split("three/train/")[1]
    assert {n: end(n) for n in got} == {"a.jpg": "deep/er/a.jpg", "images/a.jpg": "images/a.jpg", "sub/b.jpg": "images/sub/b.jpg", "b.jpg": "images/sub/b.jpg", "none.jpg": None, "er/a.jpg": "deep/er/a.jpg"}


# --- images -----------------------------------------------------------------------------------------------------------


def unpacked(data):
    """(width, height, channels, rows in red, green, blue order) of a PNG without filters."""
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", data[at + 8 : at + 18])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    c = {0: 1, 2: 3, 6: 4}[colour]
    raw = zlib.decompress(body)
    return w, h, c, [raw[y * (w * c + 1) + 1 : (y + 1) * (w * c + 1)] for y in range(h)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A colour image of 50 x 40, a gray one of 33 x 21, one of 16 bits, and a file that is none."""
    at, r = tmp_path_factory.mktemp("pictures"), random.Random(1)
    pixels = {"colour": (50, 3, bytes(r.randrange(256) for _ in range(50 * 40 * 3))), "gray": (33, 1, bytes(r.randrange(256) for _ in range(33 * 21)))}
    for name, (w, c, data) in pixels.items():
        (at / f"{name}.png").write_bytes(I.png(data, w, c))
    (at / "broken.png").write_bytes(b"no image")
    deep = bytearray(I.png(bytes(64), 8, 1))
    deep[24] = 16
    (at / "deep.png").write_bytes(bytes(deep))
    (at / "text.txt").write_text("x")
    return at, pixels


def test_pictures_are_decoded(spark, folder):
    at, pixels = folder
    got = {os.path.basename(r["path"]): r for r in I.pictures(spark, str(at)).collect()}
    assert "text.txt" not in got and got["broken.png"]["data"] is None
    for name, (w, c, data) in pixels.items():
        r = got[f"{name}.png"]
        assert (r["width"], r["height"], r["channels"], bytes(r["data"])) == (w, len(data) // w // c, c, data)
    flags = {os.path.basename(r["path"]): r["deep"] for r in I.deep(spark.read.format("binaryFile").load(str(at))).collect()}
    assert flags == {"colour.png": False, "gray.png": False, "broken.png": None, "deep.png": True, "text.txt": None}


def test_gray_values(spark, folder):
    at, pixels = folder
    got = {os.path.basename(r["path"]): r["v"] for r in I.pictures(spark, str(at)).filter("data is not null").select("path", I.gray(F.col("data"), F.col("channels")).alias("v")).collect()}
    data = pixels["colour"][2]
    assert got["gray.png"] == list(pixels["gray"][2])
    assert got["colour.png"] == [int(0.114 * data[k] + 0.587 * data[k + 1] + 0.299 * data[k + 2] + 0.5) for k in range(0, len(data), 3)]


def test_cut_outs_are_slices(spark, folder, tmp_path):
    at, pixels = folder
    images = I.pictures(spark, str(at))
    paths = {os.path.basename(r["path"]): r["path"] for r in images.select("path").collect()}
    boxes = [("colour.png", 0, 10.0, 10.0, 30.0, 20.0), ("colour.png", 1, 40.0, 30.0, 49.0, 39.0), ("gray.png", 0, 0.0, 0.0, 33.0, 21.0), ("colour.png", 2, -200.0, 0.0, -190.0, 5.0), ("broken.png", 0, 0.0, 0.0, 1.0, 1.0)]
    det = spark.createDataFrame([(paths[n], k, *b) for n, k, *b in boxes], "path string, detection_index int, x1 double, y1 double, x2 double, y2 double")
    cuts = I.rois(images, det, 1.2, 8)
    got = {r["name"]: r for r in cuts.collect()}
    assert set(got) == {"colour_roi_0.png", "colour_roi_1.png", "gray_roi_0.png", "colour_roi_2.png"}
    for n, k, x1, y1, x2, y2 in boxes[:4]:
        w, c, data = pixels[n[:-4]]
        h, size = len(data) // w // c, max(8, int(max(x2 - x1, y2 - y1) * 1.2))
        left, top = int((x1 + x2) / 2) - size // 2, int((y1 + y2) / 2) - size // 2
        want = b"".join(data[(y * w + x) * c : (y * w + x + 1) * c] if 0 <= x < w and 0 <= y < h else bytes(c) for y in range(top, top + size) for x in range(left, left + size))
        r = got[f"{n[:-4]}_roi_{k}.png"]
        assert r["size"] == size and bytes(r["data"]) == want
    out = str(tmp_path / "out")
    W.write_files(cuts.select("name", I.as_png(F.col("data"), F.col("size"), F.col("channels")).alias("content")), out)
    assert sorted(os.listdir(out)) == sorted(got)
    w, h, c, rows = unpacked((tmp_path / "out" / "colour_roi_0.png").read_bytes())
    own = bytes(got["colour_roi_0.png"]["data"])
    turned = b"".join(own[k : k + 3][::-1] for k in range(0, len(own), 3))
    assert (w, h, c) == (24, 24, 3) and b"".join(rows) == turned
    again = {os.path.basename(r["path"]): bytes(r["data"]) for r in I.pictures(spark, out).collect()}
    assert again == {n: bytes(r["data"]) for n, r in got.items()}


def test_cut_outs_go_in_passes(spark, monkeypatch):
    at, was, seen = "/root/testdata/sf0.001", I.pictures, []
    whole = sorted(X.s23_k5_cut_outs(spark, at).collect())
    monkeypatch.setattr(I, "pictures", lambda s, folder: seen.append(len(was(s, folder).inputFiles())) or was(s, folder))
    monkeypatch.setattr(X, "PASS_FILES", len(whole) // 3)
    assert sorted(X.s23_k5_cut_outs(spark, at).collect()) == whole
    assert max(seen) < len(whole) * 2 // 3 and sum(seen) == 2 * len(whole)


def test_named_files_replace_and_fail_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(f"f{i}.txt", f"text é {i}") for i in range(20)], "name string, content string").repartition(4)
    W.write_files(df, out)
    assert {n: (tmp_path / "out" / n).read_text() for n in os.listdir(out)} == {f"f{i}.txt": f"text é {i}" for i in range(20)}
    W.write_files(df.limit(3).withColumn("content", F.lit("new")), out)
    assert len(os.listdir(out)) == 20
    for bad in (df.union(df.limit(1)), df.withColumn("name", F.lit("../up"))):
        with pytest.raises(Exception):
            W.write_files(bad, out)
        assert len(os.listdir(out)) == 20
    W.write_files(df.filter("name < 'f12'"), out, mode="overwrite")
    assert sorted(os.listdir(out)) == ["f0.txt", "f1.txt", "f10.txt", "f11.txt"]


# --- publishing and copies --------------------------------------------------------------------------------------------


def test_publishing_leaves_nothing_stale(spark, tmp_path):
    out, runs = str(tmp_path / "table"), spark.createDataFrame([("a",), ("b b",), ("c/d",)], "run string")
    rows = lambda *x: spark.createDataFrame(list(x), "run string, iou double")
    read = lambda: sorted((r["run"], r["iou"]) for r in spark.read.schema("iou double, run string").csv(out, header=True).collect())
    K.publish(rows(("a", 0.5), ("a", 0.6), ("b b", 0.7), ("c/d", 0.8)), out, runs)
    K.publish(rows(("a", 0.5), ("a", 0.6), ("b b", 0.7), ("c/d", 0.8)), out, runs)
    assert read() == [("a", 0.5), ("a", 0.6), ("b b", 0.7), ("c/d", 0.8)]
    K.publish(rows(("a", 0.9)), out, runs.filter("run <> 'b b'"))
    assert read() == [("a", 0.9), ("b b", 0.7)] and not os.path.exists(f"{out}/run=c%2Fd")
    K.publish(rows(("a", 0.9)).limit(0), out, runs)
    assert [p for p in os.listdir(out) if p.startswith("run=")] == []
    with pytest.raises(ValueError, match="not published"):
        K.publish(rows(("z", 0.9)), out, runs)


def test_estimate_tables(spark, tmp_path):
    df = spark.createDataFrame([("one", "N2", 1.5, 0.1), ("two", "N2", 2.5, 0.2), ("one", 'C"B', 3e-9, 1e-10)], "dataset string, strain string, EC50 double, EC50_se double")
    K.estimate_tables(df, str(tmp_path))
    [f] = [f for f in os.listdir(tmp_path / "comparison") if f.endswith(".txt")]
    raw = (tmp_path / "comparison" / f).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.decode("utf-8-sig").splitlines() == ["strain,one,two", '"C""B","3.00e-09 ± 1.00e-10",""', '"N2","1.50e+00 ± 1.00e-01","2.50e+00 ± 2.00e-01"']
    assert spark.read.csv(str(tmp_path / "estimates/name=one"), header=True).count() == 2


def test_speed_files(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("i"), (F.col("id") % 5).cast("double").alias("s"))
    K.speed_files(df, str(tmp_path), "detect", "i", "s", 3, 4, device="cpu")
    raw = spark.read.csv(str(tmp_path / "raw"), header=True, inferSchema=True).orderBy("batch_idx").collect()
    v = [i % 5 for i in range(4, 25)]
    assert [(r["batch_idx"], r["n_items"], r["seconds"]) for r in raw] == [(k, 7, float(sum(v[7 * k : 7 * k + 7]))) for k in range(3)]
    [f] = [f for f in os.listdir(tmp_path / "summary") if f.endswith(".json")]
    one = json.loads((tmp_path / "summary" / f).read_text())
    assert (one["name"], one["device"], one["batches"], one["items"], one["mean"]) == ("detect", "cpu", 3, 21, sum(v) / 3)


def test_streaming_copy_takes_each_row_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    os.makedirs(src)
    names = S.name_map(spark.createDataFrame([("A.png\ta.tif",), ("b.png\tb.tif",), ("B.png\tB2.tif",)], "value string"))
    put = lambda n, rows: (tmp_path / "in" / n).write_text("file,v,tif\n" + "".join(f"{a},{b},old\n" for a, b in rows))
    stream = lambda: spark.readStream.schema("file string, v int, tif string").option("header", True).option("maxFilesPerTrigger", 1).csv(src)
    read = lambda c="tif": sorted((r["file"], r["v"], r[c]) for r in spark.read.schema(f"file string, v int, tif string{', new string' * (c == 'new')}").csv(out, header=True).collect())
    put("1.csv", [("A.png", 1), ("a.PNG", 2)])
    put("2.csv", [("b.png", 3), ("B.png", 4)])
    R.copy_with_column(stream(), "file", names, "tif", out, mark)
    first = [("A.png", 1, "a.tif"), ("B.png", 4, "B2.tif"), ("a.PNG", 2, "a.tif"), ("b.png", 3, "b.tif")]
    assert read() == first
    put("3.csv", [("zz.png", 5)])
    R.copy_with_column(stream(), "file", names, "tif", out, mark)
    R.copy_with_column(stream(), "file", names, "tif", out, mark)
    assert read() == [*first, ("zz.png", 5, None)]
    # a batch whose end was not noted runs again
    last = max((int(n) for n in os.listdir(f"{mark}/commits") if n.isdigit()))
    os.remove(f"{mark}/commits/{last}")
    if os.path.exists(f"{mark}/commits/.{last}.crc"):
        os.remove(f"{mark}/commits/.{last}.crc")
    R.copy_with_column(stream(), "file", names, "tif", out, mark)
    assert read() == [*first, ("zz.png", 5, None)]
    with pytest.raises(ValueError, match="not found"):
        R.copy_with_column(stream(), "other", names, "tif", out, mark)


def test_streaming_copy_adds_a_column(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.csv").write_text("file,v\nb.png,3\n")
    names = spark.createDataFrame([("b.png", "b.tif")], "hosted string, original string")
    R.copy_with_column(spark.readStream.schema("file string, v int").option("header", True).csv(str(tmp_path / "in")), "file", names, "tif", str(tmp_path / "out"), str(tmp_path / "mark"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), header=True).collect()] == [("b.png", "3", "b.tif")]


# --- polygons ---------------------------------------------------------------------------------------------------------

POLY = "id long, polygon array<struct<x:double,y:double>>"


def area(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


def turn(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def corners(points):
    """Points that are no mix of others: for each pair of points, all others on one side, the pair is an edge of the hull."""
    p = sorted(set(points))
    on = set()
    for a in p:
        for b in p:
            if a != b and all(turn(a, b, c) >= 0 for c in p):
                line = [c for c in p if turn(a, b, c) == 0]
                on |= {min(line), max(line)}
    return on


def test_hull_against_all_pairs(spark):
    r = random.Random(7)
    sets = {i: [(float(r.randint(0, 9)), float(r.randint(0, 9))) for _ in range(r.randint(3, 14))] for i in range(80)}
    sets |= {100: [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 101: [(1.0, 1.0)] * 3}
    got = {x["id"]: [tuple(p) for p in x["h"]] for x in spark.createDataFrame(list(sets.items()), POLY).select("id", G.hull(F.col("polygon")).alias("h")).collect()}
    for i, p in sets.items():
        assert set(got[i]) == (corners(p) if len(set(p)) > 1 else set(p)), (i, p)
        assert len(got[i]) == len(set(got[i])) and (len(got[i]) < 3 or area(got[i]) > 0)


def meets(a, b, c, d):
    sign = lambda x: (x > 0) - (x < 0)
    on = lambda o, e, z: min(o[0], e[0]) <= z[0] <= max(o[0], e[0]) and min(o[1], e[1]) <= z[1] <= max(o[1], e[1])
    p, q, r, s = (sign(turn(*x)) for x in ((a, b, c), (a, b, d), (c, d, a), (c, d, b)))
    if p != q and r != s and p and q and r and s:
        return True
    return (not p and on(a, b, c)) or (not q and on(a, b, d)) or (not r and on(c, d, a)) or (not s and on(c, d, b))


def test_repair_of_bow_ties_turns_and_repeats(spark):
    r = random.Random(8)
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0), (3.0, 3.0), (3.0, 6.0), (6.0, 6.0), (6.0, 3.0), (3.0, 3.0)]
    sets = {0: bow, 1: square, 2: square[::-1], 3: [square[0], *square, square[0], square[0]], 4: hole, 5: square[:2], 6: [(0.0, 0.0), (4.0, 0.0), (1.0, 1.0), (0.0, 4.0)]}
    sets |= {10 + i: [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(r.randint(3, 8))] for i in range(80)}
    got = {x["id"]: [tuple(p) for p in x["h"]] for x in spark.createDataFrame(list(sets.items()), POLY).select("id", G.repaired(F.col("polygon")).alias("h")).collect()}
    assert area(got[0]) == 16 and area(got[1]) == area(got[2]) == area(got[3]) == 16 and len(got[3]) == 4
    assert area(got[4]) == 81 and got[5] == square[:2] and area(got[6]) == 4
    for i in range(10, 90):
        p = sets[i]
        n = len(p)
        crossed = any(meets(p[a], p[(a + 1) % n], p[b], p[(b + 1) % n]) for a in range(n) for b in range(a + 2, n) if (a, b) != (0, n - 1))
        assert area(got[i]) >= 0 and (set(got[i]) == corners(p) if crossed else set(got[i]) == set(p))


def inside(p, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1], strict=True)) % 2


def test_clipping_by_counting_points(spark):
    r, sets = random.Random(9), {}
    for i in range(40):
        n = r.randint(3, 9)  # a star around a point is simple, convex or not
        import math

        cx, cy = r.uniform(-2, 12), r.uniform(-2, 12)
        sets[i] = [(cx + (d := r.uniform(2, 9)) * math.cos(2 * math.pi * k / n), cy + d * math.sin(2 * math.pi * k / n)) for k in range(n)]
    box = [F.lit(v) for v in (1.0, 2.0, 9.0, 8.0)]
    got = {x["id"]: [tuple(p) for p in x["h"]] for x in spark.createDataFrame(list(sets.items()), POLY).select("id", G.clipped(F.col("polygon"), *box).alias("h")).collect()}
    m = 160
    for i, p in sets.items():
        hits = sum(inside(p, 1 + 8 * (a + 0.5) / m, 2 + 6 * (b + 0.5) / m) for a in range(m) for b in range(m))
        assert abs(area(got[i]) - hits * 48 / m / m) < 0.25
        assert all(1 - 1e-9 <= x <= 9 + 1e-9 and 2 - 1e-9 <= y <= 8 + 1e-9 for x, y in got[i])


def test_clip_polygons_of_a_target_and_its_neighbours(spark):
    target = [(10.0, 10.0), (50.0, 10.0), (50.0, 50.0), (10.0, 50.0)]
    bow = [(40.0, 20.0), (80.0, 40.0), (80.0, 20.0), (40.0, 40.0)]
    crumb = [(55.0, 55.0), (55.5, 55.0), (55.5, 55.5)]
    far = [(500.0, 500.0), (510.0, 500.0), (510.0, 510.0)]
    df = spark.createDataFrame([(1, k, 0, p) for k, p in enumerate((target, bow, crumb, far))], "image_id int, ann_id int, category_id int, polygon array<struct<x:double,y:double>>")
    got = {r["ann_id"]: r for r in C.clip_polygons(C.roi_dataset(df, scale=1.3)).filter("target = 0").collect()}
    size, left = got[0]["size"], got[0]["rx1"]
    assert set(got) == {0, 1} and size == 52 and [tuple(p) for p in got[0]["clip"]] == [((x - left) / size, (y - left) / size) for x, y in target]
    clip = [tuple(p) for p in got[1]["clip"]]
    assert area(clip) * size * size == pytest.approx((56 - 40) * 20) and len(clip) == 4


def test_decimals_are_those_of_the_exact_binary_value(spark):
    import random

    from metrika.functions import measures as M

    r = random.Random(2)
    values = [k / 256 for k in range(-300, 300)] + [r.choice((-1, 1)) * r.random() * 10.0 ** r.randint(-8, 12) for _ in range(3000)] + [0.0, -0.0, 0.9999995, 0.1234565, 0.9999999, 1e15, 2.0**60]
    values += [round(r.random(), 6) + 5e-7 for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", M.fixed(F.col("v")).alias("six"), M.fixed(F.col("v"), 3).alias("three")).collect()
    assert [(x["six"], x["three"]) for x in got] == [("%.6f" % x["v"], "%.3f" % x["v"]) for x in got]


def test_yolo_text_with_halves(spark):
    from metrika.operators import curation as C

    images = spark.createDataFrame([(1, "a.png", 1.0, 1.0)], "image_id long, file_name string, width double, height double")
    marks = spark.createDataFrame([(1, 1, 0, [1 / 128, 3 / 128, 5 / 128, 0.5, 2.0, -1.0])], "image_id long, ann_id long, category_id int, segment array<double>")
    assert C.to_yolo(images, marks).first()["text"] == "0 0.007812 0.023438 0.039062 0.500000 1.000000 0.000000"
