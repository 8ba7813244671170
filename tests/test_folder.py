"""From a folder of images to measurement files, and deadlines."""

import json
import os
import time

import numpy as np
import pytest

from metrika.plans import folder as F
from metrika.plans import measure as P
from metrika.sources import pictures as I


@pytest.fixture
def images(tmp_path):
    """A bar of 60 x 6 and one of 30 x 6 in one image, one bar in another, an empty image and a broken one."""
    at = tmp_path / "in"
    at.mkdir()

    def put(name, *bars, w=160, h=120, channels=1):
        a = np.zeros((h, w, channels), np.uint8)
        for x, y, n in bars:
            a[y : y + 6, x : x + n] = 255
        (at / name).write_bytes(I.png(a.tobytes(), w, channels))

    put("20240101-e1-p1-4x_A01.png", (20, 20, 60), (90, 90, 30))
    put("colour.png", (40, 50, 80), channels=3)
    put("empty.png")
    (at / "broken.png").write_bytes(b"x")
    return at


def test_folder_to_measurements(spark, images, tmp_path):
    out = str(tmp_path / "out")
    measured = {os.path.basename(r["path"]): r for r in F.measure_folder(spark, str(images), out, P.ThresholdPredictor, scale=1.3, least=32).collect()}
    names = {"20240101-e1-p1-4x_A01_roi_0.png": 60, "20240101-e1-p1-4x_A01_roi_1.png": 30, "colour_roi_0.png": 80}
    assert set(measured) == set(names) and sorted(os.listdir(f"{out}/roi_images")) == sorted(names)
    for n, length in names.items():
        assert measured[n]["status"] == "ok" and measured[n]["area_px"] == length * 6 and length - 8 <= measured[n]["length_px"] <= length + 1
    rows = {r["Filename"]: r for r in spark.read.csv(f"{out}/measurements", header=True).collect()}
    first = rows["20240101-e1-p1-4x_A01_roi_0.png"]
    assert set(rows) == set(names) and (first["Metadata_Plate"], first["Metadata_Well"], first["Worm_ID"]) == ("p1", "A01", "0") and float(first["Length_um"]) == pytest.approx(measured[first["Filename"]]["length_px"] * 3.2937)
    catalog = {r["name"]: r for r in spark.read.json(f"{out}/roi_catalog").collect()}
    assert catalog["colour_roi_0"]["roi_size_original"] == 104 and catalog["colour_roi_0"]["bbox_original"] == [40.0, 50.0, 120.0, 56.0] and catalog["colour_roi_0"]["roi_top_left"] == [28, 1]
    [summary] = [json.loads(x) for f in os.listdir(f"{out}/summary") if f.endswith(".json") for x in open(f"{out}/summary/{f}")]
    assert summary["total"] == summary["measured"] == 3
    log = [r["value"].split("\t") for r in spark.read.text(f"{out}/log").collect()]
    assert sorted(x[0] for x in log) == ["END"] * 3 + ["START"] * 3 and {x[2] for x in log} == set(names)


def test_a_slow_image_is_stopped_and_the_others_go_on(spark):
    class Slow(P.ThresholdPredictor):
        def segment(self, image):
            if image[0, 0] > 0:
                time.sleep(30)
            return image > self.threshold

    bar = np.zeros((40, 60))
    bar[18:24, 10:50] = 1.0
    slow = bar.copy()
    slow[0, 0] = 1.0
    df = spark.createDataFrame([(n, a.ravel().tolist(), 40, 60) for n, a in (("a", bar), ("slow", slow), ("b", bar))], "path string, pixels array<double>, height int, width int").coalesce(1)
    began = time.monotonic()
    measured = P.measure(df, Slow, limit_s=1)
    got = {r["path"]: r for r in measured.collect()}
    assert time.monotonic() - began < 20
    assert got["slow"]["status"] == "TIMEOUT" and got["slow"]["length_px"] is None and got["a"]["status"] == got["b"]["status"] == "ok"
    assert [r["text"].split("\t")[0] for r in P.log_lines(measured.filter("path = 'slow'")).collect()] == ["START", "TIMEOUT"]


def test_deadlines_end_and_leave_no_alarm():
    with pytest.raises(P.Late), P.deadline(0.05):
        while True:
            pass
    with P.deadline(0.05):
        pass
    time.sleep(0.1)
