"""Images to measurement rows as one lazy plan: decode, detect, cut out, segment, centerline, stitch, measure.

A predictor is any picklable callable from an image (2-D array) to a list of boxes and masks; it is made once a worker.
Faults become a status, never a lost row.
"""

from __future__ import annotations

import contextlib
import signal
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import names as N
from ..operators import kernels as K

DETECTIONS = "path string, detection_index int, x1 double, y1 double, x2 double, y2 double, conf double, class_id int, width int, height int, status string"
MEASURED = "path string, length_px double, width_px double, area_px long, topology string, fragments int, warnings array<string>, status string, started timestamp, elapsed_ms double"


@dataclass
class ThresholdPredictor:
    """A stand-in for a trained model: bright pixels are objects, each component one detection of confidence 1."""

    threshold: float = 0.5
    least: int = 4

    def detect(self, image: np.ndarray) -> list[tuple[float, float, float, float, float, int]]:
        lab, n = K.label(image > self.threshold)
        out = []
        for i in range(1, n + 1):
            r, c = np.nonzero(lab == i)
            if len(r) >= self.least:
                out.append((float(c.min()), float(r.min()), float(c.max() + 1), float(r.max() + 1), 1.0, 0))
        return out

    def segment(self, image: np.ndarray) -> np.ndarray:
        return image > self.threshold


def _image(pixels, h: int, w: int) -> np.ndarray:
    return np.asarray(pixels, float).reshape(int(h), int(w))


def detect(images: DataFrame, predictor: Callable[[], ThresholdPredictor], conf_least: float = 0.25, radius: float | None = None) -> DataFrame:
    """images (path, pixels, height, width) to detections. detection_index keeps the gaps that filtered boxes leave."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = predictor()
        for b in batches:
            rows = []
            for path, px, h, w in zip(b["path"], b["pixels"], b["height"], b["width"], strict=True):
                try:
                    found = model.detect(_image(px, h, w))
                    rows += [(path, k, *box, w, h, "ok") for k, box in enumerate(found)]
                    if not found:
                        rows.append((path, None, None, None, None, None, None, None, w, h, "nothing found"))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, None, None, None, None, None, f"failed: {type(e).__name__}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")]).astype({"detection_index": "Int32", "class_id": "Int32", "width": "Int32", "height": "Int32"})

    out = images.select("path", "pixels", "height", "width").mapInPandas(run, DETECTIONS)
    keep = F.col("conf").isNull() | (F.col("conf") >= conf_least)
    if radius is not None:
        cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
        keep = keep & (F.col("conf").isNull() | (F.hypot(cx - F.col("width") / 2, cy - F.col("height") / 2) / (F.col("width") / 2) <= radius))
    return out.filter(keep)


class Late(Exception):
    """Time is up."""


@contextlib.contextmanager
def deadline(seconds: float):
    """Stops what runs inside by an alarm, wherever it is. Only a process's main thread gets alarms, as a worker's does;
    elsewhere nothing is stopped, and the caller's own looks at the clock must do."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        yield
        return

    def late(*_):
        raise Late

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, max(seconds, 1e-6))
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def fill(row: list, mask: np.ndarray, end: float, h: int, w: int, least_area: int, far: float, turn: float) -> None:
    """Puts the numbers of a cut-out's mask into its row."""
    lab, n = K.label(mask)
    parts = []
    for i in range(1, n + 1):
        own = lab == i
        if own.sum() < least_area:
            continue
        if time.monotonic() > end:
            raise Late
        line, _, kind = K.centerline(own, least_pixels=least_area)
        if len(line):
            r, c = np.nonzero(own)
            parts.append((np.hypot(r.mean() - h / 2, c.mean() - w / 2), i, line, kind))
    if not parts:
        row[7] = "nothing found"
        return
    parts.sort(key=lambda p: p[:2])
    line, used, failed = K.stitch([p[2] for p in parts], far, turn)
    chosen = np.isin(lab, [parts[k][1] for k in used])
    seg = np.hypot(*np.diff(line, axis=0).T)
    at = np.clip(np.rint(line).astype(int), 0, np.array(mask.shape) - 1)
    inside = chosen[at[:, 0], at[:, 1]]
    body = float(seg[inside[1:] & inside[:-1]].sum())
    row[1:7] = [float(seg.sum()), float(chosen.sum()) / body if body else None, int(chosen.sum()), parts[used[0]][3], len(used), [f"gap: {failed}"] if failed else []]


def measure(images: DataFrame, predictor: Callable[[], ThresholdPredictor], limit_s: float = 60, least_area: int = 20, far: float = 110, turn: float = 110) -> DataFrame:
    """images (path, pixels, height, width) of cut-outs to one measured row each. What takes over limit_s is stopped, in the
    middle of a fragment too, and has status TIMEOUT and no numbers; the rest of the batch goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = predictor()
        for b in batches:
            rows = []
            for path, px, h, w in zip(b["path"], b["pixels"], b["height"], b["width"], strict=True):
                began, at, row = time.monotonic(), datetime.now(timezone.utc), [path, None, None, 0, "none", 0, [], "ok"]
                try:
                    with deadline(limit_s):
                        fill(row, model.segment(_image(px, h, w)), began + limit_s, h, w, least_area, far, turn)
                except Late:
                    row[1:] = [None, None, 0, "none", 0, [], "TIMEOUT"]
                except Exception as e:  # noqa: BLE001
                    row[7] = f"failed: {type(e).__name__}"
                rows.append((*row, at, (time.monotonic() - began) * 1000))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")])

    return images.select("path", "pixels", "height", "width").mapInPandas(run, MEASURED)


def measurement_rows(measured: DataFrame, catalog: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """The fixed ten columns of measurement tables. catalog: (name, scale_factor); a name it lacks counts in cut-out pixels,
    or as missing if strict."""
    x = measured.withColumn("name", N.basename(F.col("path")))
    if catalog is None:
        x = x.withColumn("scale_factor", F.lit(None).cast("double"))
    else:
        x = x.withColumn("stem", N.without_extension(F.col("name"))).join(catalog.select(F.col("name").alias("stem"), "scale_factor"), "stem", "left")
    m = N.metadata(F.col("name"))
    return x.select(
        F.col("name").alias("Filename"), m["date"].alias("Date"), m["experiment"].alias("Metadata_Experiment"), m["plate"].alias("Metadata_Plate"), m["magnification"].alias("Magnification"),
        m["well"].alias("Metadata_Well"), m["object_id"].alias("Worm_ID"), M.micrometres(F.col("length_px"), F.col("scale_factor"), strict=strict).alias("Length_um"),
        M.micrometres(F.col("width_px"), F.col("scale_factor"), strict=strict).alias("Width_um"), F.array_join("warnings", ";").alias("Topology_Warnings"),
    )


def run_counts(measured: DataFrame) -> DataFrame:
    """Counters from the status column: retries of tasks can't count twice."""
    s = F.col("status")
    return measured.agg(F.count("*").alias("total"), F.count_if(s == "ok").alias("measured"), F.count_if(s == "nothing found").alias("empty"), F.count_if(s == "TIMEOUT").alias("timed_out"), F.count_if(s.startswith("failed")).alias("failed"))


def log_lines(measured: DataFrame) -> DataFrame:
    """(path, at, text): what happened to each image as lines of a log in the order of time, two an image: START, and END,
    TIMEOUT or FAILED with its seconds. The image that a killed job was at has no row; its task runs again."""
    end = F.when(F.col("status") == "TIMEOUT", "TIMEOUT").when(F.col("status").startswith("failed"), "FAILED").otherwise("END")
    stop = F.timestamp_micros(F.unix_micros("started") + (F.col("elapsed_ms") * 1000).cast("long"))
    name, clock = N.basename(F.col("path")), lambda t: F.date_format(t, "HH:mm:ss")
    lines = F.array(
        F.struct(F.col("started").alias("at"), F.lit(0).alias("k"), F.concat_ws("\t", F.lit("START"), clock(F.col("started")), name).alias("text")),
        F.struct(stop.alias("at"), F.lit(1).alias("k"), F.concat_ws("\t", end, clock(stop), name, F.format_string("%.2fs", F.col("elapsed_ms") / 1000)).alias("text")),
    )
    return measured.select("path", F.inline(lines)).orderBy("at", "k", "path").select("path", "at", "text")
