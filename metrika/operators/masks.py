"""Mask kernels as columns: Arrow-batched functions over flat pixel arrays and polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K


def _grid(pixels, h, w) -> np.ndarray:
    return np.asarray(pixels, float).reshape(int(h), int(w))


def component_table(images: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(id, component, area, row, col) of 8-connected components of (id, pixels, height, width)."""
    kind = dict(images.dtypes)["id"]

    def run(batches):
        for b in batches:
            out = []
            for i, px, h, w in zip(b["id"], b["pixels"], b["height"], b["width"], strict=True):
                lab, n = K.label(_grid(px, h, w) > threshold)
                for k in range(1, n + 1):
                    r, c = np.nonzero(lab == k)
                    out.append((i, k, len(r), float(r.mean()), float(c.mean())))
            yield pd.DataFrame(out, columns=["id", "component", "area", "row", "col"])

    return images.select("id", "pixels", "height", "width").mapInPandas(run, f"id {kind}, component int, area long, row double, col double")


def shape_table(images: DataFrame, threshold: float = 0.0, ring_radius: int = 1, ring_ratio: float = 0.2, sigma: float = 1.0) -> DataFrame:
    """(id, ring, filled, smoothed, widest, skeleton, topology, border) of each mask as a whole."""
    kind = dict(images.dtypes)["id"]

    def run(batches):
        for b in batches:
            out = []
            for i, px, h, w in zip(b["id"], b["pixels"], b["height"], b["width"], strict=True):
                m = _grid(px, h, w) > threshold
                thin = K.thin(m)
                out.append((i, K.is_ring(m, ring_radius, ring_ratio), int(K.keep_best_hole(m).sum()), int(K.smooth(m, sigma).sum()), float(2 * K.distance(m).max()), int(thin.sum()), K.topology(K.skeleton_graph(thin)), len(K.contour(m))))
            yield pd.DataFrame(out, columns=["id", "ring", "filled", "smoothed", "widest", "skeleton", "topology", "border"])

    return images.select("id", "pixels", "height", "width").mapInPandas(run, f"id {kind}, ring boolean, filled long, smoothed long, widest double, skeleton long, topology string, border long")


def augmented(images: DataFrame, seed: int = 42) -> DataFrame:
    """images (id, pixels, height, width, aug_type, factor, noise_sd) with `changed`: the pixels after that augmentation."""

    @F.pandas_udf("array<double>")
    def apply(i: pd.Series, px: pd.Series, kind: pd.Series, factor: pd.Series, sd: pd.Series) -> pd.Series:
        out = []
        for k, p, t, f, s in zip(i, px, kind, factor, sd, strict=True):
            x = np.asarray(p, float)
            x = K.scaled(x, f) if t in ("intensity", "combined") else x
            x = K.noisy(x, s, seed + int(k)) if t in ("noise", "combined") else x
            out.append(x.tolist())
        return pd.Series(out)

    return images.withColumn("changed", apply(F.col("id"), "pixels", "aug_type", "factor", "noise_sd"))


def inside_well(images: DataFrame, inset: int = 1) -> DataFrame:
    """(id, lit): pixels above 0 that are left inside the well's disc."""
    kind = dict(images.dtypes)["id"]

    def run(batches):
        for b in batches:
            out = [(r.id, int((K.well_mask(_grid(r.pixels, r.height, r.width), inset) > 0).sum())) for r in b.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["id", "lit"])

    return images.select("id", "pixels", "height", "width").mapInPandas(run, f"id {kind}, lit long")


STITCHED = "image string, length double, used array<int>, failed string"


def stitched(fragments: DataFrame, far: float = 110, turn: float = 110) -> DataFrame:
    """(image, length, used, failed) of fragments (image, idx, line): the cheapest chain that holds fragment 0."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        line, used, failed = K.stitch([np.array([(p["y"], p["x"]) for p in v], float) for v in g["line"]], far, turn)
        return pd.DataFrame([(g["image"].iloc[0], float(np.hypot(*np.diff(line, axis=0).T).sum()), used, failed)], columns=["image", "length", "used", "failed"])

    return fragments.groupBy("image").applyInPandas(run, STITCHED)
