"""Annotation data sets: three tables (images, annotations, categories) and the operations on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import measures as M
from ..functions import names as N
from . import ranking as R
from . import tables as T


def category_stats(annotations: DataFrame, category: str, area: str) -> DataFrame:
    """Count, percent of all, and area statistics (population SD) a category."""
    v = F.col(area)
    per = annotations.groupBy(category).agg(F.count("*").alias("n"), F.avg(v).alias("area_mean"), F.stddev_pop(v).alias("area_sd"), F.min(v).alias("area_min"), F.max(v).alias("area_max"))
    per = R.with_quantiles(per, annotations, [category], area, {"area_median": 0.5})
    return per.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def per_image(images: DataFrame, annotations: DataFrame, image: str) -> DataFrame:
    """Annotations an image over those that have any, and how many images have none."""
    n = annotations.groupBy(image).agg(F.count("*").alias("n"))
    stats = n.agg(F.count("*").alias("annotated"), F.avg("n").alias("mean"), F.coalesce(F.stddev_pop("n"), F.lit(0.0)).alias("sd"), F.min("n").alias("min"), F.max("n").alias("max"))
    stats = R.with_quantiles(stats, n, [], "n", {"median": 0.5}).select("annotated", "mean", "sd", "min", "max", "median")
    empty = images.select(image).distinct().join(n, image, "left_anti").agg(F.count("*").alias("empty"))
    return stats.join(empty)


def totals(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    a = images.agg(F.count("*").alias("images")).join(annotations.agg(F.count("*").alias("annotations")))
    return a.join(categories.agg(F.count("*").alias("categories"), F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names")))


def without_augmented(images: DataFrame, annotations: DataFrame, image: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Augmented images go, and their annotations with them."""
    gone = images.filter(N.is_augmented(F.col(name))).select(image)
    return images.join(gone, image, "left_anti"), annotations.join(gone, image, "left_anti")


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    n = df.groupBy(split).agg(F.count("*").alias("n"))
    return n.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def to_yolo(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(file_name, text): a label file's content an image; empty where an image has no usable annotation.

    images: image_id, file_name, width, height; annotations: image_id, ann_id, category_id, segment (flat pixels).
    """
    text = F.transform(F.col("xy"), lambda v: M.fixed(v))
    lines = (
        annotations.join(images.select("image_id", "width", "height"), "image_id")
        .withColumn("xy", G.normalized(F.col("segment"), F.col("width"), F.col("height"))).filter("xy is not null")
        .select("image_id", "ann_id", F.concat_ws(" ", F.col("category_id").cast("string"), F.array_join(text, " ")).alias("line"))
    )
    body = lines.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ann_id", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return images.select("image_id", "file_name").join(body, "image_id", "left").select("file_name", F.coalesce("text", F.lit("")).alias("text"))


def augmentation_plan(images: DataFrame, order: str, seed: int = 42, combined: bool = False) -> DataFrame:
    """What each image gets: types rotate by position modulo 3, or all at once; amounts from a seeded hash of the order key."""
    u = lambda k: F.pmod(F.xxhash64(F.col(order), F.lit(seed), F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    if combined:
        planned = images.withColumn("aug_type", F.lit("combined"))
    else:
        i = F.col("_at") - 1
        kind = F.when(i % 3 == 0, "intensity").when(i % 3 == 1, "noise").otherwise("rotation")
        planned = R.numbered(images, order, "_at").withColumn("aug_type", kind).drop("_at")
    return planned.withColumns({"factor": 0.7 + 0.6 * u(1), "noise_sd": 5 + 15 * u(2), "degrees": -15 + 30 * u(3)})


def roi_dataset(annotations: DataFrame, scale: float = 1.3, least: int = 32, out: int = 512, by_class: bool = False) -> DataFrame:
    """A square around each annotation, and every annotation of the same image that meets it, clipped later by clip_polygons.

    annotations: image_id, ann_id, category_id, polygon. One row for each (target, neighbour); the self-join is on the image.
    With by_class there is a data set for each class of target: `data_set` is that class, only neighbours of the same class
    stay, and their category is 0 there. `repaired` is the polygon as geometry.repaired gives it, made once an annotation.
    """
    b = G.bounds(F.col("polygon"))
    r = G.roi(b["x1"], b["y1"], b["x2"], b["y2"], scale, least)
    squares = annotations.select("image_id", F.col("ann_id").alias("target"), F.col("category_id").alias("target_category"), r["cx"].alias("cx"), r["cy"].alias("cy"), r["size"].alias("size"))
    squares = squares.withColumns({"rx1": F.col("cx").cast("int") - F.floor(F.col("size") / 2).cast("int"), "ry1": F.col("cy").cast("int") - F.floor(F.col("size") / 2).cast("int")})
    squares = squares.withColumns({"rx2": F.col("rx1") + F.col("size"), "ry2": F.col("ry1") + F.col("size"), "scale_factor": G.scale_factor(F.col("size"), F.lit(out))})
    pair = squares.join(annotations.select("image_id", "ann_id", "category_id", "polygon", G.repaired(F.col("polygon")).alias("repaired")), "image_id")
    if by_class:
        pair = pair.filter(F.col("category_id") == F.col("target_category")).withColumnRenamed("target_category", "data_set").withColumn("category_id", F.lit(0))
    meets = (F.col("ann_id") == F.col("target")) | G.meets_roi(F.col("polygon"), F.col("rx1"), F.col("ry1"), F.col("rx2"), F.col("ry2"))
    return pair.filter(meets)


def merge_report(annotations: DataFrame, categories: DataFrame, to: int = 0, name: str = "object") -> DataFrame:
    """One row of what making all categories one does: the original categories (a number, their names by id), annotations that
    change and all of them, and the category that is left. annotations: category_id; categories: id, name, unique ids."""
    a = annotations.agg(F.count_if(~F.col("category_id").eqNullSafe(F.lit(to))).alias("annotations_updated"), F.count("*").alias("total_annotations"))
    c = categories.agg(F.count("*").alias("original_categories"), F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("string"), "name"))).alias("category_mapping"))
    return a.join(c).select(F.lit(to).alias("merged_category_id"), F.lit(name).alias("merged_category_name"), "original_categories", "category_mapping", "annotations_updated", "total_annotations")


def clip_polygons(pairs: DataFrame, least_share: float = 0.001) -> DataFrame:
    """Rows of roi_dataset with `clip`: the polygon in fractions of its square, clipped to it. The target is not cut; its
    points are moved to the nearest inside. Neighbours are repaired first (geometry.repaired); what is left of them below
    least_share of the square, or with fewer than three points, goes. Points within 1e-6 of the last one kept are left out.
    """
    side, own = F.col("size").cast("double"), F.col("ann_id") == F.col("target")
    x = pairs.withColumn("_own", own).withColumn("_simple", F.when(own, F.col("polygon")).otherwise(F.col("repaired")))
    x = x.withColumn("_cut", F.when(F.col("_own"), F.col("_simple")).otherwise(G.clipped(F.col("_simple"), *(F.col(c).cast("double") for c in ("rx1", "ry1", "rx2", "ry2")))))
    x = x.filter(F.col("_own") | (F.abs(G.signed_area(F.col("_cut"))) >= least_share * side * side))
    unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    scaled = F.transform("_cut", lambda p: F.struct(unit((p["x"] - F.col("rx1")) / side).alias("x"), unit((p["y"] - F.col("ry1")) / side).alias("y")))
    x = x.withColumn("_clip", scaled).withColumn("clip", F.when(F.col("_own"), F.col("_clip")).otherwise(G.without_repeats(F.col("_clip"))))
    return x.filter(F.col("_own") | (F.size("clip") >= 3)).drop("_own", "_simple", "_cut", "_clip")


@dataclass
class Dataset:
    """images (image_id, file_name, width, height), annotations (image_id, ann_id, category_id, bbox, area), categories (id, name)."""

    images: DataFrame
    annotations: DataFrame
    categories: DataFrame

    @classmethod
    def from_coco(cls, doc: DataFrame) -> Dataset:
        images = doc.select(F.explode("images").alias("x")).select(F.col("x.id").alias("image_id"), "x.file_name", "x.width", "x.height")
        ann = doc.select(F.explode("annotations").alias("x")).select("x.image_id", F.col("x.id").alias("ann_id"), "x.category_id", "x.bbox", "x.area", "x.segmentation")
        return cls(images, ann, doc.select(F.explode("categories").alias("x")).select("x.id", "x.name"))

    def statistics(self) -> DataFrame:
        named = self.annotations.join(self.categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left")
        return category_stats(named, "name", "area")

    def flatten(self) -> Dataset:
        one = self.categories.sparkSession.createDataFrame([(0, "object")], "id int, name string")
        return Dataset(self.images, T.flattened(self.annotations, "category_id").drop("changed"), one)

    def split(self, ratio: float, seed: int = 42) -> tuple[Dataset, Dataset]:
        s = T.split(self.images, "image_id", ratio, seed)
        part = lambda name: (i := s.filter(F.col("split") == name).drop("split"), self.annotations.join(i.select("image_id"), "image_id", "left_semi"))
        return Dataset(*part("train"), self.categories), Dataset(*part("valid"), self.categories)

    def remove_augmented(self) -> Dataset:
        return Dataset(*without_augmented(self.images, self.annotations, "image_id", "file_name"), self.categories)

    def augment(self, seed: int = 42, combined: bool = False) -> DataFrame:
        return augmentation_plan(self.images, "image_id", seed, combined)

    def verify(self) -> DataFrame:
        """Problems as rows (kind, n): annotations without an image or a category, repeated ids."""
        a = self.annotations
        lost = a.join(self.images.select("image_id"), "image_id", "left_anti").agg(F.lit("no image").alias("kind"), F.count("*").alias("n"))
        bare = a.join(self.categories.select(F.col("id").alias("category_id")), "category_id", "left_anti").agg(F.lit("no category").alias("kind"), F.count("*").alias("n"))
        twice = a.groupBy("ann_id").count().filter("count > 1").agg(F.lit("repeated id").alias("kind"), F.count("*").alias("n"))
        return lost.union(bare).union(twice)
