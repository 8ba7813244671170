"""Queries that go through files: the driver's tables are written as the library's files and read back by its readers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators import curation as C
from ..shared import shared_dir, spread
from ..sources import files as S
from ..sources import named_files as W
from ..sources import pictures as I
from ..sources import sinks as K
from .registry import query, table


#: Files that are written and read at a time: the driver lists every file that Spark's sources read.
PASS_FILES = 32_768


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def in_passes(df: DataFrame, key: str, run: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """The rows of run(part) for all parts of df, which are dealt by the key and have about `most` rows each.

    The parts are written once, a folder each, and run one after the other, each on all cores; so what the driver knows of
    one part's files is gone when the next one starts, however many parts there are. The rows of all parts are one table.
    """
    s, n = df.sparkSession, -(-df.count() // most)
    if n <= 1:
        return run(df)
    parts, out = folder(s, "parts"), folder(s, "of-parts")
    df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition("part").write.partitionBy("part").parquet(parts)
    for p in range(n):
        part = s.read.schema(StructType([*df.schema, StructField("part", IntegerType())])).parquet(parts).filter(F.col("part") == p).drop("part")
        done = run(spread(part, key))
        done.write.mode("append").parquet(out)
    return s.read.schema(done.schema).parquet(out)


@query("""WITH p AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, CAST(least(255, floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 600)) AS BIGINT) AS v FROM embeddings, range(64) t(i)),
d AS (SELECT vec_id, vec_id % 6 + (2 + vec_id % 4) / 2 AS cx, vec_id % 5 + 1.5 AS cy, greatest(4, CAST(trunc(greatest(2 + vec_id % 4, 3) * 1.2) AS BIGINT)) AS size FROM embeddings),
r AS (SELECT *, CAST(trunc(cx) AS BIGINT) - size // 2 AS l, CAST(trunc(cy) AS BIGINT) - size // 2 AS t FROM d)
SELECT 'im' || r.vec_id || '_roi_0.png' AS name, CAST(size AS INTEGER) AS size, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (1 + x - l + (y - t) * size)) AS BIGINT) AS placed
FROM r JOIN p ON p.vec_id = r.vec_id AND x BETWEEN l AND l + size - 1 AND y BETWEEN t AND t + size - 1 GROUP BY ALL""")
def s23_k5_cut_outs(s, d):
    """Gray images of the vectors as PNG files, decoded, cut out and written as PNG files, decoded again; the sum of a cut-out's
    bytes and of each byte times its place, from 1."""
    byte = lambda v: F.lpad(F.hex(F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 600)).cast("int")), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", byte), ""))

    def run(vectors: DataFrame) -> DataFrame:
        raw, cut = folder(s, "images"), folder(s, "cut-outs")
        W.write_files(vectors.select(F.concat(F.lit("im"), "vec_id", F.lit(".png")).alias("name"), I.as_png(data, F.lit(8), F.lit(1)).alias("content")), raw)
        images = I.pictures(s, raw)
        k = F.regexp_extract("path", r"im(\d+)\.png$", 1).cast("long")
        box = {"x1": k % 6, "y1": k % 5, "x2": k % 6 + 2 + k % 4, "y2": k % 5 + 3}
        found = images.select("path", F.lit(0).alias("detection_index"), *(v.cast("double").alias(n) for n, v in box.items()))
        cuts = I.rois(images, found, 1.2, 4)
        W.write_files(cuts.select("name", I.as_png(F.col("data"), F.col("size"), F.col("channels")).alias("content")), cut)
        bytes_ = I.pictures(s, cut).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("width").alias("size"), F.posexplode(I.gray(F.col("data"), F.col("channels"))).alias("i", "v"))
        return bytes_.groupBy("name", "size").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("i") + 1)).alias("placed"))

    return in_passes(table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", run, PASS_FILES)


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS run FROM lineitem WHERE (l_returnflag = 'A' AND l_quantity > 25) OR l_returnflag = 'N'")
def k9_published_runs(s, d):
    """All runs are published, then A with fewer rows and R with none."""
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_returnflag").alias("run"))
    runs, out = rows.select("run").distinct(), folder(s, "matches")
    K.publish(rows.drop("l_quantity"), out, runs, form="parquet")
    K.publish(rows.filter("run = 'A' and l_quantity > 25").drop("l_quantity"), out, runs.filter("run <> 'N'"), form="parquet")
    return s.read.parquet(out).select("l_orderkey", "l_linenumber", "run")


@query("""SELECT l_returnflag AS category, count(*) AS n, count(CASE WHEN l_linenumber <> 3 THEN 1 END) AS measured, round(avg(CASE WHEN l_linenumber <> 3 THEN l_quantity END), 6) AS length, round(sum(l_extendedprice), 2) AS width FROM lineitem GROUP BY 1""")
def s10_s31_measurement_files(s, d):
    """Measurement files, one folder a category, some values nan; lengths by the columns that are there."""
    out = folder(s, "measurements")
    x = table(s, d, "lineitem").select(
        F.concat("l_orderkey", F.lit("_"), "l_linenumber", F.lit(".png")).alias("Filename"), *(F.lit(None).cast("string").alias(c) for c in ("Date", "Metadata_Experiment", "Metadata_Plate", "Magnification", "Metadata_Well")),
        F.col("l_linenumber").cast("string").alias("Worm_ID"), F.when(F.col("l_linenumber") == 3, float("nan")).otherwise(F.col("l_quantity").cast("double")).alias("Length_um"), F.col("l_extendedprice").cast("double").alias("Width_um"),
        F.lit("").alias("Topology_Warnings"), F.col("l_returnflag").alias("kind"),
    )
    x.write.partitionBy("kind").option("header", True).option("nanValue", "nan").csv(out)
    m = S.sized_measurements(S.measurements(s, f"{out}/kind=*/*.csv").withColumn("category", F.regexp_replace("category", "^kind=", "")))
    return m.groupBy("category").agg(F.count("*").alias("n"), F.count("length_um").alias("measured"), F.round(F.avg("length_um"), 6).alias("length"), F.round(F.sum("width_um"), 2).alias("width"))


@query("""SELECT o_orderstatus AS name, count(*) AS n, round(avg(o_totalprice), 4) AS area_mean, round(quantile_cont(o_totalprice, 0.5), 4) AS area_median, round(100.0 * count(*) / (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey), 6) AS percent
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def s8_coco_files(s, d):
    """An annotation file a nation: its customers are the images, their orders the annotations."""
    out = folder(s, "coco")
    c, o = table(s, d, "customer").select("c_custkey", "c_nationkey"), table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    names = F.array(*(F.lit(x) for x in ("F", "O", "P")))
    image = F.struct(F.col("c_custkey").cast("long").alias("id"), F.lit(1).alias("width"), F.lit(1).alias("height"), F.concat(F.lit("c"), "c_custkey").alias("file_name"))
    mark = F.struct(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("image_id"), (F.array_position(names, F.col("o_orderstatus")) - 1).cast("int").alias("category_id"), F.array().cast("array<double>").alias("bbox"), F.col("o_totalprice").cast("double").alias("area"), F.lit("").alias("segmentation"))
    per = c.groupBy("c_nationkey").agg(F.collect_list(image).alias("images"))
    marks = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("_n")).agg(F.collect_list(mark).alias("annotations"))
    kinds = F.transform(names, lambda x, i: F.struct(i.alias("id"), x.alias("name"), F.lit("").alias("supercategory")))
    doc = per.join(marks, F.col("c_nationkey") == F.col("_n"), "left").select(F.concat(F.lit("n"), "c_nationkey", F.lit(".json")).alias("name"), F.to_json(F.struct("images", F.coalesce("annotations", F.array()).alias("annotations"), kinds.alias("categories"))).alias("content"))
    W.write_files(doc, out)
    sets = C.Dataset.from_coco(S.coco(s, out))
    stats = C.Dataset(sets.images, sets.annotations, sets.categories.distinct()).statistics()
    return stats.select("name", "n", F.round("area_mean", 4).alias("area_mean"), F.round("area_median", 4).alias("area_median"), F.round("percent", 6).alias("percent"))


@query("SELECT l_returnflag AS human_dir, CAST(count(*) AS INTEGER) AS num_human_masks, CAST(count(*) FILTER (l_linenumber = 1) AS INTEGER) AS num_matched, round(avg(l_discount), 6) AS mean_iou FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def s15_k10_summary_files(s, d):
    """A summary file a run; the one of run R is not there."""
    out = folder(s, "summaries")
    x = table(s, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_returnflag").alias("human_dir")).agg(F.count("*").cast("int").alias("num_human_masks"), F.count_if(F.col("l_linenumber") == 1).cast("int").alias("num_matched"), F.avg("l_discount").alias("mean_iou_of_matches"))
    W.write_files(x.select(F.concat("human_dir", F.lit(".json")).alias("name"), F.to_json(F.struct(*x.columns)).alias("content")), out)
    back = S.summaries(s, [f"{out}/{k}.json" for k in "ANR"])
    return back.select("human_dir", "num_human_masks", "num_matched", F.round("mean_iou_of_matches", 6).alias("mean_iou"))


@query("""WITH f AS (SELECT 's' || s_suppkey || '.' || ['jpg', 'PNG', 'tiff', 'txt', 'Bmp'][s_suppkey % 5 + 1] AS name FROM supplier)
SELECT name, lower(split_part(name, '.', 2)) <> 'tiff' AS short FROM f WHERE name NOT LIKE '%.txt'""")
def s1_s3_a41_image_listing(s, d):
    """Image files of a folder, and whether the shorter list of extensions has them too."""
    out = folder(s, "listing")
    kinds = F.array(*(F.lit(x) for x in ("jpg", "PNG", "tiff", "txt", "Bmp")))
    W.write_files(table(s, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit("."), F.get(kinds, (F.col("s_suppkey") % 5).cast("int"))).alias("name"), F.lit("x").alias("content")), out)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    short = S.short_image_files(s, out).select(base.alias("name"), F.lit(True).alias("short"))
    return S.image_files(s, out).select(base.alias("name")).join(short, "name", "left").select("name", F.coalesce("short", F.lit(False)).alias("short"))


@query("SELECT 'raw/' || s_suppkey || '.tif' AS path FROM supplier WHERE s_suppkey % 3 = 0")
def s2_s4_listed_images(s, d):
    """The only batch list of a folder without raw images; blanks and other files in it are left out."""
    out, k = folder(s, "batch"), F.col("s_suppkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("  raw/"), k, F.lit(".tif "))).when(k % 3 == 1, F.lit("   ")).otherwise(F.concat(F.lit("raw/"), k, F.lit(".csv")))
    table(s, d, "supplier").select(line.alias("value")).write.text(f"{out}/batch_1.txt")
    return S.inputs(s, out)


@query("""SELECT count(DISTINCT l_returnflag) AS original_categories, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS names, count(*) FILTER (l_returnflag <> 'A') AS annotations_updated, count(*) AS total_annotations FROM lineitem""")
def k23_merge_report(s, d):
    """All categories become one; the report is written as JSON and read back."""
    out, flags = folder(s, "report"), F.array(*(F.lit(x) for x in "ANR"))
    marks = table(s, d, "lineitem").select((F.array_position(flags, F.col("l_returnflag")) - 1).cast("int").alias("category_id"))
    kinds = table(s, d, "lineitem").select(F.col("l_returnflag").alias("name")).distinct().select((F.array_position(flags, F.col("name")) - 1).cast("int").alias("id"), "name")
    K.json_lines(C.merge_report(marks, kinds, 0, "object"), out)
    back = s.read.schema("original_categories long, category_mapping map<string,string>, annotations_updated long, total_annotations long").json(out)
    return back.select("original_categories", F.array_join(F.sort_array(F.map_values("category_mapping")), ",").alias("names"), "annotations_updated", "total_annotations")
