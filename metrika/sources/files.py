"""Readers of image folders, manifests, annotation files, mapping tables, logs and measurement tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import schemas
from ..functions import measures as M
from ..functions import names as N

#: Image extensions, and the order in which candidates for one stem are tried.
IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
#: Fixed value: modules of a timing log that only read, write or draw.
IO_MODULES = ("LoadData", "RescaleIntensity", "OverlayOutlines", "SaveImages")
SHORT_IMAGES = ("jpg", "jpeg", "png", "bmp")


def _is(kinds: tuple[str, ...], path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(*kinds)


def image_files(spark: SparkSession, folder: str, kinds: tuple[str, ...] = IMAGES, recursive: bool = False, content: bool = False) -> DataFrame:
    """(path, length[, content]) of the images of a folder, extensions in any case, each path once."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).filter(_is(kinds))
    return df.select("path", "length", *(["content"] if content else [])).orderBy("path")


def short_image_files(spark: SparkSession, folder: str) -> DataFrame:
    return image_files(spark, folder, SHORT_IMAGES)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path) of a list file: trimmed, without blanks, images only."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter(F.col("path") != "").filter(_is(IMAGES))


def hadoop_list(spark: SparkSession, pattern: str) -> list[tuple[str, bool]]:
    """(path, is a folder) of what a glob pattern matches, by the session's own file systems, sorted."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted((s.getPath().toString(), s.isDirectory()) for s in found)


def inputs(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's raw_images, else its only batch_*.txt; none or several of those are an error."""
    if any(d for _, d in hadoop_list(spark, f"{folder}/raw_images")):
        return image_files(spark, f"{folder}/raw_images").select("path")
    lists = hadoop_list(spark, f"{folder}/batch_*.txt")
    if len(lists) != 1:
        raise FileNotFoundError(f"{folder}: no raw_images, and {len(lists)} batch lists instead of one")
    return manifest(spark, lists[0][0])


def folders(spark: SparkSession, root: str) -> list[str]:
    """Names of the sub-folders, sorted; a missing root is an error."""
    if not hadoop_list(spark, root):
        raise FileNotFoundError(root)
    return [p.rstrip("/").rsplit("/", 1)[1] for p, d in hadoop_list(spark, f"{root}/*") if d]


def roi_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A row for each region of a catalog file: name and its fields; no rows if the file is missing or can't be read."""
    text = spark.read.text(path, wholetext=True) if hadoop_list(spark, path) else spark.createDataFrame([], "value string")
    return from_catalog_text(text)


def from_catalog_text(text: DataFrame) -> DataFrame:
    return text.select(F.explode(F.from_json("value", schemas.CATALOG)).alias("name", "r")).select("name", "r.*")


def yolo_lines(text: DataFrame, clip: bool = False) -> DataFrame:
    """Label lines (file, line, value) to (file, line, class_id, pts): lines under seven fields or with an odd coordinate go."""
    parts = F.split(F.trim("value"), r"\s+")
    good = (F.size(parts) >= 7) & (F.size(parts) % 2 == 1)
    xs = F.transform(F.slice(parts, 2, 1 << 20), lambda v: v.try_cast("double"))
    xs = F.transform(xs, lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))) if clip else xs
    from ..functions.geometry import points

    return text.filter(good).select("file", "line", F.get(parts, 0).try_cast("double").cast("int").alias("class_id"), points(xs).alias("pts"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COCO).json(path, multiLine=True)


def contour_text(text: DataFrame) -> DataFrame:
    """Sectioned text (file, value) to (file, section, part, pos, x, y). Lines of other than two numbers are ignored;
    `part` counts a file's sections of one kind from 0, `pos` the points of a part."""
    from pyspark.sql import Window

    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "raw")).select("file", "n", F.trim("raw").alias("raw"))
    per = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("raw").isin("[CONTOUR]", "[SKELETON]"), F.col("raw"))
    w = lines.withColumn("section", F.last(mark, True).over(per)).withColumn("k", F.count(mark).over(per))
    first = Window.partitionBy("file", "section").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("part", (F.count(mark).over(first) - 1).cast("int"))
    xy = F.split("raw", r"\s+")
    pts = w.filter((F.size(xy) == 2) & mark.isNull() & F.col("section").isNotNull()).select("file", "section", "part", "k", "n", F.get(xy, 0).try_cast("double").alias("x"), F.get(xy, 1).try_cast("double").alias("y"))
    pts = pts.filter("x is not null and y is not null")
    pos = F.row_number().over(Window.partitionBy("file", "k").orderBy("n")) - 1
    return pts.select("file", F.lower(F.regexp_replace("section", r"[\[\]]", "")).alias("section"), "part", pos.alias("pos"), "x", "y")


def measurements(spark: SparkSession, pattern: str) -> DataFrame:
    """Measurement CSVs, one folder a category; `category` from the path, nan as NULL."""
    df = spark.read.schema(schemas.MEASUREMENTS).csv(pattern, header=True)
    df = df.withColumns({c: M.number(F.col(c)) for c in ("Length_um", "Width_um")})
    return df.withColumn("category", F.substring_index(F.substring_index(F.input_file_name(), "/", -2), "/", 1))


def normalized_headers(df: DataFrame, lower: bool = True) -> DataFrame:
    """Column names without CR, LF and spaces, in lower case if asked."""
    clean = ["".join(c.split()) for c in df.columns]
    return df.toDF(*(c.lower() if lower else c for c in clean))


def resolve(df: DataFrame, *candidates: str) -> str:
    """The first candidate column that is there; KeyError if none is."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} in {df.columns}")


def external_tool(df: DataFrame) -> DataFrame:
    """(file, x1, y1, x2, y2, length_um) of another tool's wide table; missing columns are an error, numbers are truncated."""
    x = normalized_headers(df, lower=False)
    need = ["FileName_RoboFlow", *(f"po_AreaShape_BoundingBox{m}imum_{a}" for m in ("Min", "Max") for a in "XY"), "worm_length_um"]
    if missing := [c for c in need if c not in x.columns]:
        raise KeyError(f"missing columns: {missing}")
    whole = [F.col(c).try_cast("double").cast("int").alias(n) for c, n in zip(need[1:5], ("x1", "y1", "x2", "y2"), strict=True)]
    return x.select(F.col(need[0]).alias("file"), *whole, M.number(F.col("worm_length_um")).alias("length_um"))


def name_map(text: DataFrame, original_first: bool = False) -> DataFrame:
    """Two columns by tab, else by white space, to (hosted, original); lines with fewer go."""
    tab, space = F.split("value", "\t"), F.split(F.trim("value"), r"\s+")
    parts = F.when(F.size(tab) >= 2, tab).otherwise(space)
    a, b = F.trim(F.get(parts, 0)), F.trim(F.get(parts, 1))
    out = text.filter(F.size(parts) >= 2).select((b if original_first else a).alias("hosted"), (a if original_first else b).alias("original"))
    return out.filter("hosted <> '' and original <> ''")


def summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Matching summaries; paths that aren't there are skipped."""
    there = [p for p in paths if hadoop_list(spark, p)]
    if not there:
        return spark.createDataFrame([], schemas.SUMMARY)
    return spark.read.schema(schemas.SUMMARY).json(there, multiLine=True)


def decoded_log(files: DataFrame) -> DataFrame:
    """binaryFile rows to (path, value): UTF-16 by its mark or its zero bytes, else UTF-8."""
    head = F.hex(F.substring("content", 1, 2))
    wide = head.isin("FFFE", "FEFF") | (F.substring(F.hex("content"), 3, 2) == "00")
    text = F.when(wide & (head == "FEFF"), F.decode("content", "UTF-16BE")).when(wide, F.decode("content", "UTF-16LE")).otherwise(F.decode("content", "UTF-8"))
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("value"))


def timing_records(text: DataFrame) -> DataFrame:
    """`Image # n, module M # k: CPU_time = s secs, Wall_time = s secs` records to (img, module, cpu, wall)."""
    form = r"Image # ([0-9]+), module (\S+) # [0-9]+:\s*CPU_time = ([0-9.]+) secs, Wall_time = ([0-9.]+) secs"
    hit = text.select(F.explode(F.regexp_extract_all("value", F.lit(form), F.lit(0))).alias("r"))
    g = lambda k: F.regexp_extract("r", form, k)
    return hit.select(g(1).cast("int").alias("img"), g(2).alias("module"), g(3).cast("double").alias("cpu"), g(4).cast("double").alias("wall"))


def wall_clock(lines: DataFrame, first: str, last: str, form: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Seconds between the first line that holds one marker and the last that holds the other; a line starts with its time."""
    at = F.try_to_timestamp(F.substring("value", 1, 19), F.lit(form))
    a = F.min(F.when(F.contains("value", F.lit(first)), at))
    b = F.max(F.when(F.contains("value", F.lit(last)), at))
    return lines.agg((F.unix_timestamp(b) - F.unix_timestamp(a)).alias("seconds"))


def censored(text: DataFrame) -> DataFrame:
    """Names to leave out: comments and blanks gone, folders and extensions off."""
    v = F.trim("value")
    return text.filter((v != "") & ~v.startswith("#")).select(N.without_extension(N.basename(v)).alias("stem")).distinct()


def first_there(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if hadoop_list(spark, p)), None)


def class_names(spec: dict) -> list[str]:
    """Names of a data-set description: a list, a map from id (gaps become class_i), or only a number of classes."""
    names = spec.get("names")
    if isinstance(names, dict):
        ids = {int(k): v for k, v in names.items()}
        return [ids.get(i, f"class_{i}") for i in range(max(ids) + 1)] if ids else []
    return list(names) if names else [f"class_{i}" for i in range(int(spec.get("nc", 0)))]


def plate_wells(spark: SparkSession, n: int) -> DataFrame:
    """(i, plate, well) of n images over 96-well plates."""
    return spark.range(n).select(F.col("id").alias("i"), (F.floor(F.col("id") / 96) + 1).alias("plate"), N.well_name(F.col("id") % 96).alias("well"))


def label_path(path) -> DataFrame:
    """The label file of an image: its last `images` folder becomes `labels`, its extension txt."""
    return F.regexp_replace(F.regexp_replace(path, r"^(.*)/images/", "$1/labels/"), r"\.[^./]*$", ".txt")


def raw_candidates(rois: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): the raw image of each cut-out by its stem, extensions tried in order."""
    from pyspark.sql import Window

    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    order = reduce(lambda a, k: a.when(kind == k[1], k[0]), list(enumerate(IMAGES))[1:], F.when(kind == IMAGES[0], 0))
    f = files.select("path", N.without_extension(N.basename(F.col("path"))).alias("stem"), order.alias("o")).filter("o is not null")
    w = Window.partitionBy("stem").orderBy("o", "path")
    f = f.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return rois.withColumn("stem", N.source_stem(F.col("name"))).join(f.select("stem", "path"), "stem", "left").select("name", "path")


def broadcast_runs(**columns: list | str) -> list[dict]:
    """Run specifications from scalars and lists: one value goes to all runs; other lengths must agree."""
    lists = {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in columns.items()}
    n = max(map(len, lists.values()))
    if bad := [k for k, v in lists.items() if len(v) not in (1, n)]:
        raise ValueError(f"lengths differ from {n}: {bad}")
    return [{k: v[i if len(v) == n else 0] for k, v in lists.items()} for i in range(n)]


def data_set_format(spark: SparkSession, folder: str) -> str:
    """coco, yolo, voc or unknown, by the files of a split."""
    for kind, pattern in (("coco", "_annotations.coco.json"), ("yolo", "labels/*.txt"), ("voc", "*.xml")):
        if hadoop_list(spark, f"{folder}/{pattern}"):
            return kind
    return "unknown"


def checked_splits(spark: SparkSession, root: str, annotation: str = "_annotations.coco.json") -> list[str]:
    """Splits of a data set; train and valid must have their annotation file, test may."""
    for split in ("train", "valid"):
        if not hadoop_list(spark, f"{root}/{split}/{annotation}"):
            raise FileNotFoundError(f"{root}/{split}/{annotation}")
    return ["train", "valid", *(["test"] if hadoop_list(spark, f"{root}/test/{annotation}") else [])]


def sized_measurements(df: DataFrame) -> DataFrame:
    """(length_um, width_um) by the columns that are there: micrometres, else original pixels, else cut-out pixels. Doubles are
    taken as they are; others are trimmed text."""
    for kind, factor in (("um", 1.0), ("original_px", M.UM_PER_PX), ("roi_px", M.UM_PER_PX)):
        names = {c.lower(): c for c in df.columns}
        if f"length_{kind}" in names and f"width_{kind}" in names:
            text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
            value = lambda c: M.number(F.col(c) if isinstance(df.schema[c].dataType, DoubleType) else text(c)) * factor  # noqa: B023, E731
            return df.withColumns({"length_um": value(names[f"length_{kind}"]), "width_um": value(names[f"width_{kind}"])})
    raise KeyError(f"no length and width columns in {df.columns}")
