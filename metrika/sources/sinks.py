"""Writers. Tables are the contract; files that other tools read are made from text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..functions import names as N


def measurement_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nanValue", "nan").option("emptyValue", "").csv(path)


def catalog_json(df: DataFrame, key: str = "name", per: str | None = None) -> DataFrame:
    """One row `value` for each data set (`per`; all rows are one without it): its catalog as a JSON object."""
    fields = [c for c in df.columns if c not in (key, per)]
    entry = F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value"))
    return df.groupBy(*([per] if per else [])).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def publish(df: DataFrame, path: str, runs: DataFrame, per: Sequence[str] = ("run",), form: str = "csv") -> None:
    """Replaces what a table holds of some runs: rows of df, one folder a run (its columns are `per`), and nothing of a run of
    `runs` (the same columns) that has no row. Runs that are in neither stay as they are.

    Only the folders of runs that have rows are written, each as a whole, so a second publishing leaves no row twice. A run
    of df that `runs` lacks is an error and nothing is written. What the driver gets is the runs without rows.
    """
    per = list(per)
    strange = df.select(*per).distinct().join(runs.select(*per), per, "left_anti")
    if not strange.isEmpty():
        raise ValueError(f"rows of runs that are not published: {strange.first()}")
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*per)
    writer.options(**({"header": True} if form == "csv" else {})).format(form).save(path)
    empty = runs.select(*per).distinct().join(df.select(*per).distinct(), per, "left_anti")
    escape = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in empty.toLocalIterator():
        _remove(df.sparkSession, "/".join([path.rstrip("/"), *(f"{c}={escape(str(row[c]))}" for c in per)]))


def estimate_tables(estimates: DataFrame, path: str) -> None:
    """<path>/<data set>: the estimates of each data set as CSV; <path>/comparison: a row a strain and a `value ± error` text a
    data set, with a byte-order mark before the header, for spreadsheets. estimates: dataset, strain, EC50, EC50_se, ..."""
    from ..operators.inference import ec_comparison

    estimates.withColumn("name", F.col("dataset")).write.mode("overwrite").partitionBy("name").option("header", True).csv(f"{path}/estimates")
    wide = ec_comparison(estimates).orderBy("strain")
    cell = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), '"', '""'), F.lit('"'))
    head = "\ufeff" + ",".join(wide.columns)
    lines = wide.select(F.col("strain").alias("k"), F.concat_ws(",", *(cell(c) for c in wide.columns)).alias("value"))
    first = wide.sparkSession.createDataFrame([(None, head)], "k string, value string")
    first.union(lines).orderBy(F.asc_nulls_first("k")).select("value").coalesce(1).write.mode("overwrite").text(f"{path}/comparison")


def speed_files(df: DataFrame, path: str, name: str, order: str, seconds: str, k: int, warm_up: int = 0, **more: str) -> None:
    """<path>/raw: batch_idx from 0, n_items and seconds with six decimals of each batch, as CSV; <path>/summary: one JSON
    object with the name, the statistics of tables.speed_summary and the fields of `more`."""
    from ..operators import tables as T

    sums = T.speed_batches(df, order, seconds, k, warm_up)
    raw = sums.select((F.col("batch") - 1).alias("batch_idx"), F.col("items").alias("n_items"), M.fixed(F.col("s")).alias("seconds"))
    raw.coalesce(1).orderBy("batch_idx").write.mode("overwrite").option("header", True).csv(f"{path}/raw")
    fields = [F.lit(name).alias("name"), "*", *(F.lit(v).alias(c) for c, v in more.items())]
    T.speed_summary(df, order, seconds, k, warm_up).select(*fields).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def predictions_json(detections: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """(path, content): what was detected in each image as a JSON list in the order of detection_index: box, confidence,
    class_id, class_name and, where areas (path, detection_index, area) has it, mask_area. Images without a detection, which
    have one row with a NULL index, give an empty list."""
    d = detections.select("path", "detection_index", "x1", "y1", "x2", "y2", "conf", "class_id")
    if areas is not None:
        a = areas.select(F.col("path").alias("_p"), F.col("detection_index").alias("_i"), F.col("area").cast("long").alias("mask_area"))
        d = d.join(a, (F.col("path") == F.col("_p")) & (F.col("detection_index") == F.col("_i")), "left")
    one = F.struct(
        F.array("x1", "y1", "x2", "y2").alias("box"), F.col("conf").alias("confidence"), "class_id", F.concat(F.lit("Class "), "class_id").alias("class_name"), *(["mask_area"] if areas is not None else []),
    )
    kept = F.collect_list(F.when(F.col("detection_index").isNotNull(), F.struct(F.col("detection_index").alias("i"), one.alias("p"))))
    return d.groupBy("path").agg(F.to_json(F.transform(F.sort_array(kept), lambda x: x["p"])).alias("content"))


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def contour_lines(points: DataFrame, most: int = 100) -> DataFrame:
    """(file, section, part, pos, x, y) to (file, text): contours thinned to at most `most` points, six decimals."""
    n = F.count("*").over(Window.partitionBy("file", "section", "part"))
    keep = (F.col("section") != "contour") | (F.col("n") <= most) | (F.floor(F.col("pos") * most / F.col("n")) != F.floor((F.col("pos") - 1) * most / F.col("n")))
    kept = points.withColumn("n", n).filter(keep)
    line = F.concat_ws(" ", M.fixed(F.col("x")), M.fixed(F.col("y")))
    parts = kept.groupBy("file", "section", "part").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    text = F.concat(F.lit("["), F.upper("section"), F.lit("]\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return parts.select("file", "section", "part", text.alias("t")).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "part", "t"))), lambda x: x["t"]), "\n").alias("text"))


def yolo_line(class_id: Column, xy: Column) -> Column:
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(F.transform(xy, lambda v: M.fixed(v)), " "))


def data_yaml(names: list[str], train: str = "train/images", valid: str = "valid/images", test: str | None = None) -> str:
    lines = [f"train: {train}", f"val: {valid}", *([f"test: {test}"] if test else []), f"nc: {len(names)}", "names:"]
    return "\n".join([*lines, *(f"  {i}: {n}" for i, n in enumerate(names))]) + "\n"


def text_files(df: DataFrame, path: str) -> None:
    df.select("text").write.mode("overwrite").text(path)


def report(stats: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Fixed-width lines of a statistics table."""
    cells = [F.lpad(M.fixed(F.col(c), 3), 12, " ") for c in columns]
    return stats.select(F.concat(F.rpad(F.col(label), 40, " "), *cells).alias("text"))


def iou_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Wide matrix of a bounded set of right-hand objects; the long form has no bound."""
    return pairs.groupBy("a").pivot("b", columns).agg(F.coalesce(F.max("iou"), F.lit(0.0)))


def versioned(df: DataFrame, root: str, version: str) -> None:
    """A backup of annotations under version=<time>."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")


def latest(df: DataFrame, version: str | None = None) -> DataFrame:
    """The rows of the newest version, or of the one named."""
    if version is not None:
        return df.filter(F.col("version") == version)
    return df.join(df.agg(F.max("version").alias("_v")), F.col("version") == F.col("_v")).drop("_v")


def copy_status(wanted: DataFrame, have: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """What a copy job would do with each wanted file: ok, missing or skipped, and how many of each."""
    h, d = have.select(F.col(key).alias("_h")).distinct(), done.select(F.col(key).alias("_d")).distinct()
    x = wanted.join(h, F.col(key) == F.col("_h"), "left").join(d, F.col(key) == F.col("_d"), "left")
    return x.withColumn("status", F.when(F.col("_d").isNotNull(), "skipped").when(F.col("_h").isNull(), "missing").otherwise("ok")).groupBy("status").agg(F.count("*").alias("n"))


def ranked_manifest(top: DataFrame) -> DataFrame:
    return top.withColumn("target", N.ranked_name(F.col("rank"), F.col("percent"), F.col("category"), F.col("file")))
