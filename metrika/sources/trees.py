"""Annotated data sets under a root, as a data source: <root>/<subset>/<split>/images, labels and roi_catalog.json."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions import names as N
from .files import IMAGES, image_files

DATA_SETS = "subset string, split string, images string, labels string, output string, catalog string, n_images long, n_labels long, status string"


class Split(InputPartition):
    def __init__(self, subset: str, split: str, folder: str):
        self.subset, self.split, self.folder = subset, split, folder


def opened(path: str):
    """(file system, path on it) of a URI or a local path; whatever pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds, sorted; nothing if it isn't there."""
    from pyarrow import fs

    where, at = opened(path)
    found = where.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.base_name, f.type == fs.FileType.Directory) for f in found)


class DataSetReader(DataSourceReader):
    """One partition a (subset, split), listed on its executor."""

    def __init__(self, options):
        self.root, self.output = options["path"].rstrip("/"), options.get("output", "skeleton")
        self.wanted: dict[str, set] = {}

    def partitions(self) -> list[InputPartition]:
        where, at = opened(self.root)
        if not where.get_file_info(at).type:
            raise FileNotFoundError(self.root)
        subsets = [n for n, folder in listed(self.root) if folder]
        fits = lambda kind, name: name in self.wanted.get(kind, {name})
        return [
            Split(s, t, f"{self.root}/{s}/{t}")
            for s in subsets if fits("subset", s)
            for t, folder in listed(f"{self.root}/{s}") if folder and fits("split", t)
        ]

    def read(self, partition: Split):
        if partition is None or not hasattr(partition, "folder"):
            return
        own = dict(listed(partition.folder))
        at = partition.folder
        counts, missing = [], []
        for part, kinds in (("images", IMAGES), ("labels", ("txt",))):
            if own.get(part):
                counts.append(sum(not d and n.lower().rpartition(".")[2] in kinds for n, d in listed(f"{at}/{part}")))
            else:
                counts.append(None)
                missing.append(part)
        catalog = f"{at}/roi_catalog.json" if own.get("roi_catalog.json") is False else None
        images, labels = (None if p in missing else f"{at}/{p}" for p in ("images", "labels"))
        yield (partition.subset, partition.split, images, labels, f"{at}/{self.output}", catalog, *counts, f"missing: {', '.join(missing)}" if missing else "ok")


class PushingReader(DataSetReader):
    """Equalities on subset and split are answered by not making the other partitions."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            one = isinstance(f, EqualTo) or isinstance(f, In)
            if one and len(f.attribute) == 1 and f.attribute[0] in ("subset", "split"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], values) & values
            else:
                yield f


class DataSets(DataSource):
    """format("metrika_data_sets").load(root): a row a (subset, split), complete or not."""

    @classmethod
    def name(cls) -> str:
        return "metrika_data_sets"

    def schema(self) -> str:
        return DATA_SETS

    def reader(self, schema) -> DataSetReader:
        return (PushingReader if self.options.get("pushdown") == "true" else DataSetReader)(self.options)


def data_sets(spark: SparkSession, root: str, split: str | None = None, subsets: list[str] | None = None, output: str = "skeleton") -> DataFrame:
    """Data sets under a root, of one split and some subsets if these are named; `status` says what a data set lacks.

    Where the session pushes filters into Python sources (as get_spark's does), only the folders that are asked for are
    listed. A root that isn't there is an error when rows are asked for. The catalog is optional and NULL where there is none.
    """
    spark.dataSource.register(DataSets)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    out = spark.read.format(DataSets.name()).option("output", output).option("pushdown", pushdown).load(root)
    if split is not None:
        out = out.filter(F.col("split") == split)
    return out if subsets is None else out.filter(F.col("subset").isin(*subsets))


def usable(sets: DataFrame) -> DataFrame:
    """The complete data sets; none at all is an error, when rows are asked for."""
    n = sets.agg(F.count_if(F.col("status") == "ok").alias("_n"))
    found = F.when(F.col("_n") > 0, True).otherwise(F.raise_error(F.lit("no data set with images and labels")).cast("boolean"))
    return n.withColumn("_ok", found).filter("_ok").join(sets.filter("status = 'ok'")).select(*sets.columns)


def found_images(spark: SparkSession, names: DataFrame, folder: str, name: str = "file_name") -> DataFrame:
    """names with `path`: the image of that name right under the folder, else the first one, by path, at any depth below it
    whose path ends in the name; NULL where there is none. Names may hold folders."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    plain = F.regexp_replace("path", "^file:/*", "file:/")
    below = F.substring(plain, len(root.replace("file:///", "file:/")) + 2, 1 << 20)
    files = image_files(spark, folder, recursive=True).select("path", below.alias("_below"), N.basename(F.col("path")).alias("_base"))
    wanted = names.select(F.col(name).alias("_name")).distinct().withColumn("_base", N.basename(F.col("_name")))
    met = wanted.join(files, "_base").filter((F.col("_below") == F.col("_name")) | F.endswith("_below", F.concat(F.lit("/"), "_name")))
    first = met.groupBy("_name").agg(F.min(F.struct((F.col("_below") != F.col("_name")).alias("deep"), "path")).alias("m")).select("_name", F.col("m.path").alias("path"))
    return names.join(first, F.col(name) == F.col("_name"), "left").drop("_name")
