"""Tables that rounds of a job hand on: written to the folder that driver and executors share, so that no lost executor
undoes them and no plan grows with the rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; a fresh local one where none is set and all runs on one machine, else an error."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.sparkContext.getConf().get(SETTING) or (own.get() if own.isDefined() else None) or getattr(spark.sparkContext, "_metrika_dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="metrika-")
        spark.sparkContext._metrika_dir = named
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by those columns over at least four tasks a core: a small table comes in few pieces, which would keep few cores
    where each of its rows is much work."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def spent(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(("file:", "hdfs:", "s3", "abfs", "gs:", "viewfs:", "/")) and re.search(r"-[0-9a-f]{32}$", path):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
