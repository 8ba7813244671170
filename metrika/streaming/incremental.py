"""Measuring or summarizing files as they arrive. An extension of this library: a stream over the same expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, form: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files_a_batch).load(folder)


def windowed(events: DataFrame, time: str, late: str, width: str, by: str, value: str) -> DataFrame:
    """Count and sum a window and group; rows later than `late` are left out and closed windows leave the state."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handles all that is there by now and ends; each batch goes to sink once, by the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


def copy_with_column(stream: DataFrame, key: str, names: DataFrame, column: str, out: str, checkpoint: str, form: str = "csv") -> None:
    """Copies all rows that are there by now to files under out, with `column` (added, or overwritten in its place) from names
    (hosted, original): by the exact key, else in lower case; NULL where neither is known. A stream-static join.

    The file sink lists a batch's files in its log, so whoever reads out by Spark sees each row once, also after a batch
    that failed half-way and ran again; another call takes up where the checkpoint stands. A key column that the stream
    lacks is an error. `names` is read anew in each batch.
    """
    from ..operators import tables as T

    if key not in stream.columns:
        raise ValueError(f"column {key!r} not found in {stream.columns}")
    exact = T.keep_first(names.select(F.col("hosted").alias("_h"), F.col("original").alias("_o")), ["_h"], ["_o"])
    lower = T.keep_first(names.select(F.lower("hosted").alias("_lh"), F.col("original").alias("_lo"), F.col("hosted").alias("_from")), ["_lh"], ["_from", "_lo"])
    x = stream.join(exact, F.col(key) == F.col("_h"), "left").join(lower, F.lower(key) == F.col("_lh"), "left")
    found = F.coalesce("_o", "_lo")
    order = [found.alias(column) if c == column else F.col(f"`{c}`") for c in stream.columns]
    x = x.select(*order, *([] if column in stream.columns else [found.alias(column)]))
    q = x.writeStream.format(form).option("path", out).option("checkpointLocation", checkpoint).option("header", True).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
