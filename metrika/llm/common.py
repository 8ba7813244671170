"""What the operators share: the cluster's shared folder, written tables, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import spent

SETTING = "spark.checkpoint.dir"
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, a fresh local one on one machine; an error on a cluster."""
    named = spark.sparkContext.getConf().get(SETTING) or getattr(spark.sparkContext, "_metrika_dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{SETTING} must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="metrika-")
        spark.sparkContext._metrika_dir = named
    return named.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Meanwhile, an Arrow batch brings BATCH_BYTES to a Python worker at most; then the session is as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and reread: lineage is cut and no executor's loss undoes it."""
    path = table_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that none can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def same(a: str, b: str, keys: list[str]) -> Column:
    """Null-safe equality of the columns keys of the aliases a and b."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Each round takes the smallest label of a label among neighbours, pre-aggregated before the shuffle, and gives it to the
    node, to the node's label too (so that whole trees are hooked, as in FastSV), then follows the label's own label. Chains
    of any order take a number of rounds near the logarithm of their length. Labels only fall; the rounds end when none did.
    A round's tables are deleted when the next one's stand. Self-loops are allowed; an empty edge table gives an empty result.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(),
        "edges",
    )
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    moved = True
    while moved:
        to = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        far = written(labels.join(to, "component").select("node", "component", "next"), "labels-far")
        near = both.join(far.select(F.col("node").alias("b"), "next"), "b").groupBy("a").agg(F.min("next").alias("m"))
        low = far.join(near, far["node"] == near["a"]).select("node", "component", F.least("next", "m").alias("c"))
        given = F.explode(F.array(
            F.struct("node", F.col("component").alias("was"), "c"),
            F.struct(F.col("component").alias("node"), F.lit(None).cast(labels.schema["component"].dataType).alias("was"), "c"),
        )).alias("g")
        new = written(
            low.select(given).groupBy("g.node").agg(F.max("g.was").alias("was"), F.min("g.c").alias("component")), "labels"
        )
        moved = not new.filter("component <> was").isEmpty()
        spent(labels)
        spent(far)
        labels = new.select("node", "component")
    spent(both)
    return labels


def text_slices(batch, most: int = 1 << 20, rows: int = 64):
    """(ids, texts) of slices of an Arrow batch (id, text) of about `most` characters; a longer text stands alone.

    Texts become Python strings `rows` at a time, so that the batch is never there twice.
    """
    ids, at, size, texts = batch.column(0), 0, 0, []
    for k in range(0, len(batch), rows):
        for t in batch.column(1).slice(k, rows).to_pylist():
            if size and size + len(t) > most:
                yield ids.slice(at, len(texts)), texts
                at, size, texts = at + len(texts), 0, []
            texts.append(t)
            size += len(t)
    if texts:
        yield ids.slice(at), texts
