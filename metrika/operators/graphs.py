"""Connected components by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import spent, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node that can be reached.

    Each round takes the smallest label of a label among neighbours, aggregated before the shuffle, and gives it to the node
    and to the node's label too, so that whole trees are hooked at once; then labels follow their own label. Chains of any
    order take a number of rounds near the logarithm of their length. Labels only fall; the rounds end when none did. The
    tables of a round are deleted when the next one stands. Loops are allowed; no edges give no rows.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    kind = labels.schema["component"].dataType
    moved = True
    while moved:
        to = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        far = written(labels.join(to, "component").select("node", "component", "next"), "labels-far")
        near = both.join(far.select(F.col("node").alias("b"), "next"), "b").groupBy("a").agg(F.min("next").alias("m"))
        low = far.join(near, far["node"] == near["a"]).select("node", "component", F.least("next", "m").alias("c"))
        own = F.struct(F.col("node").alias("node"), F.col("component").alias("was"), F.col("c").alias("c"))
        root = F.struct(F.col("component").alias("node"), F.lit(None).cast(kind).alias("was"), F.col("c").alias("c"))
        new = low.select(F.explode(F.array(own, root)).alias("g")).groupBy("g.node").agg(F.max("g.was").alias("was"), F.min("g.c").alias("component"))
        new = written(new, "labels")
        moved = not new.filter("component <> was").isEmpty()
        for old in (labels, far):
            spent(old)
        labels = new
    spent(both)
    return labels.select("node", "component")
