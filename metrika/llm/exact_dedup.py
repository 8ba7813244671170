"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

PREFIX = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest (binary SHA-256 of the UTF-8 text).

    Rows are grouped by byte length; those of groups of two or more by a hash of the first `prefix` characters; only those
    of groups that still hold two or more are hashed whole. Of equal texts the row with the largest id stays. With
    digest_all the digest is filled for every row (the caller wants it as output); else it is null for rows that an earlier
    level set apart.

    Null text counts as empty. A null id is smaller than any other. Rows that repeat both id and text share the id that
    stays, so all of them are kept and counted. An empty table gives an empty result. Other columns are never read.
    A hot group (a third of all rows) is pre-aggregated before the shuffle; the join that returns its id to its rows has a
    plain exchange on both sides, so adaptive execution splits it.
    """
    text = text_or_empty(text_col)
    sha = F.unhex(F.sha2(text, 256))
    base = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.octet_length(text).alias("len"),
            F.xxhash64(F.substring(text, 1, prefix)).alias("pre"),
            *([sha.alias("digest")] if digest_all else []),
        ),
        "exact-base",
    )
    by_len = written(base.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len"), "exact-len")
    left = base.join(by_len, "len", "left_semi")
    by_pre = written(left.groupBy("len", "pre").agg(F.count("*").alias("n")).filter("n > 1").select("len", "pre"), "exact-pre")
    if digest_all:
        full = base.join(by_pre, ["len", "pre"], "left_semi")
    else:
        hashed = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix)).alias("pre"))
        full = written(hashed.join(by_pre, ["len", "pre"], "left_semi").select("id", "len", "pre", F.unhex(F.sha2("t", 256)).alias("digest")), "exact-full")
    groups = written(
        full.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep")).filter("n > 1"), "exact-groups"
    )
    if not digest_all:  # rows set apart earlier have no digest, and no partner
        apart = base.join(by_pre, ["len", "pre"], "left_anti").select("id", F.lit(None).cast("binary").alias("digest"))
        base = full.select("id", "digest").union(apart)
    joined = base.alias("x").join(groups.alias("g"), F.col("x.digest") == F.col("g.digest"), "left")
    keep = F.when(F.col("g.n").isNull(), F.col("x.id")).otherwise(F.col("g.keep"))
    return joined.select(
        F.col("x.id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("g.n"), F.lit(1)).cast("long").alias("group_size"),
        F.col("x.id").eqNullSafe(keep).alias("kept"),
        F.col("x.digest").alias("digest"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that exact_dedup drops; columns, whatever their names, unchanged.

    Null texts are equal to empty ones. A null id is smaller than any other, so its row goes where its text stands under an
    id; rows that repeat id and text all stay. A text of any length is hashed whole. An empty table stays empty.
    """
    gone = exact_dedup(docs, **options).filter("not kept").select(F.col(options.get("id_col", "doc_id")).alias("_gone"))
    return docs.alias("d").join(gone, F.col(f"d.{options.get('id_col', 'doc_id')}").eqNullSafe(F.col("_gone")), "left_anti")


__all__ = ["exact_dedup", "keep_one"]
