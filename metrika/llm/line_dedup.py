"""Line dedup by range-partitioned line hashes; per-document keep bitmaps, run-length compressed. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, whole_row, written

LEAST_CHARS, LEAST_DOCS = 40, 5
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(x: Column) -> Column:
    """A-Z only. Pure ASCII goes the fast way: there lower() means the same."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def line_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of every line whose key has least_chars code points or more; row tells apart texts of one id."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACE))
    rows = rows.select("id", "row", "pos", key.alias("key")).filter(F.char_length("key") >= least_chars)
    low = ascii_lower(F.col("key"))
    return rows.select("id", "row", "pos", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(1), low).alias("h2"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each text that loses lines: id, row (hash of the text), drops: array of (start, length), sorted.

    drops is the complement of the document's keep bitmap, run-length compressed. A line's key is the line without the
    white space `[\\x20\\x09-\\x0D]` at either end and with A-Z in lower case. Keys of least_chars code points or more that
    least_docs documents or more hold lose their lines everywhere but in the document with the largest id.

    Hashes (128 bits) are range-partitioned together with the document, so that one hot line spreads over many partitions,
    and sorted there by document and position; a window streams over the sorted rows and marks the first of each hash in each
    document. Only first occurrences are counted, before the shuffle by hash, and the join that brings a hot hash back to its
    rows has a plain exchange on both sides, so adaptive execution splits it.

    Null text is one empty line and never dropped. A null id is one document, smaller than any other. Repeated rows lose
    the same lines. Rows that share an id but not the text are one document. An empty table gives an empty result.
    """
    lines = written(line_keys(docs, id_col, text_col, least_chars), "line-keys")
    order = Window.partitionBy("h1", "h2", "id").orderBy("row", "pos")
    marked = lines.repartitionByRange("h1", "h2", "id").withColumn("first", F.row_number().over(order) == 1)
    marked = written(marked, "line-runs")
    common = written(
        marked.filter("first").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= least_docs).select("h1", "h2", "keep"),
        "line-common",
    )
    lost = marked.join(common, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("keep"))).select("id", "row", "pos")
    drops = lost.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    first = F.filter("at", lambda x, i: (i == 0) | (F.get(F.col("at"), i - 1) != x - 1))
    last = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get(F.col("at"), i + 1) != x + 1))
    run = F.zip_with(first, last, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))
    return drops.select(F.col("id").alias(id_col), "row", run.alias("drops"))


def kept_lines(lines: Column, drops: Column) -> Column:
    """The lines outside drops; linear in the lines."""
    none = F.array().cast("array<struct<start:int,length:int>>")
    d = F.coalesce(drops, none)
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(d, i - 1)["start"] + F.get(d, i - 1)["length"])
    end = lambda i: F.when(i == F.size(d), F.size(lines)).otherwise(F.get(d, i)["start"])
    parts = F.transform(F.sequence(F.lit(0), F.size(d)), lambda i: F.slice(lines, begin(i) + 1, end(i) - begin(i)))
    return F.when(F.size(d) == 0, lines).otherwise(F.flatten(parts))


def without_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns _n_lines, _n_dropped and _kept (the text without the dropped lines) beside its own.

    Columns of docs may have any other names; those of these three are replaced. Null text counts as one empty line and its
    _kept is empty. Repeated rows and null ids keep their own row each. An empty table gives an empty result, and drops
    without rows leave all lines. A text of any length is one row and never spread out into lines.
    """
    made = ("_n_lines", "_n_dropped", "_kept")
    rows = docs.select(whole_row(docs).alias("all"), F.xxhash64(text_or_empty(text_col)).alias("row")).alias("d")
    f = drops.select(F.col(id_col).alias("id"), "row", "drops").alias("f")
    rows = rows.join(f, F.col("d.all")[id_col].eqNullSafe(F.col("f.id")) & (F.col("d.row") == F.col("f.row")), "left")
    text = F.coalesce(F.col("d.all")[text_col].cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    n = F.coalesce(F.aggregate("f.drops", F.lit(0), lambda a, r: a + r["length"]), F.lit(0))
    kept = F.when(F.col("f.drops").isNull(), text).otherwise(F.array_join(kept_lines(lines, F.col("f.drops")), "\n"))
    own = [F.col("d.all")[c].alias(c) for c in docs.columns if c not in made]
    return rows.select(*own, F.size(lines).cast("long").alias(made[0]), n.cast("long").alias(made[1]), kept.alias(made[2]))
