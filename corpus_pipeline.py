"""A training corpus from `documents`: language, repeated lines, near copies, repeated passages, packed sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a DataFrame; all but the
last have the columns of `documents`. A column n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrika.llm import langid, line_dedup, packing, passage_dedup, simhash
from metrika.llm.common import written
from metrika.llm.queries import WORD_BPE


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return docs.select(*columns)


#: How far from guessing towards certainty the probability of a document's language must be.
LEAST_CERTAIN = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no language the network can tell: those without a letter, and those whose most probable language
    is hardly more probable than a guess, 1 / n of n languages, by LEAST_CERTAIN of the way from there to 1.

    Where there was nothing to learn from, only documents without a letter go.
    """
    network = langid.fit(docs)
    if network is None:
        return langid.with_letters(docs)
    name, score = (next(n for n in (stem + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns) for stem in ("lang_pred", "score"))
    guess = 1 / len(network.labels)
    told = (F.col(name) != langid.UNKNOWN) & (F.col(score) >= guess + LEAST_CERTAIN * (1 - guess))
    return langid.identify(docs, network, names=(name, score)).filter(told).select(*(f"`{c}`" for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them."""
    out = line_dedup.without_lines(docs, line_dedup.line_dedup(docs))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("_kept"))
    return counted(out.withColumn("text", text), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (all rows of that id, if it is repeated)."""
    stay = simhash.near_dedup(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stays"]), "left_semi")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that documents share stay in the one with the smallest id."""
    return counted(passage_dedup.without_passages(docs, passage_dedup.passage_dedup(docs)), docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces packed into sequences."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("sequences", sequences)]

#: Language identification and tokens are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
