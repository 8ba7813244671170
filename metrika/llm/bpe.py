"""BPE encoding and decoding of whole texts by forced-boundary splitting."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, text_slices


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id and `ids` (binary, little-endian unsigned 32-bit) of every whole text, as the tokenizers library gives them
    without special tokens added, truncation or padding; with digests n_tokens, ids_sha256 and decoded_sha256 instead.

    Special tokens' strings in a text become their ids, as in the library. Null text counts as empty and has no ids.
    Repeated rows and null ids pass through. A text of any length is encoded whole, by its fragments. Columns of docs may
    have any names; others than id and text are never read. An empty table gives an empty result. The vocabulary file must be at the same path on every executor.
    """
    from .tokens import forced_boundary


    def encode(batches):
        codec = forced_boundary(path)
        for b in batches:
            for ids, texts in text_slices(b):
                found = codec.encode(texts)
                if digests:
                    decoded = [hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found]
                    cols = [pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found]), pa.array(decoded)]
                    yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], names=["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    out = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(encode, f"id {kind}, {out}").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id and text of every row of bpe_encode's result; null ids decode to null."""
    from .tokens import forced_boundary


    def decode(batches):
        codec = forced_boundary(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(F.col(id_col).alias("id"), "ids").mapInArrow(decode, f"id {kind}, text string").withColumnRenamed("id", id_col)
