"""SimHash near-dedup by Golay-code fuzzy hashing: exact on one segment, fuzzy on the next, then verified."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, text_or_empty, text_slices, written

SHINGLE, SEED, BITS = 3, 42, 2
#: Fixed values of the binary Golay code (23, 12): its generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR, WORD, CHECK = 0b110001110101, 23, 11
#: (first bit, bits) of the fingerprint's segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Keys that more fingerprints share are paired by midpoints instead.
BUCKET = 64
WORDS_AT_ONCE = 1 << 16


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the bytes of a word, shape (3, 256), and the error of at most 3 bits that each syndrome stands for."""
    rem = np.zeros(WORD, np.int64)
    for i in range(WORD):
        x = 1 << i
        for j in range(WORD - 1, CHECK - 1, -1):
            if x >> j & 1:
                x ^= GENERATOR << (j - CHECK)
        rem[i] = x
    by_byte = np.zeros((3, 256), np.int64)
    for part in range(3):
        for b in range(256):
            for i in range(8):
                if b >> i & 1 and 8 * part + i < WORD:
                    by_byte[part, b] ^= rem[8 * part + i]
    errors = np.zeros(1 << CHECK, np.int64)
    for weight in (1, 2, 3):
        for at in combinations(range(WORD), weight):
            errors[np.bitwise_xor.reduce(rem[list(at)])] = sum(1 << i for i in at)
    return by_byte, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword that is nearest to each 23-bit word: at most 3 bits away, as the code is perfect."""
    by_byte, errors = golay()
    s = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 127]
    return (words ^ errors[s]) >> CHECK


def fuzzy_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the codeword indices of all words within one bit of each word, each index once.

    Two words at most two bits apart have a word within one bit of both, hence a common key. A word has one key if it is
    at most two bits from its codeword, else six or so.
    """
    around = words[:, None] ^ np.array([0, *(1 << i for i in range(bits))], np.int64)
    found = np.sort(decode(around), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of 64-bit fingerprints. At most BITS = 2 errors over three segments leave one without error; with the next
    segment, at most two bits off, it gives the key: segment number, that segment exactly, a fuzzy key of the next."""
    x = prints.view(np.uint64)
    parts = [(x >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        row, key = fuzzy_keys(parts[(k + 1) % 3], SEGMENTS[(k + 1) % 3][1])
        rows.append(row)
        keys.append(np.int64(k) << 40 | parts[k][row] << 12 | key)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str) -> int:
    """SimHash over the 3-word shingles of the text's words, A-Z in lower case, in blocks of words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    n, ones = max(1, len(words) - SHINGLE + 1), np.zeros(64, np.int64)
    for at in range(0, n, WORDS_AT_ONCE):
        w = words[at : at + WORDS_AT_ONCE + SHINGLE - 1]
        own = map(b" ".join, zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else [b" ".join(w)]
        h = np.fromiter(map(xxh64_intdigest, own, repeat(SEED)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): 64 bits as a signed long; null or blank text has 0."""

    def make(batches):
        for b in batches:
            for ids, texts in text_slices(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(t) for t in texts], pa.int64())], names=["id", "print"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(make, f"id {kind}, print long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `print` so that those at most two bits apart are connected.

    Keys that at most `bucket` fingerprints share are self-joined and verified bit by bit. The fingerprints of larger keys
    go another exact way, whose cost is linear: each is sent to its 65 neighbours within one bit; two at most two bits apart
    meet at one, no more than 65 distinct ones can meet there, and all that do are linked to the smallest.
    """

    def expand(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            row, key = keys_of(own)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], names=["key", "print"])

    keys = written(prints.select("print").mapInArrow(expand, "key long, print long"), "golay-keys")
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "golay-shared")
    near = written(keys.join(shared.filter(F.col("n") <= bucket).select("key"), "key"), "golay-near")
    pairs = (
        near.alias("x").join(near.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.print") < F.col("y.print")))
        .filter(F.bit_count(F.col("x.print").bitwiseXOR(F.col("y.print"))) <= BITS)
        .select(F.col("x.print").alias("a"), F.col("y.print").alias("b"))
    )
    crowd = keys.join(shared.filter(F.col("n") > bucket).select("key"), "key").select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    met = crowd.select("print", F.explode(flips).alias("flip")).groupBy(F.col("print").bitwiseXOR(F.col("flip")).alias("mid")).agg(F.collect_list("print").alias("all"))
    star = met.filter(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b")
    return pairs.union(star).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: id, print (long), component_id (the smallest id that links reach, its own included).

    Equal fingerprints are one node, so copies are never paired. Null and blank texts share fingerprint 0 and link like any
    other; fewer than three words are one shingle. Rows with a null id get the component of their fingerprint (null if no row
    there has an id). Repeated rows are alike. An empty table gives an empty result. Other columns are never read.
    """
    own = written(fingerprints(docs, id_col, text_col), "prints")
    nodes = written(own.groupBy("print").agg(F.min("id").alias("first")), "print-nodes")
    label = components(links(nodes, bucket))
    of = nodes.join(label, nodes["print"] == label["node"], "left").select("print", "first", F.coalesce("component", "print").alias("component"))
    least = of.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = written(of.join(least, "component").select("print", "component_id"), "print-classes")
    return own.join(classes, "print").select(F.col("id").alias(id_col), "print", "component_id")


def hex_print(column: str = "print"):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
