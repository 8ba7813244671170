"""Filter interaction audit: which filter removes what in which order, from a packed bitmap index of filters, labels and parts."""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

FILTERS, LABELS = "ABCDE", ("good", "toxic")
#: Rows of a block of the index, and parts of a worker's open blocks; bound memory, never results.
BLOCK, OPEN_PARTS = 1 << 16, 256
SPACES = r"[\x20\x09-\x0D]+"


def failures(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per row of docs: part, A to E (whether the filter's condition fails), good, toxic.

    A: fewer than 50 words; B: distinct words below 65 % of the words; C: capitals A-Z above 5 % of the code points; D: any
    of `#$%&*|`; E: the whole text is that of a smaller id. Words are maximal runs without `[\\x20\\x09-\\x0D]`.
    Labels: quality = 1 and toxic = 1 in any of the id's rows of labels.

    A null text counts as empty, a null part as the empty string. A null id has no smaller id, is smaller than none and has
    no label. Rows that repeat an id and a text are no copies of each other; each row counts. Texts are told apart by
    SHA-256, with the smallest id of each aggregated before the shuffle; both joins have a plain exchange on either side, so
    adaptive execution splits a hot text. Other columns are never read. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.char_length(text).alias("chars"), capitals.alias("capitals"), F.rlike(text, F.lit("[#$%&*|]")).alias("D"), words.alias("words"),
    )
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    rows = written(rows.select("id", "part", "digest", (n < 50).alias("A"), (100 * distinct < 65 * n).alias("B"), (100 * F.col("capitals").cast("long") > 5 * F.col("chars")).alias("C"), "D"), "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("same"), "first")
    rows = rows.join(first, F.col("digest") == F.col("same"), "left")
    if labels is None:
        good, toxic = F.lit(False), F.lit(False)
    else:
        label = labels.groupBy(F.col("doc_id").alias("l")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        rows = rows.join(label, F.col("id") == F.col("l"), "left")
        good, toxic = F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False))
    return rows.select("part", "A", "B", "C", "D", F.coalesce(F.col("first") < F.col("id"), F.lit(False)).alias("E"), good.alias("good"), toxic.alias("toxic"))


def bitmap_index(rows: DataFrame, columns: list[str], part_col: str = "part") -> DataFrame:
    """Blocks of the packed index: part, n, and a bitmap (binary, the first row in the highest bit) for each boolean column.

    Each partition packs its own rows, part by part, BLOCK rows to a block at most, so a hot part is many blocks in many
    tasks; no shuffle. The same row has the same bit in every bitmap of its block. Null counts as false.
    """

    def pack(batches):
        open_parts: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}

        def block(part):
            bits = np.concatenate(open_parts.pop(part), axis=1)
            n = sizes.pop(part)
            for k in range(0, n, BLOCK):
                own = bits[:, k : k + BLOCK]
                packed = np.packbits(own, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([own.shape[1]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["part", "n", *columns])

        for b in batches:
            bits = np.stack([b.column(k + 1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) for k in range(len(columns))])
            parts = b.column(0).dictionary_encode()
            code = parts.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(parts.dictionary)))
            for k, part in enumerate(parts.dictionary.to_pylist()):
                own = order[ends[k - 1] if k else 0 : ends[k]]
                open_parts.setdefault(part, []).append(bits[:, own])
                sizes[part] = sizes.get(part, 0) + len(own)
                if sizes[part] >= BLOCK:
                    yield from block(part)
            while len(open_parts) > OPEN_PARTS:
                yield from block(next(iter(open_parts)))
        for part in list(open_parts):
            yield from block(part)

    out = ", ".join(f"{c} binary" for c in columns)
    return rows.select(F.col(part_col).alias("part"), *columns).mapInArrow(pack, f"part string, n long, {out}")


def subset_counts(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, before, filter, kept, removed, and for each label removed_<label>) for every set of filters that may stand before
    a filter. `before` has bit k for filters[k]; kept is what is left after the filter.

    For each block, what passes a set is the AND-NOT of its filters' bitmaps; the counts are popcounts. Blocks of a partition
    are summed by Spark's partial aggregation, then over all partitions.
    """
    k = len(filters)

    def count(batches):
        for b in batches:
            kinds = {"part": [], "before": [], "filter": [], "kept": [], "removed": [], **{f"removed_{x}": [] for x in labels}}
            for row in b.to_pylist():
                n = row["n"]
                full = np.packbits(np.ones(n, bool))
                fails = [np.frombuffer(row[c], np.uint8) for c in filters]
                marks = {c: np.frombuffer(row[c], np.uint8) for c in labels}
                passed = [full]
                for s in range(1, 1 << k):
                    top = s.bit_length() - 1
                    passed.append(passed[s & ~(1 << top)] & ~fails[top])
                ones = [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in passed]
                for s in range(1 << k):
                    for f in range(k):
                        if not s >> f & 1:
                            gone = passed[s] & fails[f]
                            kinds["part"].append(row["part"])
                            kinds["before"].append(s)
                            kinds["filter"].append(filters[f])
                            kinds["kept"].append(ones[s | 1 << f])
                            kinds["removed"].append(ones[s] - ones[s | 1 << f])
                            for c in labels:
                                kinds[f"removed_{c}"].append(int(np.bitwise_count(gone & marks[c]).sum(dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c in ("part", "filter") else pa.int32() if c == "before" else pa.int64()) for c, v in kinds.items()], names=list(kinds))

    sums = ["kept", "removed", *(f"removed_{x}" for x in labels)]
    made = index.mapInArrow(count, "part string, before int, filter string, " + ", ".join(f"{c} long" for c in sums))
    return made.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in sums))


def audit(rows: DataFrame, filters: str = FILTERS, labels: tuple[str, ...] = LABELS, part_col: str = "part") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    a <label>_lost for each label, shapley; all counts within the part.

    A filter's counts at a step depend on the set of filters before it alone, so 2^k sets stand for k! orders. redundant is
    what fails the filter but was removed before; unique_fails is what fails no other filter; shapley is the filter's removed
    summed over all orders: a set of size s stands before it in s! (k - 1 - s)! of them. Orders and sets are constants of the
    plan; only counts by (part, set, filter) are shuffled. An empty table gives no parts and no rows.
    """
    names, k = list(filters), len(filters)
    counts = subset_counts(bitmap_index(rows, [*names, *labels], part_col), names, list(labels))
    weight = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), F.bit_count("before") + 1)
    alone = F.when(F.col("before") == 0, F.col("removed"))
    whole = F.when(F.bit_count("before") == k - 1, F.col("removed"))
    sums = [c for c in ("kept", "removed", *(f"removed_{x}" for x in labels))]
    per = counts.groupBy("part", "filter").agg(
        F.map_from_entries(F.collect_list(F.struct("before", F.struct(*sums)))).alias("at"),
        F.max(alone).alias("fails"), F.max(whole).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"),
    )
    steps: dict[str, list[tuple[str, int, int]]] = {f: [] for f in names}
    for order in permutations(range(k)):
        for step, f in enumerate(order):
            steps[names[f]].append(("".join(names[x] for x in order), step + 1, sum(1 << x for x in order[:step])))
    table = F.create_map(*(x for f, of in steps.items() for x in (F.lit(f), F.from_json(F.lit(_json(of)), "array<struct<filter_order:string,step:int,before:int>>"))))
    out = per.select("*", F.explode(F.element_at(table, F.col("filter"))).alias("s")).withColumn("c", F.element_at("at", F.col("s.before")))
    return out.select(
        "part", "s.filter_order", "s.step", "c.kept", "c.removed", (F.col("fails") - F.col("c.removed")).alias("redundant"), "unique_fails",
        *(F.col("c")[f"removed_{x}"].alias(f"{x}_lost") for x in labels), "shapley",
    )


def _json(steps: list[tuple[str, int, int]]) -> str:
    return "[" + ",".join(f'{{"filter_order":"{o}","step":{s},"before":{b}}}' for o, s, b in steps) + "]"
