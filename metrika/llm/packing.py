"""Best-fit packing of token pieces into sequences: large items two to a sequence at most, small ones into the tightest gaps."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, text_slices, written

CAPACITY, END = 4096, 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, first sequence, pieces a sequence, offset) entries.

    The piece of rank r (from 0, among those of its length) of an entry stands in sequence first + (r - first rank) // per,
    at offset + ((r - first rank) % per) * length. Pieces above a third of the capacity are matched greedily, the longest
    with the longest that still fits, two to a sequence at most. Smaller ones, the longest first, go where they leave the
    smallest gap; a new sequence is opened only where no gap fits. All of that works on runs of equal sequences, so time and
    entries depend on the distinct lengths alone: each step uses up a length or a run of gaps, and a length adds two runs at
    most.
    """
    left, entries, n = dict(counts), [], 0
    used: Counter[int] = Counter()
    gaps: list[tuple[int, int, int]] = []  # gap, first sequence, sequences

    def put(length: int, pieces: int, first: int, per: int, offset: int) -> None:
        entries.append((length, used[length], pieces, first, per, offset))
        used[length] += pieces
        left[length] -= pieces

    large = sorted(x for x in left if 3 * x > capacity and left[x])
    while large:
        x = large[-1]
        room = bisect_left(large, capacity - x + 1)
        y = large[room - 1] if room else 0
        if y == x and left[x] == 1:
            y = large[room - 2] if room > 1 else 0
        m = left[x] if not y else left[x] // 2 if y == x else min(left[x], left[y])
        put(x, 2 * m if y == x else m, n, 2 if y == x else 1, 0)
        if y and y != x:
            put(y, m, n, 1, x)
        if capacity - x - y:
            insort(gaps, (capacity - x - y, n, m))
        n += m
        large = [z for z in large if left[z]] if not left[x] or (y and not left[y]) else large
    for x in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        while left[x]:
            k = bisect_left(gaps, (x, -1, 0))
            if k == len(gaps):
                m = -(-left[x] // (capacity // x))
                insort(gaps, (capacity, n, m))
                n += m
                continue
            gap, first, m = gaps.pop(k)
            per = min(gap // x, left[x])
            take = min(m, left[x] // per)
            put(x, take * per, first, per, capacity - gap)
            if m > take:
                insort(gaps, (gap, first + take, m - take))
            if gap > per * x:
                insort(gaps, (gap - per * x, first, take))
    return entries


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece, start, length, ids_crc32 (and ids), part, rank among the part's pieces of that length.

    A document is its token ids (null text: none) and then `end`; one longer than capacity is cut into pieces of that length.
    """
    from .tokens import words

    kind = dict(docs.dtypes)[id_col]

    def cut(batches):
        codec, part, seen = words(path), TaskContext.get().partitionId(), Counter()
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            for ids, texts in text_slices(b):
                rows, of = [], []
                for k, x in enumerate(codec.encode(texts)):
                    x += tail
                    for p in range(0, len(x), 4 * capacity):
                        own = x[p : p + 4 * capacity]
                        n = len(own) // 4
                        rows.append((p // (4 * capacity), p // 4, n, zlib.crc32(own), part, seen[n], own if keep_ids else None))
                        seen[n] += 1
                        of.append(k)
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank", "ids"])

    out = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long, ids binary"
    made = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(cut, out)
    return made if keep_ids else made.drop("ids")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 (ids), sequence_id, offset; sequences are gapless from 0.

    The pieces are written once, with their rank among the equally long pieces of their partition. What the driver gets is
    the count of each length, capacity rows at most, and what goes back to the tasks is the plan on these counts, a few
    entries a length: neither grows with the documents. A piece's rank among all of its length is its own plus the counts of
    the partitions before; counts by (partition, length) are joined back, so a length that many rows share is dealt out by
    partition. Null or empty texts are a piece of one id. Repeated rows are packed each, null ids
    like others. A text of any length is tokenized whole and cut into pieces. Columns of docs may have any names; others than
    id and text are never read. No documents give no rows.
    """
    made = written(pieces(docs, path, capacity, end, id_col, text_col, keep_ids), "pieces")
    counts = written(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(sorted(plan(total, capacity)), dtype=np.int64).reshape(-1, 6)

    def place(batches):
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            e = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            r = rank - e[:, 1]
            names = [n for n in b.schema.names if n != "rank"]
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(e[:, 3] + r // np.maximum(e[:, 4], 1)), pa.array(e[:, 5] + r % np.maximum(e[:, 4], 1) * length)], names=[*names, "sequence_id", "offset"])

    kind = dict(docs.dtypes)[id_col]
    carried = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = made.join(bases.hint("merge"), ["part", "length"]).select(*carried, (F.col("rank") + F.col("base")).alias("rank"))
    out = f"id {kind}, piece int, start long, length long, ids_crc32 long, {'ids binary, ' * keep_ids}sequence_id long, offset long"
    return ranked.mapInArrow(place, out).withColumnRenamed("id", id_col)
