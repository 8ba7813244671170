"""Removal of repeated 200-byte strings by merging shard Burrows-Wheeler transforms.

Every window of LENGTH bytes has a minimizer: the smallest hash of the K-byte strings inside it. Equal windows have the same
minimizer, so only windows that share one can be equal, and consecutive windows mostly share theirs: they form a run. The
bytes under runs whose minimizer occurs again are cut out and grouped by minimizer. Inside a group the slices are dealt to
shards; each shard's suffixes are sorted and its transform taken; the shards' transforms are merged by iterative interleave
refinement, which sorts the suffixes of all shards by one more symbol in each round, from the transforms alone. Boundaries
that appear between neighbours give the common prefixes; what is undivided after LENGTH bytes is a repeated interval.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

LENGTH, K = 200, 16
#: A window has LENGTH - K bytes besides its minimizer: half of them at least stand before it, or after it.
HALF = (LENGTH - K) // 2
#: Bytes of a symbol in the transforms, bytes of a shard, bytes merged at once.
STEP, SHARD_BYTES, MERGE_BYTES = 4, 1 << 14, 1 << 16
#: Runs that share a minimizer and are more are compared window by window instead.
GROUP = 64
RUN_WINDOWS = 1 << 12
HASH_BYTES = 1 << 21


# --- runs of windows with one minimizer -------------------------------------------------------------------------------


def minimizer_runs(data: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(minimizer, first window, windows, whether the minimizer recurs inside, its first place) of the runs over all windows."""
    n = len(data)
    if n < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, bool), np.empty(0, np.int64))
    buf = np.ascontiguousarray(data)
    words = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
    h = words[: n - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= words[k - 8 :] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    w, low, span = length - k + 1, h, 1
    while 2 * span <= w:
        low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
    if w > span:
        low = np.minimum(low[: len(h) - w + 1], low[w - span : w - span + len(h) - w + 1])
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    first = np.flatnonzero(new)
    again = (h[: len(low) - 1] == low[:-1]) & ~new[1:]
    recurs = np.add.reduceat(np.append(again, False).astype(np.int32), first) > 0
    count = np.diff(np.append(first, len(low)))
    at = np.concatenate([h[first[j : j + 4096, None] + np.arange(w)].argmin(axis=1) for j in range(0, len(first), 4096)])
    return low[first].view(np.int64), first, count, recurs, first + at


def text_runs(text: bytes) -> list[tuple[np.ndarray, ...]]:
    """minimizer_runs of a text in overlapping blocks, long runs cut; a run that a block cuts stays correct as two."""
    data = np.frombuffer(text, np.uint8)
    out = []
    for at in range(0, max(1, len(data) - LENGTH + 1), HASH_BYTES):
        key, first, count, recurs, place = minimizer_runs(data[at : at + HASH_BYTES + LENGTH - 1])
        if len(key) and at:  # the same minimizer on both sides of the cut: each side may hold its only recurrence
            recurs[0] = True
        if len(key) and at + HASH_BYTES < len(data) - LENGTH + 1:
            recurs[-1] = True
        first, place = first + at, place + at
        if len(count) and count.max() > RUN_WINDOWS:
            parts = -(-count // RUN_WINDOWS)
            of = np.repeat(np.arange(len(count)), parts)
            k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
            key, recurs, place = key[of], recurs[of] | (parts[of] > 1), place[of]
            first, count = first[of] + k * RUN_WINDOWS, np.minimum(count[of] - k * RUN_WINDOWS, RUN_WINDOWS)
        out.append((key, first, count, recurs, place))
    return out


# --- transforms and their merge ---------------------------------------------------------------------------------------


class Suffixes:
    """Slices laid out one after the other with STEP terminators each; suffixes compare within their slice."""

    def __init__(self, slices: list[bytes], step: int = STEP):
        size = np.array([len(s) + step for s in slices])
        start = np.cumsum(size) - size
        n = int(size.sum())
        x = np.zeros(n + step, np.int64)
        raw = np.frombuffer(b"".join(s + bytes(step) for s in slices), np.uint8)
        x[:n] = raw
        ends = (start + size)[:, None] - 1 - np.arange(step)
        x[:n] += 1
        x[ends.ravel()] = 0
        code = x[:n].copy()
        for j in range(1, step):
            code = code * 257 + x[j : n + j]
        # past a terminator nothing counts: those of the next slice don't either
        left = np.repeat(start + size - step, size) - np.arange(n)
        for j in range(1, step):
            short = left == j
            code[short] -= code[short] % 257 ** (step - j)
        code[left <= 0] = 0
        self.symbols, self.code = np.unique(code, return_inverse=True)
        self.start, self.size, self.n, self.step, self.left = start, size, n, step, left

    def sorted_shard(self, lo: int, hi: int, length: int) -> np.ndarray:
        """Positions lo..hi, sorted by their first `length` bytes and more, by doubling ranks."""
        rank, span, m = self.code[lo:hi].astype(np.int64), self.step, hi - lo
        left = self.left[lo:hi]
        order = np.argsort(rank, kind="stable")
        while span < length:
            ahead = np.zeros(m, np.int64)
            ahead[: max(0, m - span)] = rank[span:]
            ahead[left <= span] = 0
            key = rank * (m + self.code.max() + 2) + ahead
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(m, np.int64)
            new[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))
            rank, span = new, 2 * span
        return order + lo


def repeated_windows(slices: list[bytes], length: int = LENGTH, step: int = STEP, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each slice, which of its windows of `length` bytes occur at another place of the slices, or elsewhere in its own.

    Shards are slices in order, of about shard_bytes. The transform of a shard holds, for each of its sorted suffixes, the
    symbol (`step` bytes) before it. Round h of the merge has all suffixes in the order of their first h symbols: taking
    them in that order, each one's predecessor is filed under its symbol, stably. Two neighbours stay in one block while
    their symbols and the blocks they came from agree; blocks that are whole after length / step rounds share `length` bytes.
    """
    if length % step:
        raise ValueError("length must be a multiple of step")
    t = Suffixes(slices, step)
    cuts, at = [0], 0
    for s, z in zip(t.start, t.size, strict=True):
        at = int(s + z)
        if at - cuts[-1] >= shard_bytes:
            cuts.append(at)
    if cuts[-1] < at:
        cuts.append(at)
    order = np.concatenate([t.sorted_shard(lo, hi, length) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)])  # shard after shard
    place = np.empty(t.n, np.int64)
    place[order] = np.arange(t.n)
    offset = order - np.repeat(t.start, t.size)[order]
    has = offset >= step  # code 0 is the empty symbol, which precedes no suffix: here it marks those without a predecessor
    kind = np.uint16 if len(t.symbols) < 1 << 16 else np.int32
    before = np.zeros(t.n, kind)
    before[has] = t.code[order[has] - step]
    back = np.zeros(t.n, np.int32)
    back[has] = place[order[has] - step]
    empty = np.flatnonzero(t.left[order] <= 0).astype(np.int32)  # step suffixes a slice, as many as have no predecessor
    e = len(empty)
    now = np.arange(t.n, dtype=np.int32)  # round 0: shard after shard, one block
    block, new = np.zeros(t.n, np.int32), np.zeros(t.n, bool)
    for _ in range(length // step):
        sym = before[now]
        by = np.argsort(sym, kind="stable")[e:]
        sym, blk = sym[by], block[by]
        now[e:] = back[now[by]]
        now[:e] = empty
        if len(sym):
            new[e] = True
            np.logical_or(sym[1:] != sym[:-1], blk[1:] != blk[:-1], out=new[e + 1 :])
        block = np.cumsum(new, dtype=np.int32)
    size = np.bincount(block)
    pos = order[now]
    found = np.zeros(t.n, bool)
    found[pos] = (size[block] > 1) & (t.left[pos] >= length)
    return [found[s : s + max(0, z - step - length + 1)] for s, z in zip(t.start, t.size, strict=True)]


def ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of True."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


# --- the operator -----------------------------------------------------------------------------------------------------


def runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(m, s, before, after, id, row, first, windows, recurs): minimizer, hash of the bytes under each run of each document,
    and of the half of a window's other bytes before and after the minimizer (null where no window of the run has them);
    place: the minimizer's first place."""
    kind = dict(docs.dtypes)[id_col]

    def make(batches):
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        for b in batches:
            cols, of, hashes, whole = ([], [], [], [], []), [], ([], []), []
            for i, x in enumerate(b.column(2)):
                view = memoryview(x.as_buffer())
                for part in text_runs(view):
                    for c, p in zip(cols, part, strict=True):
                        c.append(p)
                    of.append((i, len(part[0])))
                    for lo, n, at in zip(part[1].tolist(), part[2].tolist(), part[4].tolist(), strict=True):
                        whole.append(xxh3_128_digest(view[lo : lo + n + LENGTH - 1]))
                        hashes[0].append(xxh3_64_intdigest(view[at - HALF : at]) if at - lo >= HALF else 0)
                        hashes[1].append(xxh3_64_intdigest(view[at + K : at + K + HALF]) if lo + n - 1 + LENGTH - at - K >= HALF else 0)
            if of:
                at = pa.array(np.repeat([i for i, _ in of], [n for _, n in of]))
                m, first, windows, recurs, place = (np.concatenate(c) for c in cols)
                before, after = (np.array(h, np.uint64).view(np.int64) for h in hashes)
                s, s2 = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2).T
                half = lambda h: pa.array(h, mask=h == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m), pa.array(s), pa.array(s2), half(before), half(after), b.column(0).take(at), b.column(1).take(at), pa.array(first), pa.array(windows.astype(np.int32)), pa.array(recurs), pa.array(place)],
                    names=["m", "s", "s2", "before", "after", "id", "row", "first", "windows", "recurs", "place"],
                )

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text")).filter(F.octet_length("text") >= LENGTH)
    return rows.mapInArrow(make, f"m long, s long, s2 long, before long, after long, id {kind}, row long, first long, windows int, recurs boolean, place long")


def same_neighbour(a: np.ndarray) -> np.ndarray:
    """Which rows of the sorted keys a (n, columns) equal the row before or after."""
    eq = (a[1:] == a[:-1]).all(axis=1)
    return np.append(False, eq) | np.append(eq, False)


def recurring(made: DataFrame) -> DataFrame:
    """What recurs of the runs: `settled` where the whole run's bytes stand elsewhere under the same minimizer, hence all its
    windows; `merged` where its bytes must be compared with different ones (one run for each different content). Equal windows
    agree in the half before or after the minimizer, so a run that shares neither with another content has no equal window,
    and of one that shares a single half only the windows lo..hi on that side can have one.

    One shuffle by minimizer, sorted; windows read each group in order and spill, so none is collected.
    """
    by_m, by_s = Window.partitionBy("m"), Window.partitionBy("m", "s", "s2")
    x = made.repartition("m").withColumns({"n_s": F.count("*").over(by_s), "k": F.row_number().over(by_s.orderBy("id", "row", "first"))})
    x = x.withColumns({"n_m": F.count("*").over(by_m), "different": F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).over(by_m)})
    other = (F.col("k") == 1) & ((F.col("different") > 1) | (F.col("recurs") & (F.col("n_s") == 1)))
    x = x.withColumn("other", other).filter("n_s > 1 or other")
    mine = F.when(F.col("other"), 1)
    x = x.withColumns({"n_b": F.count(mine).over(Window.partitionBy("m", "before")), "n_a": F.count(mine).over(Window.partitionBy("m", "after"))})
    half = lambda c, n: F.col(c).isNotNull() & (F.col(n) > 1)
    x = x.withColumn("all", F.max("recurs").over(by_m))
    x = x.withColumns({"b": half("before", "n_b") | F.col("all"), "a": half("after", "n_a") | F.col("all")})
    x = x.withColumn("merged", F.col("other") & (F.col("b") | F.col("a")))
    large = F.sum(F.col("merged").cast("int")).over(by_m) > GROUP
    last, middle = F.col("first") + F.col("windows") - 1, F.col("place") - HALF
    lo = F.when(F.col("b"), F.col("first")).otherwise(F.greatest("first", middle))
    hi = F.when(F.col("a"), last).otherwise(F.least(last, middle))
    x = x.select("m", "id", "row", "first", "windows", "recurs", (F.col("n_s") > 1).alias("settled"), "merged", large.alias("large"), lo.alias("lo"), hi.alias("hi"))
    return x.filter("settled or merged")


def cut_slices(rows: DataFrame, kind: str) -> DataFrame:
    """Slices (kind 0) of runs; for runs of large groups their windows' hashes (kind 1), and what a batch settles (kind 2)."""
    from xxhash import xxh3_128_intdigest

    names = ["kind", "key", "key2", "recurs", "first", "last", "slice"]
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]

    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v

    def make(batches):
        for b in batches:
            out: list[tuple] = []
            hot: dict[int, list[tuple[int, int]]] = {}
            for i in range(len(b)):
                view = memoryview(b.column(2)[i].as_buffer())
                for r in b.column(3)[i].as_py():
                    lo, hi = r["lo"], r["hi"]
                    if r["large"]:
                        for j in range(lo, hi + 1):
                            hot.setdefault(xxh3_128_intdigest(view[j : j + LENGTH]), []).append((i, j))
                    else:
                        out.append((i, 0, r["m"], 0, r["recurs"], lo, hi, bytes(view[lo : hi + LENGTH])))
            twice = []
            for x, at in hot.items():  # one of each goes on; what occurs twice in the batch is settled here
                out.append((at[0][0], 1, signed(x >> 64), signed(x & (1 << 64) - 1), False, at[0][1], at[0][1], None))
                twice += at if len(at) > 1 else []
            if twice:
                t = np.array(sorted(twice), np.int64)
                start = np.flatnonzero(np.append(True, (np.diff(t[:, 0]) != 0) | (np.diff(t[:, 1]) != 1)))
                stop = np.append(start[1:], len(t)) - 1
                out += [(int(i), 2, int(x), 0, False, int(x), int(y), None) for (i, x), y in zip(t[start], t[stop, 1], strict=True)]
            for k in range(0, len(out), 4096):
                i, *cols = zip(*out[k : k + 4096], strict=True)
                at = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "row", *names])

    return rows.mapInArrow(make, f"id {kind}, row long, kind byte, key long, key2 long, recurs boolean, first long, last long, slice binary")


def settle(parts: DataFrame, kind: str) -> DataFrame:
    """(id, row, first, last) of repeated windows. Slices are merged in batches of whole groups of one minimizer; windows of
    large groups are compared with their neighbours in the sorted stream."""
    schema = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def merge(groups):
        """groups: lists of (id, row, first, last, recurs, slice)"""
        out, todo, of = [], [], []
        for g in groups:
            by: dict[bytes, list] = {}
            for x in g:
                by.setdefault(x[5], []).append(x)
            for s, rows in by.items():
                if len(rows) > 1:  # repeated rows of one document
                    out += [x[:4] for x in rows]
                todo.append(s)
                of.append(rows)
        for hit, rows in zip(repeated_windows(todo), of, strict=True) if todo else ():
            if len(rows) == 1:
                lo, hi = ranges(hit)
                i, r, first = rows[0][:3]
                out += [(i, r, first + int(a), first + int(b)) for a, b in zip(lo, hi, strict=True)]
        return out

    def batch(rows, like):
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], like), *(pa.array(c, pa.int64()) for c in cols[1:])], names=schema.names)

    def run(batches):
        like, groups, size, last_key = None, [], 0, None
        held = None  # the last window hash seen: (key, key2, id, row, first, given)
        for b in batches:
            like = b.schema.field(0).type
            c = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            what = c["kind"].to_numpy()
            out = []
            for i in np.flatnonzero(what == 0).tolist():
                key, s = c["key"][i].as_py(), c["slice"][i].as_py()
                if key != last_key:
                    if size >= MERGE_BYTES:
                        out += merge(groups)
                        groups, size = [], 0
                    groups.append([])
                    last_key = key
                groups[-1].append((c["id"][i].as_py(), c["row"][i].as_py(), c["first"][i].as_py(), c["last"][i].as_py(), c["recurs"][i].as_py(), s))
                size += len(s)
            at = np.flatnonzero(what == 1)
            if len(at):
                k = np.column_stack([c["key"].to_numpy()[at], c["key2"].to_numpy()[at]])
                hit = same_neighbour(k)
                ids = c["id"].take(pa.array(at)).to_pylist()
                rows, first = c["row"].to_numpy()[at], c["first"].to_numpy()[at]
                if held is not None and (k[0] == held[0]).all():
                    hit[0] = True
                    if not held[4]:
                        out.append((held[1], held[2], held[3], held[3]))
                out += [(ids[j], int(rows[j]), int(first[j]), int(first[j])) for j in np.flatnonzero(hit)]
                held = (k[-1], ids[-1], int(rows[-1]), int(first[-1]), bool(hit[-1]))
            at = np.flatnonzero(what == 2)
            out += [(c["id"][i].as_py(), c["row"][i].as_py(), c["first"][i].as_py(), c["last"][i].as_py()) for i in at.tolist()]
            if out:
                yield batch(out, like)
        if groups:
            yield batch(merge(groups), like)

    return parts.repartition("kind", "key").sortWithinPartitions("kind", "key", "key2").mapInArrow(run, f"id {kind}, row long, first long, last long")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, first, last): stretches of window starts whose LENGTH bytes also start somewhere else, in this document or
    another; row is a hash of the text, which tells texts of one id apart.

    Null text is empty, and texts under LENGTH bytes have no window. A null id is an id like others. Repeated rows hold each
    other's strings. A text of any length is read as runs of windows. Columns of docs may have any names; others than id and
    text are never read. An empty table gives an empty result. Runs with equal bytes are settled by 128-bit hashes of the whole run; different ones that share a minimizer are
    merged in one task only up to GROUP of them. Those of larger groups are compared by 128-bit hashes of each window,
    streamed in sorted order, so no group is collected.
    """
    kind = dict(docs.dtypes)[id_col]
    found = written(recurring(runs(docs, id_col, text_col)), "runs")
    by_doc = found.filter("merged").groupBy("id", "row").agg(F.collect_list(F.struct("m", "lo", "hi", "recurs", "large")).alias("runs"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text")).filter(F.octet_length("text") >= LENGTH)
    joined = rows.alias("d").join(by_doc.alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.row") == F.col("r.row"))).select("d.id", "d.row", "d.text", "r.runs")
    settled = found.filter("settled").select("id", "row", "first", (F.col("first") + F.col("windows") - 1).alias("last"))
    return written(settle(cut_slices(joined, kind), kind), "repeated").union(settled)


def remove(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """A row per row of docs: id, n_bytes, n_removed, n_spans (maximal removed stretches of bytes), kept (binary: a cut may
    fall inside a character) or, without keep_text, kept_sha256.

    found is the result of repeated(docs). A null text is empty: no bytes, nothing removed. A null id is met by null ids;
    texts of one id are told apart by their hash, and repeated rows lose the same bytes. A text of any length is one row,
    cut by its sorted stretches in one go. Columns of docs may have any names; others than id and text are never read. An
    empty table gives an empty result, and an empty `found` leaves all bytes.
    """
    kind = dict(docs.dtypes)[id_col]
    by_doc = found.groupBy("id", "row").agg(F.collect_list(F.struct("first", "last")).alias("at"))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))
    joined = rows.alias("d").join(by_doc.alias("r"), F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.row") == F.col("r.row")), "left").select("d.id", "d.text", "r.at")

    def cut(batches):
        for b in batches:
            out = []
            for text, at in zip(b.column(1), b.column(2), strict=True):
                raw = memoryview(text.as_buffer())
                spans: list[list[int]] = []
                for lo, hi in sorted((x["first"], x["last"] + LENGTH) for x in at.as_py() or ()):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                edges = [0, *(e for s in spans for e in s), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(raw), len(raw) - len(kept), len(spans), kept if keep_text else hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary() if keep_text else pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept" if keep_text else "kept_sha256"])

    out = f"id {kind}, n_bytes long, n_removed long, n_spans long, {'kept binary' if keep_text else 'kept_sha256 string'}"
    return joined.mapInArrow(cut, out).withColumnRenamed("id", id_col)
