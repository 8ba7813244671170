"""The one-to-one assignment of the largest total gain, over the edges of a sparse graph."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import spent, spread, written
from . import matching as X
from .graphs import components

#: Edges that one task solves. A key is solved over a core of its edges; where that is larger, by the parts of its graph, and
#: larger parts by rounds of bids.
PART_EDGES = 2_000_000
#: Gains are whole numbers of this part of 1, for single precision at and above 2**-16.
UNIT = 1 << 40
#: Of the bids, which need headroom for sums; totals are exact to half of the edges used times this part.
BID_UNIT = 1 << 20
#: Edges of each end that the core starts with.
CORE = 2
#: Edges leave the core where they gain less than their ends are worth by more than this, in the first rounds.
NEAR = 0.05
PRUNED = 8
#: Boxes of a side of a block, of which all meet, and those that meet the other side at a time.
BLOCK, STRIP = 4096, 64
#: In units of the gain, above what single precision moves an IoU.
SLACK = 1 << 17


def best_pairs(rows: np.ndarray, cols: np.ndarray, gain: list[int]) -> list[int]:
    """Which edges (row, col, gain > 0) the assignment of the largest total gain takes; rows and columns may stay alone."""
    return solved(rows, cols, gain)[0]


def solved(rows: np.ndarray, cols: np.ndarray, gain: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The edges taken, and what each row and each column is worth: no edge gains more than its two ends are worth, and all
    ends together are worth what the taken edges gain.

    Shortest augmenting paths over the edges alone, in whole numbers. Each row has a column of its own, at gain 0, which it
    takes where it stays alone.
    """
    n, m = int(rows.max()) + 1, int(cols.max()) + 1
    edges: list[list[tuple[int, int, int]]] = [[(m + r, 0, -1)] for r in range(n)]
    for k, (r, c) in enumerate(zip(rows.tolist(), cols.tolist(), strict=True)):
        edges[r].append((c, -gain[k], k))
    u, v = [min(cost for _, cost, _ in e) for e in edges], [0] * (m + n)
    row_of, col_of, edge_of = [-1] * (m + n), [-1] * n, [-1] * n
    for start in range(n):
        far: dict[int, int] = {}
        back: dict[int, tuple[int, int]] = {}
        done: list[int] = []
        queue: list[tuple[int, int]] = []
        r, base = start, 0
        while True:
            for c, cost, k in edges[r]:
                d = base + cost - u[r] - v[c]
                if c not in far or d < far[c]:
                    far[c], back[c] = d, (r, k)
                    heapq.heappush(queue, (d, c))
            base, c = heapq.heappop(queue)
            while base > far[c]:
                base, c = heapq.heappop(queue)
            if row_of[c] < 0:
                break
            done.append(c)
            r = row_of[c]
        u[start] += base
        for x in done:
            u[row_of[x]] += base - far[x]
            v[x] -= base - far[x]
        while True:
            r, k = back[c]
            before, row_of[c], col_of[r], edge_of[r] = col_of[r], r, c, k
            if r == start:
                break
            c = before
    return sorted(k for k in edge_of if k >= 0), [-x for x in u], [-x for x in v[:m]]


def bids(edges: DataFrame) -> DataFrame:
    """(part, a, b) that the assignment of the largest total gain takes, of edges (part, a, b, gain) with whole gains above 0.

    An auction of parts of any size. Every left a may take a column of its own at gain 0, and every right b has a row of its
    own that takes it at gain 0, or takes any left's own column where the two share an edge; so all rows can be placed, and
    prices may start anywhere. In a round all rows without a column bid for the one that is worth most to them, by what it is
    worth more than the next one, plus the step; each column goes to its highest bid. When all rows are placed the step is
    divided and they bid anew from the prices reached. Gains are multiplied by the number of rows and one, and with the last
    step, 1, no other assignment is worth more. A round is joins on rows and on columns; no part meets in one task.
    """
    e = edges.select("part", F.concat(F.lit("a"), F.col("a").cast("string")).alias("p"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("o"), "gain")
    alone = e.select("part", "p", F.concat(F.lit("x"), "p").alias("o"), F.lit(0).cast("long").alias("gain")).distinct()
    empty = e.select("part", F.concat(F.lit("x"), "o").alias("p"), "o", F.lit(0).cast("long").alias("gain")).distinct()
    cross = e.select("part", F.concat(F.lit("x"), "o").alias("p"), F.concat(F.lit("x"), "p").alias("o"), F.lit(0).cast("long").alias("gain"))
    every = written(e.union(alone).union(empty).union(cross), "auction-edges")
    size = every.agg(F.count_distinct("part", "p").alias("n"), F.max("gain").alias("most")).first()
    scale = size["n"] + 1
    rows = written(every.select("part", "p").distinct(), "auction-rows")
    price = written(every.select("part", "o").distinct().select("part", "o", F.lit(0).cast("long").alias("price"), F.lit(None).cast("string").alias("owner")), "auction-prices")
    step, top = max(1, size["most"] * scale // 4), Window.partitionBy("part", "p").orderBy(F.desc("value"), "o")
    while True:
        free = rows.join(price.filter("owner is not null").select("part", F.col("owner").alias("p")), ["part", "p"], "left_anti")
        worth = free.join(every, ["part", "p"]).join(price.select("part", "o", "price"), ["part", "o"])
        worth = worth.withColumn("value", F.col("gain") * scale - F.col("price"))
        two = worth.withColumn("rank", F.row_number().over(top)).filter("rank <= 2").groupBy("part", "p")
        first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
        bid = two.agg(first("o").alias("o"), (first("price") + first("value") - F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("value"))), first("value")) + step).alias("bid"))
        won = bid.groupBy("part", "o").agg(F.max(F.struct("bid", "p")).alias("w"))
        new = price.join(won, ["part", "o"], "left").select("part", "o", F.coalesce("w.bid", "price").alias("price"), F.coalesce("w.p", "owner").alias("owner"), F.col("w").isNotNull().alias("sold"))
        new, old = written(new, "auction-prices"), price
        spent(old)
        if new.filter("sold").isEmpty():
            if step == 1:
                taken = new.filter("owner like 'a%' and o like 'b%'").select("part", F.substring("owner", 2, 1 << 20).alias("a"), F.substring("o", 2, 1 << 20).alias("b"))
                for x in (every, rows):
                    spent(x)
                return taken
            step = max(1, step // 20)
            price = new.select("part", "o", "price", F.lit(None).cast("string").alias("owner"))
            price = written(price, "auction-prices")
            spent(new)
        else:
            price = new.select("part", "o", "price", "owner")


def same_key(x: DataFrame, y: DataFrame, *names: str):
    """Null-safe equality of columns of x with those of y that have an underscore more."""
    cond = F.lit(True)
    for c in names:
        cond = cond & x[c].eqNullSafe(y[f"_{c}"])
    return cond


def foremost(edges: DataFrame, n: int) -> DataFrame:
    """The n edges of most `worth` of each a and of each b, equal ones in an order of their own at each end."""
    tie = F.xxhash64("a", "b")
    ranked = [edges.withColumn("_r", F.row_number().over(Window.partitionBy("k", c).orderBy(F.desc("worth"), tie, "a", "b"))).filter(F.col("_r") <= n) for c in "ab"]
    return ranked[0].union(ranked[1]).select("k", "a", "b", "iou", "gain").distinct()


def pair_search(e: DataFrame) -> Callable[[DataFrame | None, int], DataFrame]:
    """Of the edges of a table (k, a, b, iou), the foremost by gain or, where ends (k, side, id, worth) are given, those of their
    keys that gain more than both ends are worth, the foremost by the difference."""
    every = e.withColumn("gain", (F.col("iou").cast("float").cast("double") * UNIT).cast("long"))

    def search(ends: DataFrame | None, n: int) -> DataFrame:
        if ends is None:
            return foremost(every.withColumn("worth", F.col("gain")), n)
        keys = ends.select(F.col("k").alias("_k")).distinct()
        over = every.join(keys, same_key(every, keys, "k"), "left_semi")
        for c in "ab":
            end = ends.filter(F.col("side") == c).select(F.col("k").alias("_k"), F.col(c).alias(f"_{c}"), F.col("worth").alias(f"of_{c}"))
            over = over.join(end, same_key(over, end, "k", c), "left").drop("_k", f"_{c}")
        worth = F.col("gain") - F.coalesce("of_a", F.lit(0)) - F.coalesce("of_b", F.lit(0))
        return foremost(over.withColumn("worth", worth).filter("worth > 0"), n)

    return search


def foremost_of_block(a: np.ndarray, b: np.ndarray, n: int, worth: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """(rows, columns, IoU, gain, what it gains beyond its ends) of pairs of boxes a and b (x1, y1, x2, y2 in columns): the n of
    each box that gain most or, where the worth of both sides is given, the n that gain most beyond it.

    Some rows meet all columns at a time. The formula and its order are those of geometry.box_iou, so doubles are the same.
    """
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = (np.ascontiguousarray(x.T) for x in (a, b))
    size = lambda x1, y1, x2, y2: np.maximum(x2 - x1, 0) * np.maximum(y2 - y1, 0)
    of_a, of_b = size(ax1, ay1, ax2, ay2), size(bx1, by1, bx2, by2)
    noise = np.random.default_rng(len(a)).random((STRIP, len(b))) * 1e-9  # deals equal pairs over the boxes
    found: list[tuple[np.ndarray, ...]] = []
    top, above, cols = np.zeros((2, n, len(b))), np.zeros((n, len(b)), np.int64), np.arange(len(b))
    for at in range(0, len(a), STRIP):
        e = slice(at, at + STRIP)
        w = np.minimum(ax2[e, None], bx2)
        w -= np.maximum(ax1[e, None], bx1)
        h = np.minimum(ay2[e, None], by2)
        h -= np.maximum(ay1[e, None], by1)
        np.maximum(w, 0, out=w)
        w *= np.maximum(h, 0, out=h)
        np.add(of_a[e, None], of_b, out=h)
        h -= w
        np.divide(w, h, out=w, where=h != 0)
        if worth is not None:
            np.add((worth[0][e, None] - SLACK) / UNIT, worth[1] / UNIT, out=h)
            i, j = np.nonzero(w > h)
            found.append((i + at, j, w[i, j]))
            continue
        rows = np.arange(len(w))
        for axis in (1, 0):
            np.add(w, noise[: len(w)], out=h)
            for _ in range(min(n, w.shape[axis])):
                i, j = (rows, h.argmax(1)) if axis else (h.argmax(0), cols)
                if axis:
                    found.append((i + at, j, w[i, j]))
                else:
                    last = top[0].argmin(0)
                    better = h[i, j] > top[0, last, cols]
                    put = (last[better], cols[better])
                    top[0][put], top[1][put], above[put] = h[i, j][better], w[i, j][better], i[better] + at
                h[i, j] = -1
    if worth is None:
        found.append((above.ravel(), np.tile(cols, n), top[1].ravel()))
    i, j, iou = (np.concatenate(x) for x in zip(*found, strict=True))
    gain = (iou.astype(np.float32).astype(np.float64) * UNIT).astype(np.int64)
    more = gain - worth[0][i] - worth[1][j] if worth is not None else gain
    some = np.nonzero(more > 0)[0]
    if worth is not None and len(some):
        tie, keep = np.random.default_rng(len(some)).random(len(some)), np.zeros(len(some), bool)
        for x in (i[some], j[some]):
            order = np.lexsort((tie, -more[some], x))
            first = np.searchsorted(x[order], x[order])
            keep[order[np.arange(len(order)) - first < n]] = True
        some = some[keep]
    return i[some], j[some], iou[some], gain[some], more[some]


def box_search(left: DataFrame, right: DataFrame) -> Callable[[DataFrame | None, int], DataFrame]:
    """As pair_search over all pairs of boxes (k, a or b, x1, y1, x2, y2) of a key, which are made in blocks of about BLOCK by
    BLOCK boxes and of which only the foremost leave the block. No table of all pairs is written or sorted."""
    kinds = dict(left.dtypes)
    out = f"k {kinds['k']}, a {kinds['a']}, b {dict(right.dtypes)['b']}, iou double, gain long, worth long"
    count = lambda x, c: x.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(f"n_{c}"))
    blocks = written(count(left, "a").join(count(right, "b"), "k"), "blocks")
    mine = lambda x, c: F.pmod(F.xxhash64(c), F.col(f"n_{c}")).cast("int").alias(f"in_{c}")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"n_{c}") - 1)).alias(f"in_{c}")

    def search(ends: DataFrame | None, n: int) -> DataFrame:
        known = ends is not None

        def side(x: DataFrame, c: str, other: str) -> DataFrame:
            x = x.join(blocks, "k")
            if ends is None:
                x = x.withColumn("worth", F.lit(0).cast("long"))
            else:
                x = x.join(ends.select("k").distinct(), "k", "left_semi")
                x = x.join(ends.filter(F.col("side") == c).select("k", c, "worth"), ["k", c], "left").fillna(0, ["worth"])
            dealt = x.select("k", c, "x1", "y1", "x2", "y2", "worth", mine(x, c), f"n_{other}").select("*", each(other)).drop(f"n_{other}")
            return spread(dealt, "k", "in_a", "in_b").groupBy("k", "in_a", "in_b")

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({c: [] for c in ("k", "a", "b", "iou", "gain", "worth")})
            worth = (a["worth"].to_numpy(), b["worth"].to_numpy()) if known else None
            i, j, iou, gain, more = foremost_of_block(*(x[["x1", "y1", "x2", "y2"]].to_numpy(np.float64) for x in (a, b)), n, worth)
            return a[["k", "a"]].iloc[i].reset_index(drop=True).assign(b=b["b"].to_numpy()[j], iou=iou, gain=gain, worth=more)

        found = side(left, "a", "b").cogroup(side(right, "b", "a")).applyInPandas(meet, out)
        for c in "ab":
            found = found.withColumn(f"_{c}", F.row_number().over(Window.partitionBy("k", c).orderBy(F.desc("worth"), F.xxhash64("a", "b"), "a", "b")))
        return found.filter((F.col("_a") <= n) | (F.col("_b") <= n)).select("k", "a", "b", "iou", "gain")

    return search


def by_cores(search: Callable[[DataFrame | None, int], DataFrame], part_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges (k, a, b, iou) that the assignment takes, and the keys left open because their core is too large.

    A core of edges, the best of each end, is solved, each key in one task. What its ends are worth shows for every other edge
    whether it could add to the total: where one gains more than its ends are worth, the foremost of such edges join the core
    and it is solved again. When there are none left, no assignment over all edges has a larger total. An end without an edge in
    the core is worth nothing. In the first PRUNED rounds, edges that gain less than their ends are worth by more than NEAR leave
    the core, to be found again if they are needed; later it only grows, so the rounds end.
    """
    n, core, rounds = CORE, written(search(None, CORE), "core"), 0
    kinds = dict(core.dtypes)
    out = f"k {kinds['k']}, a {kinds['a']}, b {kinds['b']}, iou double, gain long, side string, worth long"
    while True:
        near = NEAR * UNIT if rounds < PRUNED else None

        def solve(g: pd.DataFrame) -> pd.DataFrame:
            rows, cols = (pd.factorize(g[c], sort=True)[0] for c in "ab")
            took, row, col = solved(rows, cols, g["gain"].tolist())
            row, col = np.array(row, np.int64), np.array(col, np.int64)
            kept = row[rows] + col[cols] - g["gain"].to_numpy() <= near if near is not None else np.ones(len(g), bool)  # noqa: B023
            kept[took] = False
            at = np.concatenate([took, np.nonzero(kept)[0], np.unique(rows, return_index=True)[1], np.unique(cols, return_index=True)[1]]).astype(int)
            side = ["pair"] * len(took) + ["near"] * int(kept.sum()) + ["a"] * len(row) + ["b"] * len(col)
            worth = np.concatenate([np.zeros(len(took) + int(kept.sum()), np.int64), row, col])
            return g.iloc[at][["k", "a", "b", "iou", "gain"]].assign(side=side, worth=worth)

        size = written(core.groupBy(F.col("k").alias("_k")).agg(F.count("*").alias("n")), "core-sizes")
        of = lambda cond: core.join(size.filter(cond), core["k"].eqNullSafe(F.col("_k")), "left_semi")  # noqa: B023, E731
        small = spread(of(F.col("n") <= part_edges), "k")
        done = written(small.groupBy("k").applyInPandas(solve, out), "core-solved")
        n, rounds = n * 2, rounds + 1
        more = written(search(done, n), "core-more")
        if more.isEmpty():
            spent(more)
            return done.filter("side = 'pair'").select("k", "a", "b", "iou"), size.filter(F.col("n") > part_edges).select("_k")
        kept = done.filter("side in ('pair', 'near')").select("k", "a", "b", "iou", "gain").union(of(F.col("n") > part_edges))
        grown = written(kept.union(more), "core")
        for x in (core, done, more, size):
            spent(x)
        core = grown


def by_parts(e: DataFrame, part_edges: int) -> DataFrame:
    """Of edges (k, a, b, iou), those that the assignment takes.

    Pairs that share no end with another are taken at once; parts of up to part_edges pairs are solved each in one task, by
    their edges; larger ones by rounds of bids, on whole gains of 2**-20.
    """
    kinds = dict(e.dtypes)
    node = lambda side: F.concat_ws("\x01", F.coalesce(F.col("k").cast("string"), F.lit("\x02")), F.lit(side), F.col(side).cast("string"))
    label = components(e.select(node("a").alias("a"), node("b").alias("b")))
    parted = written(e.withColumn("_n", node("a")).join(label.withColumnRenamed("component", "part"), F.col("_n") == F.col("node")).select("part", "k", "a", "b", "iou"), "parts")
    size = parted.groupBy("part").agg(F.count("*").alias("n"))
    sized = parted.join(size, "part")
    out = f"k {kinds['k']}, a {kinds['a']}, b {kinds['b']}, iou double"

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pd.factorize(g["a"], sort=True)[0], pd.factorize(g["b"], sort=True)[0]
        took = best_pairs(rows, cols, [int(float(x) * UNIT) for x in g["iou"].to_numpy(np.float32)])
        return g.iloc[took][["k", "a", "b", "iou"]]

    done = sized.filter("n = 1").select("k", "a", "b", "iou").union(sized.filter(F.col("n").between(2, part_edges)).select("part", "k", "a", "b", "iou").groupBy("part").applyInPandas(solve, out))
    large = sized.filter(F.col("n") > part_edges)
    if not large.isEmpty():
        taken = bids(large.select("part", "a", "b", F.greatest(F.lit(1), F.round(F.col("iou") * BID_UNIT)).cast("long").alias("gain")))
        on = (F.col("e.part") == F.col("t.part")) & (F.col("e.a").cast("string") == F.col("t.a")) & (F.col("e.b").cast("string") == F.col("t.b"))
        done = done.union(large.alias("e").join(taken.alias("t"), on, "left_semi").select("k", "a", "b", "iou"))
    return done


def assign(pairs: DataFrame, key: str, threshold: float, part_edges: int = PART_EDGES) -> DataFrame:
    """(key, a, b, iou) of the one-to-one assignment with the largest total IoU in each key, and IoU >= threshold.

    pairs: (key, a, b, iou), one row a pair; those without a positive IoU can't be in it. IoU is compared in single precision.
    A key is solved over a core of its pairs that grows until no other pair can add to the total (by_cores); one whose core
    has more than part_edges pairs by the parts of its graph that hang together (by_parts). Which of several equally good
    assignments is taken is not said.
    """
    e = written(pairs.filter("iou > 0").select(F.col(key).alias("k"), "a", "b", "iou"), "pairs")
    done, large = by_cores(pair_search(e), part_edges)
    if not large.isEmpty():
        done = done.union(by_parts(e.join(large, e["k"].eqNullSafe(large["_k"]), "left_semi"), part_edges))
    enough = F.col("iou").cast("float") >= F.lit(threshold).cast("float")
    return done.filter(enough).select(F.col("k").alias(key), "a", "b", "iou")


def assign_boxes(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, threshold: float, part_edges: int = PART_EDGES) -> DataFrame:
    """As assign, of all pairs of boxes (x1, y1, x2, y2) under one key, which are looked through but never all written.

    Boxes with a NULL, NaN or infinite side pair with none. Each round looks at every pair of a key again, so time grows with
    their number; memory and disk grow with the boxes. Keys with a larger core than part_edges get their pairs written.
    """
    whole = lambda x: F.expr(" and ".join(f"abs({c}) < double('infinity')" for c in X.BOX))
    sides = [x.filter(whole(x) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(i).alias(c), *(F.col(v).cast("double") for v in X.BOX)) for x, i, c in ((left, left_id, "a"), (right, right_id, "b"))]
    a, b = (written(x, "boxes") for x in sides)
    done, large = by_cores(box_search(a, b), part_edges)
    if large.isEmpty():
        for x in (a, b):
            spent(x)
    else:
        a, b = (x.join(large, x["k"] == large["_k"], "left_semi") for x in (a, b))
        pairs = X.with_box_iou(X.candidates(spread(a, "a"), b, "k", "a", "b", cell=0.25)).filter("iou > 0").select("k", "a", "b", "iou")
        done = done.union(by_parts(written(pairs, "pairs"), part_edges))
    enough = F.col("iou").cast("float") >= F.lit(threshold).cast("float")
    return done.filter(enough).select(F.col("k").alias(key), "a", "b", "iou")
