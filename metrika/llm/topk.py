"""Exact top-k inner-product search by no-random-access aggregation over sorted lists, in blocks of queries and candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import written

QUERIES_A_BLOCK, CANDIDATES_A_BLOCK, QUERIES_AT_ONCE = 2048, 4096, 256
#: Parts of the lists that are read before each look at the bounds.
DEPTHS = (1 / 64, 1 / 8, 1 / 2, 1.0)
#: Candidates still in question whose scores are resolved at once, as a multiple of k.
RESOLVED = 16


def exact_kind(q: np.ndarray, x: np.ndarray):
    """The fastest number type in which every inner product is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def nra(q: np.ndarray, x: np.ndarray, first: np.ndarray, last: np.ndarray, k: int, depths: tuple[float, ...] = DEPTHS) -> tuple[list[np.ndarray], int]:
    """For each query the rows of x with the k highest inner products, ties to the smaller row, and the entries read in all;
    the rows from first to last (left out) are none of the query's.

    A list for each dimension holds the candidates by value; a query reads it from the top where its weight is positive, else
    from the bottom, to one depth after another. The entries read give every candidate a lower bound (unread entries count
    as the list's far end) and an upper bound (as the value just read); both are summed for many queries at a time, as a
    product of their weights and a table with what is known of each entry. A query stops once no outsider's upper bound
    reaches the k-th lower bound and few insiders are left, whose final scores are then resolved; at full depth both meet.
    """
    n, kind = len(x), exact_kind(q, x)
    q, x = q.astype(kind), x.astype(kind)
    plus = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
    order = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    lists = np.take_along_axis(x, order, axis=0)
    least = -np.inf if kind != np.int64 else np.iinfo(np.int64).min
    best: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
    wanted = np.minimum(k, n - (last - first))
    todo, lengths, entries, before = np.flatnonzero(wanted > 0), np.count_nonzero(q, axis=1), 0, 0
    for depth in depths:
        t = n if depth >= 1 else max(1, int(n * depth))
        top, bottom = rank < t, rank >= n - t
        low = np.concatenate([np.where(top, x, lists[-1]), np.where(bottom, x, lists[0])], axis=1).T
        high = np.concatenate([np.where(top, x, lists[t - 1]), np.where(bottom, x, lists[n - t])], axis=1).T if t < n else low
        entries, before, left = entries + (t - before) * int(lengths[todo].sum()), t, []
        for at in range(0, len(todo), QUERIES_AT_ONCE):
            some = todo[at : at + QUERIES_AT_ONCE]
            lower = plus[some] @ low
            upper = plus[some] @ high if t < n else lower
            for r, i in enumerate(some):
                lower[r, first[i] : last[i]] = least
                bound = np.partition(lower[r], n - wanted[i])[n - wanted[i]]
                inside = np.flatnonzero(upper[r] >= bound)
                inside = inside[(inside < first[i]) | (inside >= last[i])]
                if t < n and len(inside) > RESOLVED * k:
                    left.append(i)
                    continue
                final = x[inside] @ q[i]
                best[i] = inside[np.lexsort((inside, -final))[: wanted[i]]]
        todo = np.array(left, np.int64)
        if not len(todo):
            break
    return best, entries


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component); rows whose vector is null or holds null or non-finite components are left out."""
    x = F.col(vector_col)
    inf = F.lit(float("inf"))
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < inf))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows of vectors with the highest integer inner product for each row that `queries`
    (a condition on the column id) selects, all if fewer; ties to the smaller id. A row never finds its own id.

    Queries and candidates are dealt into blocks of bounded size; each pair of blocks is one task of the search, which
    returns k rows a query, and these partial lists are ranked in a second step. No block grows with the data; the number of
    block pairs does, as the search demands. Vectors that are null or hold null or non-finite components take no part; those
    of another length than the query's are no candidates of it. Rows with a null id take no part. Rows that repeat id and
    vector count once; rows of one id with different vectors are queries of their own, with k rows each, and candidates of
    their own for other ids. No queries or no candidates give no rows. Other columns are never read.
    """
    rows = written(integer_vectors(vectors, id_col, vector_col, scale).filter("id is not null"), "vectors")
    n = rows.count()
    asked = rows.filter(queries)
    n_q, n_c = -(-max(1, asked.count()) // QUERIES_A_BLOCK), -(-max(1, n) // CANDIDATES_A_BLOCK)
    block = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    dim = F.size("v").alias("dim")
    q = asked.select("id", "v", dim, block(n_q, 1).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    c = rows.select("id", "v", dim, F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"), block(n_c, 2).alias("cb"))

    def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = t.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = t.column("v").combine_chunks()
        m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0), np.int64)
        ids, m = ids[order], m[order]
        if len(ids) and (ids[1:] == ids[:-1]).any():
            _, once = np.unique(np.column_stack([ids, m]), axis=0, return_index=True)
            ids, m = ids[np.sort(once)], m[np.sort(once)]
        return ids, m

    kinds = pa.schema([("query_id", pa.int64()), ("asked", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        (qi, qv), (ci, cv) = arrays(left), arrays(right)
        if not len(qi) or not len(ci):
            return kinds.empty_table()
        found, _ = nra(qv, cv, np.searchsorted(ci, qi), np.searchsorted(ci, qi, "right"), k)
        picked = np.concatenate(found)
        of = np.repeat(np.arange(len(qi)), [len(f) for f in found])
        score = np.einsum("ij,ij->i", qv[of], cv[picked]) if len(of) else np.empty(0, np.int64)
        asked = np.array([xxh3_64_intdigest(v.tobytes()) for v in qv], np.uint64).view(np.int64)
        return pa.Table.from_arrays([pa.array(qi[of]), pa.array(asked[of]), pa.array(ci[picked]), pa.array(score.astype(np.int64))], schema=kinds)

    keys = ["dim", "qb", "cb"]
    part = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, "query_id long, asked long, id long, score long")
    w = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "id")
    ranked = part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
