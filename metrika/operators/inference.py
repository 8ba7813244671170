"""Tests and fits: sufficient statistics in Spark, distribution functions in numpy on the few rows that are left."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking as R

# --- distributions ----------------------------------------------------------------------------------------------------


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction (Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_cdf(x):
    return 0.5 * (1 + np.vectorize(math.erf)(np.asarray(x) / math.sqrt(2)))


@lru_cache(maxsize=4)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    x, g = _nodes(64)
    lo, hi = -8.0, 8.0
    z = (hi - lo) / 2 * x + (hi + lo) / 2
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = normal_cdf(z[None, :] + np.atleast_1d(w)[:, None]) - normal_cdf(z)[None, :]
    return k * ((hi - lo) / 2) * (g * phi * np.clip(inner, 0, 1) ** (k - 1)).sum(axis=1)


def studentized_tail(q: float, k: int, df: float) -> float:
    """P(studentized range of k means with df degrees > q), by quadrature over the pooled deviation."""
    if q <= 0:
        return 1.0
    if df > 5000:
        return float(1 - range_cdf(np.array([q]), k)[0])
    x, g = _nodes(96)
    hi = 1 + 9 / math.sqrt(2 * df) + (4 / df)
    lo = max(1e-6, 1 - 9 / math.sqrt(2 * df))
    s = (hi - lo) / 2 * x + (hi + lo) / 2
    log = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - ((hi - lo) / 2 * g * np.exp(log) * range_cdf(q * s, k)).sum())))


def exact_u_two_sided(u: float, n1: int, n2: int) -> float:
    """Mann-Whitney p without ties by counting arrangements."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    table = {(0, j): np.array([1.0]) for j in range(n2 + 1)}
    for i in range(1, n1 + 1):
        table[i, 0] = np.array([1.0])
        for j in range(1, n2 + 1):
            c = np.zeros(i * j + 1)
            a, b = table[i - 1, j], table[i, j - 1]
            c[j : j + len(a)] += a
            c[: len(b)] += b
            table[i, j] = c
    ways = table[n1, n2] / table[n1, n2].sum()
    big = max(u, n1 * n2 - u)
    return float(min(1.0, 2 * ways[int(round(big)) :].sum()))


# --- SQL moments ------------------------------------------------------------------------------------------------------


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: k, n, ss_between, ss_within, f, p."""
    m = group_moments(df, group, value).withColumn("sum", F.col("n") * F.col("mean"))
    grand = m.agg((F.sum("sum") / F.sum("n")).alias("_grand"))
    s = m.join(grand).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) ** 2).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ss_within"),
    )
    f = F.try_divide(F.try_divide(F.col("ss_between"), F.col("k") - 1), F.try_divide(F.col("ss_within"), F.col("n") - F.col("k")))
    tail = F.pandas_udf(lambda a, b, c: pd.Series([f_tail(x, y, z) if x == x else None for x, y, z in zip(a, b, c, strict=True)]), "double")
    return s.withColumn("f", f).withColumn("p", tail("f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def tukey(df: DataFrame, group: str, value: str) -> DataFrame:
    """(a, b, diff, q, p) for every pair of groups."""
    m = group_moments(df, group, value)
    pooled = m.agg(F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("dof"), (F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))) / F.sum(F.col("n") - 1)).alias("mse"))
    a, b = (m.select(F.col(group).alias(s), F.col("n").alias(f"n_{s}"), F.col("mean").alias(f"m_{s}")) for s in "ab")
    pairs = a.join(b, F.col("a") < F.col("b")).join(pooled)
    q = F.abs(F.col("m_a") - F.col("m_b")) / F.sqrt(F.col("mse") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b")))
    tail = F.pandas_udf(lambda x, k, d: pd.Series([studentized_tail(u, int(v), float(w)) for u, v, w in zip(x, k, d, strict=True)]), "double")
    return pairs.select("a", "b", (F.col("m_a") - F.col("m_b")).alias("diff"), q.alias("q"), tail(q, "k", "dof").alias("p"))


def rank_sum(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """Two-sided Mann-Whitney: n1, n2, u1, p; normal with tie and continuity corrections, exact for small samples without ties."""
    two = df.filter(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranks = R.average_ranks(two, value)
    tie = ranks.agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tie"))
    one = two.filter(F.col(group) == first).groupBy(value).agg(F.count("*").alias("c")).join(ranks, value).agg(F.sum(F.col("c") * F.col("rank")).alias("r1"), F.sum("c").alias("n1"))
    other = two.filter(F.col(group) == second).agg(F.count("*").alias("n2"))
    s = one.join(other).join(tie).select("n1", "n2", (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u1"), "tie")

    def p(n1: pd.Series, n2: pd.Series, u: pd.Series, tie: pd.Series) -> pd.Series:
        out = []
        for a, b, x, t in zip(n1, n2, u, tie, strict=True):
            n = a + b
            if t == 0 and min(a, b) <= 8:
                out.append(exact_u_two_sided(x, int(a), int(b)))
                continue
            sd = math.sqrt(a * b / 12 * ((n + 1) - t / (n * (n - 1))))
            z = (abs(x - a * b / 2) - 0.5) / sd if sd else 0.0
            out.append(min(1.0, math.erfc(max(z, 0) / math.sqrt(2))))
        return pd.Series(out)

    return s.withColumn("p", F.pandas_udf(p, "double")(*(F.col(c).cast("double") for c in ("n1", "n2", "u1", "tie")))).drop("tie")


def welch(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """t, df and two-sided p of two groups with their own variances."""
    m = group_moments(df, group, value)
    a, b = (m.filter(F.col(group) == g).select(F.col("n").alias(f"n{k}"), F.col("mean").alias(f"m{k}"), (F.col("var") / F.col("n")).alias(f"v{k}")) for k, g in ((1, first), (2, second)))
    s = a.join(b).select(
        "n1", "n2", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(F.col("v1") + F.col("v2"))).alias("t"),
        F.try_divide((F.col("v1") + F.col("v2")) ** 2, F.col("v1") ** 2 / (F.col("n1") - 1) + F.col("v2") ** 2 / (F.col("n2") - 1)).alias("df"),
    )
    p = F.pandas_udf(lambda t, d: pd.Series([t_two_sided(x, y) if x == x and y == y else None for x, y in zip(t, d, strict=True)]), "double")
    return s.withColumn("p", p("t", "df"))


def regression(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Regression of y on x a group: n, slope, intercept, r2, and bias, mean, extreme and median errors of y - x."""
    rows = R.shared(df.select(by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))).withColumn("_e", F.col("_y") - F.col("_x"))
    u, v, e = F.col("_x"), F.col("_y"), F.col("_e")
    slope = F.try_divide(F.covar_pop(u, v), F.var_pop(u))
    r2 = F.try_divide(F.covar_pop(u, v) ** 2, F.var_pop(u) * F.var_pop(v))
    stats = rows.groupBy(by).agg(
        F.count(F.when(u.isNotNull() & v.isNotNull(), 1)).alias("n"), slope.alias("slope"), (F.avg(v) - slope * F.avg(u)).alias("intercept"), r2.alias("r2"),
        F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.min(e).alias("min_error"), F.max(e).alias("max_error"),
    )
    return R.with_quantiles(stats, rows, [by], "_e", {"median_error": 0.5})


# --- dose response ----------------------------------------------------------------------------------------------------


def ll4(x: np.ndarray, b: np.ndarray, c: float, d: float, e: np.ndarray) -> np.ndarray:
    """Four-parameter log-logistic curve: from d at dose 0 down to c, halfway at e, with slope b."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return c + (d - c) / (1 + np.exp(b * (np.log(x) - np.log(e))))


#: Part of the largest curvature below which a direction of the fit counts as flat.
FLAT = 1e-9


def joint_fit(strain: np.ndarray, dose: np.ndarray, weight: np.ndarray, y: np.ndarray, ssw: float, n: int, k: int, c: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levenberg-Marquardt for (d, b_1.., e_1..): d shared, c fixed; e by its logarithm. Rows are group means with weights,
    ssw what is inside the groups, n the values behind them. Slopes have no bounds, so that curves may rise. Returns parameters,
    their covariance, and which of them the data settle: all finite, the search ended before its last round, and no direction
    in which the fit is flat moves the parameter."""
    d0 = float(np.average(y[dose == 0], weights=weight[dose == 0])) if (dose == 0).any() else float(y.max())
    pos = dose[dose > 0]
    p = np.concatenate([[d0], np.ones(k), np.full(k, math.log(float(np.median(pos))) if len(pos) else 0.0)])

    def residual(p):
        with np.errstate(over="ignore"):
            e = np.exp(p[1 + k + strain])
        return np.sqrt(weight) * (y - ll4(dose, p[1 + strain], c, p[0], e))

    def slopes(p):
        out = np.empty((len(y), len(p)))
        for j in range(len(p)):
            h = 1e-6 * max(1, abs(p[j]))
            up, dn = p.copy(), p.copy()
            up[j] += h
            dn[j] -= h
            out[:, j] = -(residual(up) - residual(dn)) / (2 * h)
        return out

    r, damp, ended = residual(p), 1e-3, False
    for _ in range(rounds):
        j = slopes(p)
        a, g = j.T @ j, j.T @ r
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
        new = p + step
        rn = residual(new)
        if np.isfinite(rn).all() and rn @ rn < r @ r:
            done = np.abs(new - p).max() < 1e-10
            p, r, damp = new, rn, damp / 5
            if done:
                ended = True
                break
        else:
            damp *= 5
            if damp > 1e12:
                ended = True
                break
    j = slopes(p)
    with np.errstate(all="ignore"):
        size = np.sqrt((j * j).sum(axis=0))
        unit = j / np.where(size > 0, size, 1)
        values, vectors = np.linalg.eigh(unit.T @ unit) if np.isfinite(unit).all() else (np.zeros(len(p)), np.eye(len(p)))
        flat = values < FLAT * max(values.max(), 1e-300)
        settled = (size > 0) & ((vectors[:, flat] ** 2).sum(axis=1) < FLAT) & ended
        cov = np.linalg.pinv(j.T @ j) * (r @ r + ssw) / max(1, n - len(p)) if np.isfinite(j).all() else np.full((len(p), len(p)), np.nan)
        e = np.exp(p[1 + k :])
        back = np.diag(np.concatenate([np.ones(1 + k), e]))
        out, cov = np.concatenate([p[: 1 + k], e]), back @ cov @ back
        settled &= np.isfinite(out) & np.isfinite(np.diag(cov))
    return out, cov, settled


EC = "strain string, b double, b_se double, c_fixed double, d_shared double, d_se double, " + ", ".join(
    f"EC{q} double, EC{q}_se double, EC{q}_lower95 double, EC{q}_upper95 double" for q in (10, 50, 90)
) + ", status string"


def dose_response(df: DataFrame, strain: str, dose: str, value: str, c: float) -> DataFrame:
    """Shared-top log-logistic fit over all strains, and EC10, EC50, EC90 of each with delta-method errors.

    Spark reduces the wells to one row for each strain and dose (n, mean, inner sum of squares), which the weighted fit
    needs and no more; the fit then sees strains times doses rows, whatever the wells. `status` is `ok`, or `not settled`
    where the data leave a strain's slope or half-way dose open; its b, errors and doses are NULL then. Numbers that are not
    finite are NULL.
    """
    cells = df.filter(F.col(value).isNotNull() & F.col(dose).isNotNull()).groupBy(F.col(strain).alias("strain"), F.col(dose).cast("double").alias("dose")).agg(
        F.count("*").alias("n"), F.avg(value).alias("y"), ((F.count("*") - 1) * F.coalesce(F.var_samp(value), F.lit(0.0))).alias("ss")
    ).withColumn("one", F.lit(1))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["strain", "dose"])
        names = sorted(g["strain"].unique())
        k = len(names)
        of = g["strain"].map({s: i for i, s in enumerate(names)}).to_numpy()
        p, cov, settled = joint_fit(of, g["dose"].to_numpy(), g["n"].to_numpy(float), g["y"].to_numpy(), float(g["ss"].sum()), int(g["n"].sum()), k, c)
        rows = []
        for i, s in enumerate(names):
            b, e = p[1 + i], p[1 + k + i]
            vb, ve, vbe = cov[1 + i, 1 + i], cov[1 + k + i, 1 + k + i], cov[1 + i, 1 + k + i]
            top = {"d_shared": p[0], "d_se": math.sqrt(cov[0, 0]) if settled[0] else None}
            if not (settled[1 + i] and settled[1 + k + i]):
                rows.append({"strain": s, "c_fixed": c, **top, "status": "not settled"})
                continue
            row = {"strain": s, "b": b, "b_se": math.sqrt(max(vb, 0)), "c_fixed": c, **top, "status": "ok"}
            for q in (10, 50, 90):
                odds = q / (100 - q)
                ec = e * odds ** (1 / b)
                gb, ge = -ec * math.log(odds) / b**2, ec / e
                se = math.sqrt(max(gb * gb * vb + ge * ge * ve + 2 * gb * ge * vbe, 0))
                row |= {f"EC{q}": ec, f"EC{q}_se": se, f"EC{q}_lower95": ec - 1.96 * se, f"EC{q}_upper95": ec + 1.96 * se}
            rows.append({c: v if isinstance(v, str) or (v is not None and math.isfinite(v)) else None for c, v in row.items()})
        return pd.DataFrame(rows, columns=[c.split()[0] for c in EC.split(", ")])

    return cells.groupBy("one").applyInPandas(fit, EC)


def ec_comparison(estimates: DataFrame) -> DataFrame:
    """Long estimates (dataset, strain, EC50, EC50_se) to one row a strain and a `value ± error` column a dataset."""
    from ..functions.measures import scientific

    text = estimates.withColumn("v", scientific(F.col("EC50"), F.col("EC50_se")))
    return text.groupBy("strain").pivot("dataset").agg(F.first("v"))
