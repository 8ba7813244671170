"""Relational operators over measurement tables: joins, relabelling, dedup, windows, set operations, summaries.

All are lazy DataFrame expressions. Dimension tables (maps, lists) are ordinary join sides: Spark broadcasts them while
they are below its size limit and shuffles beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from . import ranking as R

ALL = "all"


# --- joins ------------------------------------------------------------------------------------------------------------


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool = False) -> DataFrame:
    """One row a key: the first (or last) in a stated order, which should be total."""
    by = [c if isinstance(c, Column) else F.col(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*(c.desc() if last else c for c in by))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, to: str, default: Column | None = None) -> DataFrame:
    """df with `to` taken from table by key; NULL, or the default, where it has none. The table's key must be unique."""
    t = table.select(F.col(table_key).alias("_k"), F.col(value).alias("_v"))
    out = df.join(t, F.col(key) == F.col("_k"), "left")
    return out.withColumn(to, F.col("_v") if default is None else F.coalesce("_v", default)).drop("_k", "_v")


def two_stage_lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, to: str) -> DataFrame:
    """The exact key first, then the key in lower case (first by key where several agree)."""
    exact = lookup(df, key, table, table_key, value, "_exact")
    low = keep_first(table.withColumn("_low", F.lower(table_key)), ["_low"], [table_key])
    both = lookup(exact.withColumn("_key_low", F.lower(key)), "_key_low", low, "_low", value, "_lower")
    return both.withColumn(to, F.coalesce("_exact", "_lower")).drop("_exact", "_lower", "_key_low")


def unique_or_error(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """df, whose evaluation fails if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_ok", F.when(n > 1, F.raise_error(F.lit(f"{what}: duplicate key"))).otherwise(True)).filter("_ok").drop("_ok")


def known_or_error(df: DataFrame, column: str, what: str) -> DataFrame:
    """df, whose evaluation fails where the column is NULL."""
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{what}: no match"))).otherwise(F.col(column)))


def with_indicator(df: DataFrame, table: DataFrame, key: str, columns: Sequence[str], overrides: DataFrame | None = None) -> DataFrame:
    """Left join with `status`: matched, unmatched, or incomplete where a joined column is NULL; overrides win by key."""
    t = table.select(F.col(key).alias("_k"), *columns)
    out = df.join(t, F.col(key) == F.col("_k"), "left")
    if overrides is not None:
        o = overrides.select(F.col(key).alias("_o"), *(F.col(c).alias(f"_o_{c}") for c in columns))
        out = out.join(o, F.col(key) == F.col("_o"), "left")
        out = out.withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns}).withColumn("_k", F.coalesce("_k", "_o")).drop("_o", *(f"_o_{c}" for c in columns))
    some_null = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
    return out.withColumn("status", F.when(F.col("_k").isNull(), "unmatched").when(some_null, "incomplete").otherwise("matched")).drop("_k")


def common(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of each side whose key the other has too; multiplicities stay."""
    one, two = (x.select(*keys).distinct() for x in (a, b))
    return a.join(two, list(keys), "left_semi"), b.join(one, list(keys), "left_semi")


def attach(matches: DataFrame, table: DataFrame, key: str, table_key: str, columns: Sequence[str], suffix: str) -> DataFrame:
    """Left join of measurements on a file name; their columns get the suffix, the helper key goes."""
    t = table.select(F.col(table_key).alias("_k"), *(F.col(c).alias(f"{c}{suffix}") for c in columns))
    return matches.join(t, F.col(key) == F.col("_k"), "left").drop("_k")


def mismatches(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Shared keys with different values."""
    x, y = a.select(key, F.col(value).alias("old")), b.select(key, F.col(value).alias("new"))
    return x.join(y, key).filter(~F.col("old").eqNullSafe(F.col("new")))


# --- relabelling ------------------------------------------------------------------------------------------------------


def relabel(df: DataFrame, column: str, mapping: DataFrame, to: str | None = None) -> DataFrame:
    """Merge map (src, parent); what it doesn't name stays itself."""
    return lookup(df, column, mapping, "src", "parent", to or column, F.col(column))


def bucket(df: DataFrame, column: str, mapping: DataFrame, to: str = "bucket") -> DataFrame:
    """Map (src, parent, priority): of several parents the one with the smallest priority; rows without one go."""
    first = mapping.groupBy("src").agg(F.min_by("parent", "priority").alias("parent"))
    return lookup(df, column, first, "src", "parent", to).filter(F.col(to).isNotNull())


def on_axes(df: DataFrame, column: str, axes: DataFrame) -> DataFrame:
    """Long map (axis, src, parent): a row for each axis that covers it. A source twice on one axis is an error."""
    checked = unique_or_error(axes, ["axis", "src"], "axes")
    return df.join(checked, F.col(column) == F.col("src")).drop("src")


def flattened(df: DataFrame, column: str, to: int = 0) -> DataFrame:
    """Every category id the same; `changed` says where it was another."""
    return df.withColumn("changed", ~F.col(column).eqNullSafe(F.lit(to))).withColumn(column, F.lit(to))


def split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """`split`: train for the first int(n ratio) rows in the order of a seeded hash of the key, else valid.

    Exact, so it counts: ranks come from the hash's order over all rows in two steps, without a single-task sort. The hash's
    top bits make ranges that are counted first; rows are then ranked inside their range only.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    parts = df.withColumn("_h", h).withColumn("_part", F.shiftright("_h", 52))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = parts.join(base, "_part").withColumn("_rank", F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", key)))
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_all") * ratio), "train").otherwise("valid")).drop("_h", "_part", "_base", "_all", "_rank")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, or all if there are fewer: the first in the order of the MD5 of `key:seed`, then of the key. The same rows
    whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


# --- windows ----------------------------------------------------------------------------------------------------------


def top(df: DataFrame, by: str, value: str, tie: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.abs(F.col(value)).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def batches(df: DataFrame, order: str, k: int, per: str | None = None) -> DataFrame:
    """Contiguous batches 1..k, the first n mod k one larger; `per` starts anew for each value."""
    if per:
        return df.withColumn("batch", F.ntile(k).over(Window.partitionBy(per).orderBy(order)))
    rows = R.numbered(df, order, "_at", "_rows")
    return rows.withColumn("batch", R.batch_of(F.col("_at"), F.col("_rows"), k)).drop("_at", "_rows")


def after_first(df: DataFrame, order: str, n: int, per: str | None = None) -> DataFrame:
    """df without its first n rows in the order of a column, or those of each value of `per`."""
    if per:
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy(per).orderBy(order))).filter(F.col("_rn") > n).drop("_rn")
    return R.numbered(df, order, "_at").filter(F.col("_at") > n).drop("_at")


def islands(df: DataFrame, per: Sequence[str], order: str, flag: str) -> DataFrame:
    """Runs of equal flags: (per, run, flag, first, last, n)."""
    w = Window.partitionBy(*per).orderBy(order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    runs = df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*per, "run").agg(F.first(flag).alias(flag), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def new_ids(df: DataFrame, order: str, start: int, name: str = "new_id") -> DataFrame:
    """df with ids start + 1, start + 2, ... in the order of a column."""
    return R.numbered(df, order, name).withColumn(name, F.col(name) + start)


# --- summaries --------------------------------------------------------------------------------------------------------


QUARTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def box_stats(df: DataFrame, by: str | Sequence[str], value: str, total: str | None = None) -> DataFrame:
    """(by, n, mean, median, sd, q25, q75) of a group; with `total` also over all rows under that name, in place of the last
    column of by. The sample SD of one value is 0. Exact, and no task holds a group; df is computed once."""
    by = [by] if isinstance(by, str) else list(by)
    rows = R.shared(df.select(*by, F.col(value).cast("double").alias("_x")))
    if total is not None:
        rows = rows.withColumn(by[-1], F.explode(F.array(F.col(by[-1]), F.lit(total))))
    v = F.col("_x")
    sd = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))
    stats = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), sd.alias("sd"))
    return R.with_quantiles(stats, rows, by, "_x", QUARTILES).select(*by, "n", "mean", "median", "sd", "q25", "q75")


def grouped(df: DataFrame, by: str, aggregates: Sequence[Column], total: str | None = None) -> DataFrame:
    """Aggregates a group; with `total` also over all rows under that name, in one pass (grouping sets)."""
    if total is None:
        return df.groupBy(by).agg(*aggregates)
    out = df.rollup(by).agg(F.grouping(by).alias("_g"), *aggregates)
    return out.withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by))).drop("_g")


def share_found(df: DataFrame, by: str, truth: str, found: str, total: str | None = ALL) -> DataFrame:
    """Sums, and 100 found / truth; 0 where there is no truth."""
    out = grouped(df, by, [F.sum(truth).cast("long").alias("n_truth"), F.sum(found).cast("long").alias("n_found")], total)
    return out.withColumn("percent", F.coalesce(100.0 * F.try_divide(F.col("n_found"), F.col("n_truth")), F.lit(0.0)))


def correlations(df: DataFrame, by: str, pairs: dict[str, tuple[str, str]], total: str | None = ALL) -> DataFrame:
    """r, r2 and n of each named pair of columns."""
    aggs = []
    for name, (x, y) in pairs.items():
        r = M.correlation(F.col(x), F.col(y))
        n = F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))
        aggs += [n.alias(f"n_{name}"), F.when(n >= 2, r).alias(f"r_{name}")]
    out = grouped(df, by, aggs, total)
    return out.withColumns({f"r2_{name}": F.col(f"r_{name}") * F.col(f"r_{name}") for name in pairs})


def ratio_to_control(df: DataFrame, group: str, dose: str, value: str, to: str = "ratio") -> DataFrame:
    """The value over its group's mean at dose 0; NULL without a control.

    The mean is aggregated first and joined back, so no group's rows meet in one task.
    """
    control = df.filter(F.col(dose) == 0).groupBy(group).agg(F.avg(value).alias("_control"))
    return df.join(control, group, "left").withColumn(to, F.try_divide(F.col(value), F.col("_control"))).drop("_control")


def speed_batches(df: DataFrame, order: str, seconds: str, k: int, warm_up: int = 0) -> DataFrame:
    """(batch, items, s): sums of k contiguous batches after the warm-up."""
    rows = R.numbered(df, order, "_at", "_rows").filter(F.col("_at") > warm_up)
    rows = rows.withColumn("batch", R.batch_of(F.col("_at") - warm_up, F.col("_rows") - warm_up, k))
    return rows.groupBy("batch").agg(F.count("*").alias("items"), F.sum(seconds).alias("s"))


def speed_summary(df: DataFrame, order: str, seconds: str, k: int, warm_up: int = 0) -> DataFrame:
    """Of the batches: mean, sample SD, extremes and median of their k sums, rate and time an item."""
    sums = speed_batches(df, order, seconds, k, warm_up)
    total = sums.agg(
        F.count("*").alias("batches"), F.sum("items").alias("items"), F.avg("s").alias("mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("sd"),
        F.min("s").alias("min"), F.max("s").alias("max"), F.percentile("s", F.lit(0.5)).alias("median"), F.sum("s").alias("total"),
    )
    return total.withColumn("per_second", F.coalesce(F.try_divide(F.col("items"), F.col("total")), F.lit(0.0))).withColumn("per_item", F.try_divide(F.col("total"), F.col("items"))).drop("total")


def module_times(df: DataFrame, item: str, module: str, seconds: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Time of each module in an item, then its mean over items."""
    per = df.filter(~F.col(module).isin(*excluded)).groupBy(item, module).agg(F.sum(seconds).alias("s"))
    return per.groupBy(module).agg(F.count("*").alias("items"), F.avg("s").alias("mean_s"))


def histogram(df: DataFrame, value: str, few: bool = True) -> DataFrame:
    """(bin, lo, hi, n) of equal bins between the extremes; the largest value is in the last bin."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")).withColumn("_k", M.bins(F.col("_n"), few))
    x = df.filter(F.col(value).isNotNull()).join(ends)
    step = (F.col("_hi") - F.col("_lo")) / F.col("_k")
    k = F.coalesce(F.least(F.col("_k") - 1, F.floor(F.try_divide(F.col(value) - F.col("_lo"), step)).cast("int")), F.lit(0))
    return x.withColumn("bin", k).groupBy("bin").agg(F.min(F.col("_lo") + k * step).alias("lo"), F.min(F.col("_lo") + (k + 1) * step).alias("hi"), F.count("*").alias("n"))


def profile(df: DataFrame, per: str, segment: str, value: str, n: int) -> DataFrame:
    """Mean, population SD and count of each of n segments; mean NULL and count 0 where a segment is empty."""
    got = df.groupBy(per, segment).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))
    grid = df.select(per).distinct().select(per, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(segment))
    return grid.join(got, [per, segment], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def union_by_name(main: DataFrame, extra: DataFrame) -> DataFrame:
    """Columns of the first in its order, then those that only the second has; NULL where a side lacks one."""
    return main.unionByName(extra, allowMissingColumns=True)
