"""Positions, ranks and quantiles of tables of any size; no task holds a whole table or group, or sorts one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an ordered column is cut into, values that are sampled for each, and parts of a range that holds one value.
RANGES, SAMPLED, SALTS = 256, 100, 64


def same(names: Sequence[tuple[str, str]]) -> Column:
    """Null-safe equality of pairs of columns."""
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in names), F.lit(True))


# --- positions --------------------------------------------------------------------------------------------------------


def ranges(df: DataFrame, order: str, n: int = RANGES, seed: int = 42) -> tuple[Column, Column]:
    """(range, single): the number of the range that a row's value is in, ascending with the value, and whether the range
    holds one value only.

    The bounds are values of a sample of n * SAMPLED rows, which is all that the driver gets. They are fixed here, before any
    plan that uses them, so every use of the column cuts a table alike, whatever Spark does with its partitions. NULL comes
    first. A value that fills more than one range gets one of its own.
    """
    values = df.select(F.col(order).alias("v")).filter("v is not null")
    rows = values.count()
    picked = [r[0] for r in values.sample(min(1.0, n * SAMPLED / rows), seed).orderBy("v").collect()] if rows else []
    picked = [x for x in picked if x == x]
    cuts = [picked[len(picked) * k // n] for k in range(1, n)] if picked else []
    bounds = [x for k, x in enumerate(cuts) if not k or x != cuts[k - 1]]
    hot = [x for x in bounds if cuts.count(x) > 1]
    v = F.col(order)

    def below(lo: int, hi: int) -> Column:
        """How many of the bounds are below the value, if there are lo to hi."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v > F.lit(bounds[mid]), below(mid + 1, hi)).otherwise(below(lo, mid))

    own = F.coalesce(v.isin(*hot), F.lit(False)) if hot else F.lit(False)
    return F.when(v.isNull(), F.lit(-1)).otherwise(2 * below(0, len(bounds)) + own.cast("int")), v.isNull() | own


def numbered(df: DataFrame, order: str, name: str, total: str | None = None) -> DataFrame:
    """df with its position from 1 in the order of a column, and the number of rows if `total` names a column for it; nulls
    first, equal values in any order.

    Rows are dealt out by range and numbered inside it; a range of one value, where any order will do, also by a hash of the
    row. Only the sizes of these parts are summed up over all of them. df is read three times and must give the same rows
    each time.
    """
    part, single = ranges(df, order)
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    salt = F.when(single, F.pmod(F.xxhash64(*hashed), F.lit(SALTS))).otherwise(F.lit(0))
    rows = df.withColumns({"_part": part, "_salt": salt})
    sizes = rows.groupBy("_part", "_salt").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("_part").alias("_p"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_part", "_salt").orderBy(order)))
    ranked = ranked.join(base, (F.col("_part") == F.col("_p")) & (F.col("_salt") == F.col("_s")), "left")
    at = F.coalesce("_base", F.raise_error(F.lit("numbered: rows changed between two reads")).cast("long")) + F.col("_at")
    out = ranked.withColumn(name, at)
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.select(*(f"`{c}`" for c in df.columns if c not in (name, total)), name, *([total] if total else []))


def batch_of(position: Column, rows: Column, k: int) -> Column:
    """The batch, 1 to k, of a position from 1: batches are contiguous, the first rows % k of them one larger."""
    size, more = F.floor(rows / k), rows % k
    large = more * (size + 1)
    return F.when(position <= large, F.floor((position - 1) / (size + 1))).otherwise(more + F.floor(F.try_divide(position - 1 - large, size))).cast("int") + 1


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, ties, rank): each distinct value with its average rank.

    Counting distinct values first leaves one row a value for the running sum, which works inside ranges; only the ranges'
    totals are accumulated over all.
    """
    part, _ = ranges(df, value)
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties")).withColumn("_part", part)
    sizes = counts.groupBy("_part").agg(F.sum("ties").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    run = F.sum("ties").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_run", run).join(base, F.col("_part") == F.col("_p"), "left")
    at = F.coalesce("_base", F.raise_error(F.lit("average_ranks: rows changed between two reads")).cast("long"))
    return ranked.select(value, "ties", (at + F.col("_run") - (F.col("ties") - 1) / 2).alias("rank"))


# --- quantiles --------------------------------------------------------------------------------------------------------


def ordered_bits(x: Column) -> Column:
    """A long in the order of the doubles: the 63 bits of exponent and fraction, negated below zero. Not for NaN."""
    a = F.abs(x)
    e = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(a)).cast("double")))
    m = a / F.pow(F.lit(2.0), e)
    m, e = F.when(m >= 2, m / 2).when(m < 1, m * 2).otherwise(m), F.when(m >= 2, e + 1).when(m < 1, e - 1).otherwise(e)
    normal = F.shiftleft((e + 1023).cast("long"), 52) + ((m - 1) * float(1 << 52)).cast("long")
    small = (a * 2.0**537 * 2.0**537).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(2047 << 52)).when(a < 2.0**-1022, small).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def shared(df: DataFrame) -> DataFrame:
    """df behind an exchange, dealt out by a hash of its rows. Plans that use it several times compute it once, as Spark uses
    an exchange again where it is the same."""
    return df.repartition(F.xxhash64(*df.columns))


def quantiles(df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """by and a column for each name of wanted: that quantile of the value's numbers in the group, with linear interpolation
    between neighbours. NULL and NaN don't count; groups without a number have no row.

    Radix selection: a double is a long in the same order; counts by its leading 16 bits show which leading bits hold a
    wanted rank, then only rows with these are counted by the next 16 bits, four times in all. What is gathered of a group is
    at most 65536 counts for each of its wanted ranks, whatever its size. df is read four times: wrap a costly one in
    shared().
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = rows.select(*by, "_v", ordered_bits(F.col("_v")).alias("_key"))
    ends = sorted(set(wanted.values()))
    long = lambda c: c.cast("long")
    positions = lambda n: F.array_distinct(F.flatten(F.array(*(F.array(long(F.floor(q * (n - 1))), long(F.ceil(q * (n - 1)))) for q in ends))))

    def narrowed(counts: DataFrame, per: list[str], at: str, ranks: Column) -> DataFrame:
        """Of counts by `at` inside `per`, those that hold a wanted rank, with the ranks they hold, counted from their start."""
        w = Window.partitionBy(*per).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        x = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).withColumn("_ranks", ranks)
        own = F.filter("_ranks", lambda r: (r["left"] >= F.col("_before")) & (r["left"] < F.col("_before") + F.col("_c")))
        moved = F.transform(own, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - F.col("_before")).alias("left")))
        return x.withColumn("_ranks", moved).filter(F.size("_ranks") > 0)

    first = rows.groupBy(*by, F.shiftright("_key", 48).alias("_p")).agg(F.count("*").alias("_c"))
    first = first.withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    held = narrowed(first, by, "_p", F.transform(positions(F.col("_n")), lambda r: F.struct(r.alias("rank"), r.alias("left"))))
    for shift in (32, 16, 0):
        table = held.select(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_p").alias("_w"), "_n", "_ranks")
        at = rows.withColumn("_p", F.shiftright("_key", shift)).withColumn("_up", F.shiftright("_key", shift + 16))
        # null-safe, so that no filter on the key is inferred and pushed below a shared exchange, which would tell them apart
        met = at.join(table, same([*((c, f"_by{k}") for k, c in enumerate(by)), ("_up", "_w")]))
        counts = met.groupBy(*by, "_w", "_p", "_n", "_ranks").agg(F.count("*").alias("_c"), F.min("_v").alias("_v"))
        held = narrowed(counts, [*by, "_w"], "_p", F.col("_ranks"))
    found = held.select(*by, "_n", "_v", F.explode("_ranks.rank").alias("_rank"))
    found = found.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))

    def between(q: float) -> Column:
        pos = q * (F.col("_n") - 1)
        lo, hi = long(F.floor(pos)), long(F.ceil(pos))
        a, b = F.element_at("_at", lo), F.element_at("_at", hi)
        return F.when(a == b, a).otherwise((hi - pos) * a + (pos - lo) * b)

    return found.select(*by, *(between(q).alias(name) for name, q in wanted.items()))


def with_quantiles(stats: DataFrame, df: DataFrame, by: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """stats (one row a group) with the quantiles of df's value in the same group; NULL where it has no number."""
    q = quantiles(df, by, value, wanted).select(*(F.col(c).alias(f"_q{k}") for k, c in enumerate(by)), *wanted)
    return stats.join(q, same([(c, f"_q{k}") for k, c in enumerate(by)]), "left").drop(*(f"_q{k}" for k in range(len(by))))
