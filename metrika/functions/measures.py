"""Numbers and flags of measurement rows: Column in, Column out. Missing is NULL; NaN is turned into it on the way in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UM_PER_PX = 3.2937
#: Words that a flag column may hold without flagging.
UNFLAGGED = ("", "na", "nan", "none", "false", "0")
#: P-value limits and their marks.
STARS = ((0.0001, "****"), (0.001, "***"), (0.01, "**"), (0.05, "*"))


def number(x: Column) -> Column:
    """A double, or NULL for what isn't one, NaN and infinities."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def signed_difference(value: Column, truth: Column) -> Column:
    return value - truth


def percent_difference(value: Column, truth: Column) -> Column:
    """100 (value - truth) / truth; NULL where truth is 0."""
    return F.lit(100.0) * F.try_divide(value - truth, truth)


def sem(x: Column) -> Column:
    """Aggregate: standard error of the mean; 0 for one value."""
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over pairs; NULL if either is constant."""
    pair = x.isNotNull() & y.isNotNull()
    a, b = F.when(pair, x), F.when(pair, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def flagged(*columns: Column) -> Column:
    """Any of the columns holds a word other than UNFLAGGED; NULL doesn't flag."""
    one = [F.coalesce(~F.lower(F.trim(c.cast("string"))).isin(*UNFLAGGED), F.lit(False)) for c in columns]
    return reduce(lambda a, b: a | b, one)


def warned(a: Column, b: Column, ignore_a: bool = True, ignore_b: bool = True) -> Column:
    """Either side's warnings are not empty, unless that side is ignored."""
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return (F.lit(False) if ignore_a else some(a)) | (F.lit(False) if ignore_b else some(b))


def flag_codes(messages: Column, signatures: dict[str, str]) -> Column:
    """Messages (array) to the codes of the signatures they contain: each once, in order of first use, joined by `;`."""
    code = lambda m: F.coalesce(*(F.when(F.contains(m, F.lit(s)), c) for s, c in signatures.items()))
    return F.array_join(F.array_distinct(F.filter(F.transform(messages, code), lambda c: c.isNotNull())), ";")


def stars(p: Column) -> Column:
    out = None
    for limit, mark in STARS:
        out = F.when(p < limit, mark) if out is None else out.when(p < limit, mark)
    return out.otherwise("ns")


def micrometres(px: Column, scale: Column, um_per_px: float = UM_PER_PX, strict: bool = False) -> Column:
    """Pixels of a rescaled cut-out to micrometres; without a positive scale they count as they are, or not at all if strict."""
    good = scale.isNotNull() & (scale > 0)
    return F.when(good, F.try_divide(px, scale) * um_per_px).otherwise(F.lit(None).cast("double") if strict else px * um_per_px)


def dose_axis(dose: Column, least_positive: Column) -> Column:
    """log10 of the dose in nanomolar; dose 0 one step below the smallest positive one."""
    nm = F.when(dose > 0, dose * 1000.0)
    return F.when(dose > 0, F.log10(nm)).otherwise(F.log10(least_positive * 1000.0) - 1)


def aspect(width: Column, length: Column) -> Column:
    return F.when(length > 0, width / length)


def bins(n: Column, few: bool = True) -> Column:
    """Histogram bins: max(10, sqrt n) or min(50, max(15, n div 10))."""
    if few:
        return F.greatest(F.lit(10), F.floor(F.sqrt(n)).cast("int"))
    return F.least(F.lit(50), F.greatest(F.lit(15), F.floor(n / 10).cast("int")))


def scientific(value: Column, error: Column) -> Column:
    return F.format_string("%.2e ± %.2e", value, error)


def fixed(value: Column, digits: int = 6) -> Column:
    """value with that many decimals as C's printf writes it: by its exact binary value, halves to the even digit.

    Java rounds the shortest decimal of a double, and halves up. The fraction times a power of ten is a product whose
    rounding error is known exactly (Dekker's two factors); it matters only where the rounded product ends in one half.
    """
    ten = 10.0**digits
    v = value.cast("double")
    whole = F.floor(F.abs(v))
    x = F.abs(v) - whole
    p = x * F.lit(ten)
    c = x * F.lit(134217729.0)
    high = c - (c - x)
    error = (high * F.lit(ten) - p) + (x - high) * F.lit(ten)
    n = F.rint(p)
    n = n + F.when((p - n == 0.5) & (error > 0), 1).when((p - n == -0.5) & (error < 0), -1).otherwise(0)
    whole, n = whole + F.when(n == ten, 1).otherwise(0), F.when(n == ten, 0.0).otherwise(n).cast("long")
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    usual = F.concat(sign, whole.cast("string"), F.lit("."), F.lpad(n.cast("string"), digits, "0"))
    return F.when(F.abs(v) < 2.0**62, usual).otherwise(F.format_string(f"%.{digits}f", v))
