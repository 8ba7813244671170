"""Positions, ranks and quantiles at sizes where partitions are coalesced, against numpy."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrika.operators import curation as C
from metrika.operators import inference as I
from metrika.operators import ranking as R
from metrika.operators import tables as T

MIDDLE = "/root/testdata/sf0.1"


@pytest.fixture(params=[4, 16])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def in_order(df, key, at):
    """Each position once, and in the order of the key."""
    n = df.count()
    x = df.agg(F.count_distinct(at).alias("d"), F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    if (x.d, x.lo, x.hi) != (n, 1, n):
        return 0
    part = F.floor(F.col(at) / 1000)
    ends = df.groupBy(part.alias("p")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.sort_array(F.collect_list(F.struct(at, key))).alias("all")).orderBy("p").collect()
    keys = [r[key] for e in ends for r in e["all"]]
    assert all((a is None) or (b is not None and a <= b) for a, b in zip(keys, keys[1:], strict=False))
    return n


def test_positions_of_orders(spark, partitions):
    orders = spark.read.parquet(f"{MIDDLE}/orders.parquet")
    assert in_order(T.new_ids(orders, "o_orderkey", 0), "o_orderkey", "new_id") == 150_000
    plan = C.augmentation_plan(orders, "o_orderkey").groupBy("aug_type").count().collect()
    assert {r["aug_type"]: r["count"] for r in plan} == dict.fromkeys(("intensity", "noise", "rotation"), 50_000)


def test_positions_of_lineitem_by_a_column_with_ties(spark, partitions):
    lines = spark.read.parquet(f"{MIDDLE}/lineitem.parquet").select("l_extendedprice", "l_shipdate", "l_orderkey")
    n = lines.count()
    assert in_order(R.numbered(lines, "l_shipdate", "at"), "l_shipdate", "at") == n


def test_positions_of_a_million_wide_rows_with_a_hot_value_and_nulls(spark, partitions):
    k = F.when(F.col("id") % 3 == 0, F.lit("8hot")).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.sha2(F.col("id").cast("string"), 256))
    df = spark.range(1_000_000).select(k.alias("k"), F.repeat(F.col("id").cast("string"), 10).alias("wide"))
    out = R.numbered(df, "k", "at", "n")
    assert out.columns == ["k", "wide", "at", "n"]
    got = out.groupBy(F.when(F.col("k").isNull(), "null").when(F.col("k") == "8hot", "hot").otherwise("rest").alias("g")).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.count_distinct("at").alias("d"), F.min("n").alias("all")).collect()
    got = {r.g: r for r in got}
    nulls, hot = sum(1 for i in range(1_000_000) if i % 3 and i % 100 == 1), 333_334
    assert (got["null"].lo, got["null"].hi, got["null"].d) == (1, nulls, nulls)
    assert got["hot"].d == got["hot"].n == hot and got["hot"].hi - got["hot"].lo == hot - 1
    assert out.select("at").distinct().count() == 1_000_000 and got["rest"].all == 1_000_000 and got["rest"].hi == 1_000_000
    parts = df.withColumns(dict(zip(("p", "s"), R.ranges(df, "k"), strict=True))).groupBy("p", "s").count().collect()
    assert max(r["count"] for r in parts if not r["s"]) < 12_000 and {r["count"] for r in parts if r["s"]} == {nulls, hot}


def test_positions_of_doubles_dates_and_few_rows(spark):
    r = np.random.default_rng(2)
    x = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, *r.normal(size=500).tolist(), *[1.5] * 300]
    df = spark.createDataFrame([(v, k) for k, v in enumerate(x)], "v double, k int")
    got = [tuple(t) for t in R.numbered(df, "v", "at").orderBy("at").select("v", "at").collect()]
    want = [t[0] for t in df.orderBy("v").select("v").collect()]
    assert [str(a) for a, _ in got if a != 0] == [str(w) for w in want if w != 0] and [b for _, b in got] == list(range(1, len(x) + 1))
    days = spark.range(2000).select((F.lit("2024-01-01").cast("date") + F.pmod(F.xxhash64("id"), F.lit(300)).cast("int")).alias("d"))
    assert in_order(R.numbered(days, "d", "at"), "d", "at") == 2000
    assert R.numbered(df.limit(0), "v", "at").count() == 0
    assert R.numbered(df.filter("v is null"), "v", "at", "n").collect() == [(None, 0, 1, 1)]


@pytest.mark.parametrize("n, k, warm", [(100, 7, 0), (100, 7, 5), (5, 9, 0), (1, 1, 0), (1000, 3, 1)])
def test_batches_are_those_of_ntile(spark, n, k, warm):
    from pyspark.sql import Window

    df = spark.range(n).select(((F.col("id") * 37) % 1009).alias("o"))
    rest = T.after_first(df, "o", warm)
    want = sorted(tuple(r) for r in df.withColumn("rn", F.row_number().over(Window.orderBy("o"))).filter(F.col("rn") > warm).select("o", F.ntile(k).over(Window.orderBy("o"))).collect())
    assert sorted(tuple(r) for r in T.batches(rest, "o", k).select("o", "batch").collect()) == want


def test_average_ranks_of_a_million(spark, partitions):
    r = np.random.default_rng(3)
    x = np.where(r.random(1_000_000) < 0.3, 7.0, np.round(r.normal(size=1_000_000), 4))
    df = spark.createDataFrame(__import__("pandas").DataFrame({"v": x}))
    got = R.average_ranks(df, "v").toPandas().sort_values("v")
    values, counts = np.unique(x, return_counts=True)
    last = np.cumsum(counts)
    assert np.array_equal(got["v"], values) and np.array_equal(got["ties"], counts) and np.allclose(got["rank"], last - (counts - 1) / 2)


def bits(x):
    (n,) = struct.unpack("<Q", struct.pack("<d", x))
    return -(n & (1 << 63) - 1) if n >> 63 else n


def test_ordered_bits_are_those_of_the_double(spark):
    r = np.random.default_rng(4)
    x = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf")]
    for e in range(-1074, 1024):
        p = 2.0**e
        x += [p, np.nextafter(p, 0), np.nextafter(p, np.inf), -p]
    x += struct.unpack("<20000d", r.bytes(160_000))
    x = [float(v) for v in x if v == v]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    got = df.select("v", R.ordered_bits(F.col("v")).alias("b")).collect()
    assert all(g.b == bits(v) for g, v in zip(got, x, strict=True))


def test_quantiles_against_numpy(spark, partitions):
    r = np.random.default_rng(5)
    groups = {"a": r.normal(size=40_000) * 1e3, "b": np.round(r.normal(size=30_000), 1), "one": [3.25], "two": [-1.0, 1.0], "equal": [2.5] * 1000, "wide": np.exp(r.normal(size=5000) * 100) * np.sign(r.normal(size=5000)), None: r.random(100)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {"lo": 0.0, "q": 0.137, "m": 0.5, "p99": 0.99, "hi": 1.0}
    got = {x["g"]: x for x in R.quantiles(R.shared(df), ["g"], "v", wanted).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        want = np.quantile(np.array(vs), list(wanted.values()))
        assert np.allclose([got[g][c] for c in wanted], want, rtol=1e-12, atol=1e-12), g
    [whole] = R.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert np.isclose(whole["m"], np.median(np.concatenate([np.array(v) for v in groups.values()])))
    assert R.quantiles(df.limit(0), ["g"], "v", wanted).count() == 0


def test_quantiles_hold_no_group(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    plan = T.box_stats(df, "g", "v")._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "collect_set" not in plan.lower()


def test_box_stats_with_total_and_several_keys(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "a", 3.0), ("x", "b", 10.0), ("y", "b", None)], "k string, c string, v double")
    got = {(r.k, r.c): tuple(r)[2:] for r in T.box_stats(df, ["k", "c"], "v", "all").collect()}
    assert got[("x", "a")][:3] == (2, 2.0, 2.0) and got[("x", "b")] == (1, 10.0, 10.0, 0.0, 10.0, 10.0) and got[("x", "all")][:3] == (3, 14 / 3, 3.0)
    assert got[("y", "b")] == got[("y", "all")] == (0, None, None, None, None, None)


def test_regression_has_its_median(spark):
    df = spark.createDataFrame([("g", float(i), 2.0 * i + 1) for i in range(11)], "g string, x double, y double")
    [row] = I.regression(df, "g", "x", "y").collect()
    assert (row.n, round(row.slope, 9), round(row.intercept, 9), row.median_error) == (11, 2.0, 1.0, 6.0)
