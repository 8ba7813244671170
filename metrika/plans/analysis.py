"""Queries of the analysis operators over the driver's tables; the surrogates stand in for measurement tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators import inference as I
from ..operators import ranking as R
from ..operators import tables as T
from .registry import query, table

# --- dose response: lineitem by return flag, discount as dose, unit price as trait --------------------------------------

WELLS = "w AS (SELECT l_returnflag AS strain, l_discount AS dose, l_extendedprice / l_quantity AS v FROM lineitem)"


def wells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_returnflag").alias("strain"), F.col("l_discount").alias("dose"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))


def r(c, n: int = 6):
    return F.round(c, n)


@query(f"""WITH {WELLS}, c AS (SELECT strain, avg(v) AS m FROM w WHERE dose = 0 GROUP BY strain)
SELECT w.strain, dose, count(*) AS n, round(avg(v / m), 6) AS mean, round(stddev_samp(v / m), 6) AS sd FROM w JOIN c USING (strain) GROUP BY w.strain, dose""")
def a1_j8_ratio_to_control(s, d):
    x = T.ratio_to_control(wells(s, d), "strain", "dose", "v")
    return x.groupBy("strain", "dose").agg(F.count("*").alias("n"), r(F.avg("ratio")).alias("mean"), r(F.stddev_samp("ratio")).alias("sd"))


@query(f"WITH {WELLS} SELECT strain, dose, count(*) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS sd FROM w GROUP BY strain, dose")
def a1_dose_stats(s, d):
    return wells(s, d).groupBy("strain", "dose").agg(F.count("*").alias("n"), r(F.avg("v"), 3).alias("mean"), r(F.stddev_samp("v"), 3).alias("sd"))


@query(f"""WITH {WELLS}, c AS (SELECT strain, avg(v) AS m FROM w WHERE dose = 0 GROUP BY strain)
SELECT w.strain, round(avg(v / m), 6) AS mean, round(stddev_samp(v / m), 6) AS sd FROM w JOIN c USING (strain) WHERE dose <> 0 GROUP BY w.strain""")
def a2_normalized_nonzero(s, d):
    x = T.ratio_to_control(wells(s, d), "strain", "dose", "v").filter("dose <> 0")
    return x.groupBy("strain").agg(r(F.avg("ratio")).alias("mean"), r(F.stddev_samp("ratio")).alias("sd"))


@query("SELECT l_returnflag AS strain, l_linestatus AS tool, count(l_tax) AS n FROM lineitem GROUP BY ALL")
def a3_count_by_tool(s, d):
    return table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("strain"), F.col("l_linestatus").alias("tool")).agg(F.count("l_tax").alias("n"))


@query(f"WITH {WELLS} SELECT coalesce(strain, 'all') AS strain, round(avg(v), 3) AS control FROM w WHERE dose = 0 GROUP BY ROLLUP (strain)")
def a4_control_means(s, d):
    return T.grouped(wells(s, d).filter("dose = 0"), "strain", [r(F.avg("v"), 3).alias("control")], "all")


@query(f"WITH {WELLS} SELECT strain, count(*) FILTER (dose = 0) AS d0, count(*) FILTER (dose = 0.05) AS d5, count(*) FILTER (dose = 0.1) AS d10 FROM w GROUP BY strain")
def a21_sample_size_pivot(s, d):
    n = wells(s, d).filter(F.col("dose").isin(0.0, 0.05, 0.1)).groupBy("strain", "dose").agg(F.count("*").alias("n"))
    p = n.groupBy("strain").pivot("dose", [0.0, 0.05, 0.1]).agg(F.first("n"))
    return p.toDF("strain", "d0", "d5", "d10").fillna(0)


@query(f"WITH {WELLS} SELECT round(min(v) - 0.05 * (max(v) - min(v)), 4) AS lo, round(max(v) + 0.05 * (max(v) - min(v)), 4) AS hi FROM w")
def a22_axis_limits(s, d):
    lo, hi = F.min("v"), F.max("v")
    return wells(s, d).agg(r(lo - 0.05 * (hi - lo), 4).alias("lo"), r(hi + 0.05 * (hi - lo), 4).alias("hi"))


@query(f"""WITH {WELLS}, m AS (SELECT min(dose) AS p FROM w WHERE dose > 0)
SELECT DISTINCT dose, round(CASE WHEN dose > 0 THEN log10(dose * 1000.0) ELSE log10(p * 1000.0) - 1 END, 6) AS x FROM w, m""")
def p35_dose_axis(s, d):
    x = wells(s, d).select("dose").distinct()
    least = x.filter("dose > 0").agg(F.min("dose").alias("p"))
    return x.join(least).select("dose", r(M.dose_axis(F.col("dose"), F.col("p"))).alias("x"))


@query(f"WITH {WELLS} SELECT CASE WHEN strain = 'N' THEN 'wild type' ELSE strain END AS strain, dose = 0 AS control, count(*) AS n FROM w GROUP BY ALL")
def f13_p32_alias_and_control(s, d):
    x = wells(s, d).withColumn("strain", F.when(F.col("strain") == "N", "wild type").otherwise(F.col("strain")))
    return x.groupBy("strain", (F.col("dose") == 0).alias("control")).agg(F.count("*").alias("n"))


@query()
def a18_a19_dose_response_fit(s, d):
    x = T.ratio_to_control(wells(s, d), "strain", "dose", "v")
    return I.dose_response(x, "strain", "dose", "ratio", 0.0798810489)


@query()
def a20_ec_comparison(s, d):
    x = T.ratio_to_control(wells(s, d), "strain", "dose", "v")
    one = I.dose_response(x, "strain", "dose", "ratio", 0.0798810489).select(F.lit("ratio").alias("dataset"), "strain", "EC50", "EC50_se")
    two = I.dose_response(wells(s, d), "strain", "dose", "v", 600.0).select(F.lit("absolute").alias("dataset"), "strain", "EC50", "EC50_se")
    return I.ec_comparison(one.union(two))


# --- two methods against a truth: lineitem prices by part type ----------------------------------------------------------

FIRST = """li AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) = 1)"""
METHODS = FIRST + """, m AS (SELECT l_orderkey || '-' || l_linenumber AS file, p_type AS category, l_extendedprice AS gt, l_extendedprice * (1 - l_discount) AS a,
  CASE WHEN l_linenumber <= 5 THEN l_extendedprice * (1 + l_tax) END AS b, l_quantity AS width, l_quantity * (1 - l_discount) AS width_a, l_linestatus AS warn
  FROM li JOIN part ON l_partkey = p_partkey)"""
ERRORS = METHODS + ", e AS (SELECT *, 100.0 * (a - gt) / nullif(gt, 0) AS pa, 100.0 * (b - gt) / nullif(gt, 0) AS pb FROM m)"
MERGE = "map(src, parent) AS (VALUES ('ECONOMY', 'low'), ('STANDARD', 'low'), ('PROMO', 'high'))"
MERGED = [("ECONOMY", "low"), ("STANDARD", "low"), ("PROMO", "high")]


def first_lines(s, d) -> DataFrame:
    return T.keep_first(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"])


def methods(s, d) -> DataFrame:
    x = first_lines(s, d).join(table(s, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    gt = F.col("l_extendedprice")
    return x.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("file"), F.col("p_type").alias("category"), gt.alias("gt"), (gt * (1 - F.col("l_discount"))).alias("a"),
        F.when(F.col("l_linenumber") <= 5, gt * (1 + F.col("l_tax"))).alias("b"), F.col("l_quantity").alias("width"), (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("width_a"), F.col("l_linestatus").alias("warn"),
    )


def errors(s, d) -> DataFrame:
    return methods(s, d).withColumns({"pa": M.percent_difference(F.col("a"), F.col("gt")), "pb": M.percent_difference(F.col("b"), F.col("gt"))})


def axes(s) -> DataFrame:
    return s.createDataFrame([("size", "ECONOMY", "small"), ("size", "STANDARD", "small"), ("size", "LARGE", "big"), ("offer", "PROMO", "promoted"), ("offer", "ECONOMY", "plain")], "axis string, src string, parent string")


AXES = "axes(axis, src, parent) AS (VALUES ('size', 'ECONOMY', 'small'), ('size', 'STANDARD', 'small'), ('size', 'LARGE', 'big'), ('offer', 'PROMO', 'promoted'), ('offer', 'ECONOMY', 'plain'))"


@query(f"WITH {FIRST} SELECT l_orderkey, l_linenumber, l_partkey FROM li")
def w5_keep_first(s, d):
    return first_lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT o_orderkey, c_name, n_name, o_totalprice - c_acctbal AS diff, abs(o_totalprice - c_acctbal) AS abs_diff FROM orders
LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def j1_j2_p24_attach_measurements(s, d):
    x = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nat"))
    x = T.attach(x, c, "o_custkey", "c_custkey", ["name", "bal", "nat"], "_r")
    x = T.attach(x, table(s, d, "nation"), "nat_r", "n_nationkey", ["n_name"], "")
    diff = M.signed_difference(F.col("o_totalprice"), F.col("bal_r"))
    return x.select("o_orderkey", F.col("name_r").alias("c_name"), "n_name", diff.alias("diff"), F.abs(diff).alias("abs_diff"))


@query(f"""WITH {ERRORS} SELECT category, count(*) AS n, round(avg(pa), 6) AS mean_a, round(avg(pb), 6) AS mean_b FROM e WHERE b IS NOT NULL GROUP BY category""")
def j3_common_objects(s, d):
    e = errors(s, d)
    a, b = e.select("file", "category", "pa"), e.filter("b is not null").select("file", "category", "pb")
    x, y = T.common(a, b, ["category", "file"])
    n = x.groupBy("category").agg(F.count("*").alias("n"), r(F.avg("pa")).alias("mean_a"))
    return n.join(y.groupBy("category").agg(r(F.avg("pb")).alias("mean_b")), "category")


@query(f"WITH {ERRORS} SELECT category, count(*) AS n, round(avg(pa), 6) AS a, round(avg(pb), 6) AS b, round(avg(width), 6) AS w FROM e WHERE pa IS NOT NULL AND pb IS NOT NULL GROUP BY category")
def j4_three_way(s, d):
    e = errors(s, d)
    k = e.select("file", "category", "width").join(e.select("file", "pa"), "file").join(e.select("file", "pb"), "file").dropna()
    return k.groupBy("category").agg(F.count("*").alias("n"), r(F.avg("pa")).alias("a"), r(F.avg("pb")).alias("b"), r(F.avg("width")).alias("w"))


@query("SELECT g.vec_id, g.label AS label_gt, p.label AS label_pred FROM embeddings g JOIN embeddings p ON p.vec_id = g.vec_id + 1")
def j5_truth_against_prediction(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label")
    p = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("label_pred"))
    return e.withColumnRenamed("label", "label_gt").join(p, "vec_id")


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 97 = 0 THEN 9 ELSE l.quality END AS quality,
CASE WHEN l.doc_id IS NULL AND d.doc_id % 97 <> 0 THEN 'unmatched' WHEN l.quality IS NULL AND d.doc_id % 97 <> 0 THEN 'incomplete' ELSE 'matched' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def j6_lookup_with_status(s, d):
    docs, lab = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select("doc_id", "quality")
    over = docs.filter("doc_id % 97 = 0").select(F.col("doc_id").alias("doc"), F.lit(9).alias("quality"))
    lab = T.unique_or_error(lab, ["doc_id"], "labels").select(F.col("doc_id").alias("doc"), "quality")
    return T.with_indicator(docs.withColumnRenamed("doc_id", "doc"), lab, "doc", ["quality"], over).withColumnRenamed("doc", "doc_id")


@query("""WITH t AS (SELECT c_mktsegment AS seg, max_by(c_custkey, c_custkey) AS last FROM customer GROUP BY 1) SELECT c_custkey, last FROM customer JOIN t ON seg = c_mktsegment""")
def j7_last_key_wins(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    last = T.keep_first(c.select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("v")), ["seg"], ["v"], last=True)
    return T.lookup(c, "c_mktsegment", last, "seg", "v", "last").select("c_custkey", "last")


@query("SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def j9_known_or_error(s, d):
    x = T.lookup(table(s, d, "supplier"), "s_nationkey", table(s, d, "nation"), "n_nationkey", "n_name", "nation")
    return T.known_or_error(x, "nation", "nation").select("s_suppkey", "nation")


@query("""WITH n AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS k, n_nationkey FROM nation)
SELECT a.n_name, coalesce(x.n_nationkey, y.n_nationkey) AS key FROM nation a LEFT JOIN n x ON x.k = a.n_name LEFT JOIN n y ON lower(y.k) = lower(a.n_name)""")
def j10_two_stage_lookup(s, d):
    n = table(s, d, "nation")
    t = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("k"), "n_nationkey")
    return T.two_stage_lookup(n.select("n_name"), "n_name", t, "k", "n_nationkey", "key")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def j15_prefilter_by_keys(s, d):
    keys = table(s, d, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").join(keys, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query(f"WITH {METHODS} SELECT file, category FROM m WHERE warn = 'F'")
def j16_f6_warned_rows(s, d):
    m = methods(s, d)
    clean = m.filter(~M.warned(F.when(F.col("warn") == "F", F.lit("gap")).otherwise(""), F.lit(""), ignore_a=False))
    return m.join(clean.select("file", "category"), ["file", "category"], "left_anti").select("file", "category")


@query("SELECT c_custkey, s_nationkey AS new, c_nationkey AS old FROM customer JOIN supplier ON s_suppkey = c_custkey WHERE s_nationkey <> c_nationkey")
def j20_mismatches(s, d):
    a = table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("v"))
    return T.mismatches(a, table(s, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("v")), "c_custkey", "v")


@query("""WITH t AS (SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS first FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, first FROM customer LEFT JOIN t ON o_custkey = c_custkey""")
def j21_first_wins(s, d):
    t = T.keep_first(table(s, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    return T.lookup(table(s, d, "customer").select("c_custkey"), "c_custkey", t, "o_custkey", "o_orderkey", "first")


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j22_j19_group_join(s, d):
    n = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(s, d, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {METHODS}, c AS (SELECT * FROM m WHERE b IS NOT NULL), {MERGE} SELECT coalesce(parent, category) AS species, count(*) AS n FROM c LEFT JOIN map ON src = category GROUP BY 1""")
def j23_common_union_species(s, d):
    m = methods(s, d)
    parts = [T.common(m.filter(F.col("category") == c), m.filter(F.col("category") == c).filter("b is not null"), ["file"])[0] for c in ("ECONOMY", "STANDARD", "PROMO", "LARGE", "MEDIUM", "SMALL")]
    x = parts[0]
    for p in parts[1:]:
        x = x.union(p)
    return T.relabel(x, "category", s.createDataFrame(MERGED, "src string, parent string"), "species").groupBy("species").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice, c_acctbal AS mapped FROM orders LEFT JOIN customer ON c_custkey = o_orderkey % 1000")
def j24_by_row_index(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 1000).alias("i"))
    return T.lookup(o, "i", table(s, d, "customer"), "c_custkey", "c_acctbal", "mapped").drop("i")


STATS = "count({0}) AS n, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.5), 6) AS median, round(CASE WHEN count({0}) = 1 THEN 0.0 ELSE stddev_samp({0}) END, 6) AS sd, round(quantile_cont({0}, 0.25), 6) AS q25, round(quantile_cont({0}, 0.75), 6) AS q75"


def rounded(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


@query(f"WITH {ERRORS} SELECT coalesce(category, 'all') AS category, {STATS.format('pa')} FROM e GROUP BY ROLLUP (category)")
def a5_a6_box_stats_with_all(s, d):
    return rounded(T.box_stats(errors(s, d), "category", "pa", T.ALL), "mean", "median", "sd", "q25", "q75")


@query(f"""WITH {ERRORS} SELECT category, round(avg(gt - a), 3) AS mean, round(coalesce(stddev_samp(gt - a) / sqrt(count(*)), 0.0), 3) AS sem,
round(avg(pa), 6) AS mean_percent, round(coalesce(stddev_samp(pa) / sqrt(count(pa)), 0.0), 6) AS sem_percent FROM e GROUP BY category""")
def a7_a8_mean_and_sem(s, d):
    x = errors(s, d).withColumn("d", F.col("gt") - F.col("a"))
    return x.groupBy("category").agg(r(F.avg("d"), 3).alias("mean"), r(M.sem(F.col("d")), 3).alias("sem"), r(F.avg("pa")).alias("mean_percent"), r(M.sem(F.col("pa"))).alias("sem_percent"))


@query(f"WITH {ERRORS}, {MERGE} SELECT coalesce(parent, category) AS category, {STATS.format('pa')} FROM e LEFT JOIN map ON src = category GROUP BY 1")
def a9_r1_merge_then_aggregate(s, d):
    x = T.relabel(errors(s, d), "category", s.createDataFrame(MERGED, "src string, parent string"))
    return rounded(T.box_stats(x, "category", "pa"), "mean", "median", "sd", "q25", "q75")


@query(f"""WITH {METHODS} SELECT coalesce(category, 'all') AS category, count(*) AS n_truth, count(b) AS n_found, round(100.0 * count(b) / count(*), 6) AS percent FROM m GROUP BY ROLLUP (category)""")
def a10_discoverability(s, d):
    x = methods(s, d).select("category", F.lit(1).alias("t"), F.col("b").isNotNull().cast("int").alias("f"))
    return rounded(T.share_found(x, "category", "t", "f"), "percent")


@query(f"""WITH {METHODS} SELECT coalesce(category, 'all') AS category, count(a) AS n_a, round(corr(gt, a), 8) AS r_a, round(corr(gt, a) ** 2, 8) AS r2_a, count(b) AS n_b,
round(corr(gt, b), 8) AS r_b, round(corr(gt, b) ** 2, 8) AS r2_b, round(corr(gt, a) - corr(gt, b), 8) AS delta FROM m GROUP BY ROLLUP (category)""")
def a11_a12_a42_correlations(s, d):
    x = T.correlations(methods(s, d), "category", {"a": ("gt", "a"), "b": ("gt", "b")}).withColumn("delta", F.col("r_a") - F.col("r_b"))
    return rounded(x, "r_a", "r_b", "r2_a", "r2_b", "delta", n=8)


@query(f"""WITH {ERRORS}, {AXES} SELECT axis, parent, count(*) AS n, round(corr(gt, a), 8) AS r_a, round(corr(gt, b), 8) AS r_b FROM e JOIN axes ON src = category WHERE b IS NOT NULL GROUP BY axis, parent""")
def a47_r4_axis_groups(s, d):
    x = T.on_axes(errors(s, d).filter("b is not null"), "category", axes(s))
    out = x.groupBy("axis", "parent").agg(F.count("*").alias("n"), M.correlation(F.col("gt"), F.col("a")).alias("r_a"), M.correlation(F.col("gt"), F.col("b")).alias("r_b"))
    return rounded(out, "r_a", "r_b", n=8)


@query(f"""WITH {ERRORS}, c AS (SELECT * FROM e WHERE b IS NOT NULL), {MERGE} SELECT coalesce(parent, category) AS category, round(avg(pa), 6) AS a, round(avg(pb), 6) AS b, count(*) AS n FROM c LEFT JOIN map ON src = category GROUP BY 1""")
def r2_merge_after_intersect(s, d):
    e = errors(s, d)
    x, _ = T.common(e, e.filter("b is not null"), ["category", "file"])
    x = T.relabel(x, "category", s.createDataFrame(MERGED, "src string, parent string"))
    return x.groupBy("category").agg(r(F.avg("pa")).alias("a"), r(F.avg("pb")).alias("b"), F.count("*").alias("n"))


@query(f"""WITH {METHODS}, p(src, parent, priority) AS (VALUES ('PROMO', 'x', 2), ('PROMO', 'y', 1), ('LARGE', 'x', 1)),
f AS (SELECT src, arg_min(parent, priority) AS parent FROM p GROUP BY src) SELECT parent AS bucket, count(*) AS n FROM m JOIN f ON src = category GROUP BY 1""")
def r3_priority_buckets(s, d):
    p = s.createDataFrame([("PROMO", "x", 2), ("PROMO", "y", 1), ("LARGE", "x", 1)], "src string, parent string, priority int")
    return T.bucket(methods(s, d), "category", p).groupBy("bucket").agg(F.count("*").alias("n"))


@query(f"""WITH {ERRORS} SELECT category, round(avg(a - gt), 3) AS len_diff, round(avg(pa), 6) AS len_percent, round(avg(width_a - width), 6) AS wid_diff, round(avg(100.0 * (width_a - width) / width), 6) AS wid_percent FROM e GROUP BY category""")
def a43_unified_summary(s, d):
    x = errors(s, d)
    return x.groupBy("category").agg(r(F.avg(F.col("a") - F.col("gt")), 3).alias("len_diff"), r(F.avg("pa")).alias("len_percent"), r(F.avg(F.col("width_a") - F.col("width"))).alias("wid_diff"), r(F.avg(M.percent_difference(F.col("width_a"), F.col("width")))).alias("wid_percent"))


@query(f"""WITH {ERRORS}, u AS (SELECT category, k, metric, v FROM (SELECT category, unnest(CASE WHEN warn = 'F' THEN ['unfiltered', 'warned'] ELSE ['unfiltered', 'filtered'] END) AS k, pa, pb FROM e)
UNPIVOT (v FOR metric IN (pa, pb))) SELECT k, metric, coalesce(category, 'all') AS category, {STATS.format('v')} FROM u GROUP BY GROUPING SETS ((k, metric, category), (k, metric))""")
def a45_warning_effect(s, d):
    e = errors(s, d)
    kinds = F.when(F.col("warn") == "F", F.array(F.lit("unfiltered"), F.lit("warned"))).otherwise(F.array(F.lit("unfiltered"), F.lit("filtered")))
    u = e.select("category", F.explode(kinds).alias("k"), "pa", "pb").unpivot(["category", "k"], ["pa", "pb"], "metric", "v").filter("v is not null")
    return rounded(T.box_stats(u, ["k", "metric", "category"], "v", T.ALL), "mean", "median", "sd", "q25", "q75")


@query(f"WITH {ERRORS} SELECT category, {STATS.format('x')} FROM (SELECT category, 100.0 * (width_a - width) / width AS x FROM e WHERE b IS NOT NULL) GROUP BY category")
def a46_width_common_only(s, d):
    e = errors(s, d).filter("b is not null").withColumn("x", M.percent_difference(F.col("width_a"), F.col("width")))
    return rounded(T.box_stats(e, "category", "x"), "mean", "median", "sd", "q25", "q75")


@query(f"WITH {METHODS} SELECT category, file, round(gt, 4) AS gt, round(coalesce(b, a, gt), 4) AS computed FROM m")
def a48_p26_length_pairs(s, d):
    return methods(s, d).select("category", "file", r("gt", 4).alias("gt"), r(F.coalesce("b", "a", "gt"), 4).alias("computed"))


@query(f"""WITH {ERRORS}, {MERGE} SELECT parent AS species, {STATS.format('pa')}, (SELECT round(min(pa), 6) FROM e) AS lo, (SELECT round(max(pa), 6) FROM e) AS hi FROM e JOIN map ON src = category GROUP BY 1""")
def a49_species_groups(s, d):
    e = errors(s, d)
    ends = e.agg(r(F.min("pa")).alias("lo"), r(F.max("pa")).alias("hi"))
    x = e.join(s.createDataFrame(MERGED, "src string, parent string"), F.col("src") == F.col("category"))
    return rounded(T.box_stats(x.withColumn("species", F.col("parent")), "species", "pa"), "mean", "median", "sd", "q25", "q75").join(ends)


@query("SELECT p_type AS category, count(*) AS n FROM part WHERE p_size = 1 AND p_retailprice > 1500 GROUP BY 1 HAVING count(*) < 20")
def f18_low_n(s, d):
    return table(s, d, "part").filter("p_size = 1 and p_retailprice > 1500").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).filter("n < 20")


@query(f"""WITH {ERRORS}, {AXES} SELECT axis, parent, count(*) AS n FROM e JOIN axes ON src = category WHERE parent NOT IN ('plain', 'small') GROUP BY ALL""")
def f15_without_baseline(s, d):
    return T.on_axes(errors(s, d), "category", axes(s)).filter(~F.col("parent").isin("plain", "small")).groupBy("axis", "parent").agg(F.count("*").alias("n"))


@query(f"""WITH {ERRORS}, u AS (SELECT 'a' AS method, file, pa AS v FROM e UNION ALL SELECT 'b', file, pb FROM e WHERE pb IS NOT NULL)
SELECT method, file, round(v, 6) AS v, CAST(row_number() OVER (PARTITION BY method ORDER BY abs(round(v, 6)) DESC, file) AS INTEGER) AS rank FROM u QUALIFY rank <= 15""")
def w9_top_errors(s, d):
    e = errors(s, d)
    u = e.select(F.lit("a").alias("method"), "file", F.round("pa", 6).alias("v")).union(e.filter("pb is not null").select(F.lit("b"), "file", F.round("pb", 6)))
    return T.top(u, "method", "v", "file", 15)


@query(f"""WITH {METHODS}, c AS (SELECT category, round(corr(gt, a) - corr(gt, b), 8) AS delta FROM m GROUP BY category) SELECT category, delta, CAST(row_number() OVER (ORDER BY delta DESC, category) AS INTEGER) AS rank FROM c""")
def w11_rank_by_delta(s, d):
    x = T.correlations(methods(s, d), "category", {"a": ("gt", "a"), "b": ("gt", "b")}, None).select("category", F.round(F.col("r_a") - F.col("r_b"), 8).alias("delta"))
    return x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta"), "category")))


@query("""WITH c AS (SELECT DISTINCT p_type AS category FROM part UNION ALL SELECT 'all') SELECT category, CAST(row_number() OVER (ORDER BY CASE category WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'all' THEN 99 ELSE 50 END, category) AS INTEGER) AS pos FROM c""")
def w13_w18_display_order(s, d):
    c = table(s, d, "part").select(F.col("p_type").alias("category")).distinct().union(s.createDataFrame([("all",)], "category string"))
    key = F.when(F.col("category") == "PROMO", 0).when(F.col("category") == "LARGE", 1).when(F.col("category") == "all", 99).otherwise(50)
    return c.withColumn("pos", F.row_number().over(Window.orderBy(key, "category")))


# --- tests ------------------------------------------------------------------------------------------------------------

GROUPS = "g AS (SELECT event_type, value FROM events)"


def all_groups(s, d) -> DataFrame:
    return table(s, d, "events").select("event_type", "value")


@query(f"""WITH {GROUPS}, m AS (SELECT event_type, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM g GROUP BY 1), t AS (SELECT avg(value) AS grand FROM g)
SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, round((sum(n * (mean - grand) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f FROM m, t""")
def a13_anova(s, d):
    return I.anova(all_groups(s, d), "event_type", "value").select("k", "n", r("f").alias("f"))


@query()
def a13_anova_p(s, d):
    return I.anova(all_groups(s, d), "event_type", "value")


@query()
def a14_tukey(s, d):
    return I.tukey(all_groups(s, d), "event_type", "value")


def first_two(s, d) -> DataFrame:
    """Events of the first two types by name, as groups 1 and 2."""
    e = table(s, d, "events").select("event_type", "value")
    types = e.select("event_type").distinct().orderBy("event_type").limit(2)
    types = types.select(F.col("event_type").alias("t"), F.row_number().over(Window.orderBy("event_type")).cast("string").alias("group"))
    return e.join(types, F.col("event_type") == F.col("t")).select("group", "value")


@query("""WITH t AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2), g AS (SELECT event_type, value FROM events WHERE event_type IN (SELECT * FROM t)),
k AS (SELECT event_type, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM g), a AS (SELECT min(event_type) AS e FROM t)
SELECT count(*) FILTER (event_type = e) AS n1, count(*) FILTER (event_type <> e) AS n2, round(sum(rk) FILTER (event_type = e) - count(*) FILTER (event_type = e) * (count(*) FILTER (event_type = e) + 1) / 2, 1) AS u1 FROM k, a""")
def a15_rank_sum(s, d):
    return I.rank_sum(first_two(s, d), "group", "value", "1", "2").select("n1", "n2", r("u1", 1).alias("u1"))


@query()
def a15_p33_rank_sum_stars(s, d):
    return I.rank_sum(first_two(s, d), "group", "value", "1", "2").withColumn("mark", M.stars(F.col("p")))


@query("""WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) / count(*) AS v FROM lineitem GROUP BY 1)
SELECT a.n AS n1, b.n AS n2, round((a.m - b.m) / sqrt(a.v + b.v), 6) AS t, round((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 / (b.n - 1)), 3) AS df FROM m a, m b WHERE a.g = 'A' AND b.g = 'R'""")
def a16_welch(s, d):
    return I.welch(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice", "A", "R").select("n1", "n2", r("t").alias("t"), r("df", 3).alias("df"))


@query("""SELECT l_returnflag AS g, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity) ** 2, 8) AS r2,
round(avg(l_extendedprice - l_quantity), 3) AS bias, round(avg(abs(l_extendedprice - l_quantity)), 3) AS mae, round(min(l_extendedprice - l_quantity), 3) AS min_error, round(max(l_extendedprice - l_quantity), 3) AS max_error,
round(quantile_cont(l_extendedprice - l_quantity, 0.5), 3) AS median_error FROM lineitem GROUP BY 1""")
def a17_regression(s, d):
    out = I.regression(table(s, d, "lineitem").withColumnRenamed("l_returnflag", "g"), "g", "l_quantity", "l_extendedprice")
    return rounded(rounded(rounded(out, "slope", n=4), "r2", n=8), "intercept", "bias", "mae", "min_error", "max_error", "median_error", n=3)


@query("""SELECT event_id, CASE WHEN value / 4000 < 0.0001 THEN '****' WHEN value / 4000 < 0.001 THEN '***' WHEN value / 4000 < 0.01 THEN '**' WHEN value / 4000 < 0.05 THEN '*' ELSE 'ns' END AS mark FROM events""")
def p33_stars(s, d):
    return table(s, d, "events").select("event_id", M.stars(F.col("value") / 4000).alias("mark"))


@query(f"""WITH {GROUPS}, m AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM g GROUP BY 1), p AS (SELECT sum((n - 1) * v) / sum(n - 1) AS mse FROM m)
SELECT a.event_type AS a, b.event_type AS b, round(a.m - b.m, 6) AS diff, round(abs(a.m - b.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)), 6) AS q FROM m a JOIN m b ON a.event_type < b.event_type, p""")
def a14_tukey_statistic(s, d):
    return rounded(I.tukey(all_groups(s, d), "event_type", "value").select("a", "b", "diff", "q"), "diff", "q")


# --- timing -------------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events), b AS (SELECT ntile(20) OVER (ORDER BY event_id) AS batch, value FROM o WHERE rn > 5), x AS (SELECT batch, count(*) AS n, sum(value) AS t FROM b GROUP BY 1)
SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS items, round(avg(t), 4) AS mean, round(stddev_samp(t), 4) AS sd, round(min(t), 3) AS min, round(max(t), 3) AS max, round(quantile_cont(t, 0.5), 3) AS median, round(sum(n) / sum(t), 6) AS per_second, round(sum(t) / sum(n), 6) AS per_item FROM x""")
def a31_w3_w4_speed_summary(s, d):
    out = T.speed_summary(table(s, d, "events"), "event_id", "value", 20, 5)
    return rounded(rounded(rounded(out, "mean", "sd", n=4), "min", "max", "median", n=3), "per_second", "per_item")


@query("""WITH x AS (SELECT user_id, event_type AS module, sum(value) AS t FROM events WHERE event_type NOT IN ('click') GROUP BY 1, 2) SELECT module, count(*) AS items, round(avg(t), 4) AS mean_s FROM x GROUP BY 1""")
def a32_f14_module_times(s, d):
    return rounded(T.module_times(table(s, d, "events").withColumnRenamed("event_type", "module"), "user_id", "module", "value", ("click",)), "mean_s", n=4)


@query("SELECT date_diff('second', min(ts) FILTER (event_type = (SELECT min(event_type) FROM events)), max(ts) FILTER (event_type = (SELECT max(event_type) FROM events))) AS seconds FROM (SELECT date_trunc('second', ts) AS ts, event_type FROM events)")
def a33_wall_clock(s, d):
    from ..sources.files import wall_clock

    e = table(s, d, "events")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    kind = F.when(F.col("event_type") == F.col("a"), "<start>").when(F.col("event_type") == F.col("b"), "<end>").otherwise("<other>")
    lines = e.join(ends).select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), kind).alias("value"))
    return wall_clock(lines, "<start>", "<end>")


@query("SELECT user_id, CAST(ntile(3) OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS batch, event_id FROM events")
def w3_batches(s, d):
    return T.batches(table(s, d, "events").select("user_id", "event_id"), "event_id", 3, per="user_id")


@query("""WITH f AS (SELECT user_id, event_id, value > 50 AS hi FROM events), c AS (SELECT *, CASE WHEN hi <> lag(hi) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS c FROM f),
k AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run FROM c) SELECT user_id, run, hi, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM k GROUP BY user_id, run, hi""")
def w6_run_lengths(s, d):
    return T.islands(table(s, d, "events").select("user_id", "event_id", (F.col("value") > 50).alias("hi")), ["user_id"], "event_id", "hi")


# --- counting and lists -------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def a30_value_counts(s, d):
    x = table(s, d, "documents").select("doc_id", "lang").join(table(s, d, "labels"), "doc_id", "left")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders")
def a35_f17_status_counts(s, d):
    x = F.col("o_orderstatus")
    return table(s, d, "orders").agg(F.count("*").alias("total"), F.count_if(x == "F").alias("done"), F.count_if(x == "O").alias("open"), F.count_if(~x.isin("F", "O")).alias("other"))


@query("SELECT regexp_extract(url, '([a-z]+)$', 1) AS ext, count(*) AS n FROM pages GROUP BY 1")
def a37_extension_histogram(s, d):
    return table(s, d, "pages").groupBy(F.regexp_extract("url", "([a-z]+)$", 1).alias("ext")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, greatest(10, CAST(floor(sqrt(count(value))) AS INTEGER)) AS k FROM events)
SELECT CAST(least(k - 1, floor((value - lo) / ((hi - lo) / k))) AS INTEGER) AS bin, count(*) AS n FROM events, e WHERE value IS NOT NULL GROUP BY 1""")
def a38_histogram(s, d):
    return T.histogram(table(s, d, "events"), "value").select("bin", "n")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS sd, round(max(value) - min(value), 6) AS range FROM events GROUP BY 1")
def a39_annotation(s, d):
    v, rows = F.col("value"), table(s, d, "events").select("event_type", "value")
    stats = rows.groupBy("event_type").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), (F.max(v) - F.min(v)).alias("range"))
    return rounded(R.with_quantiles(stats, rows, ["event_type"], "value", {"median": 0.5}), "mean", "median", "sd", "range")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a40_f16_unmatched_values(s, d):
    return table(s, d, "documents").select("doc_id").distinct().join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def f3_validation_members(s, d):
    return table(s, d, "documents").join(table(s, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents WHERE lang NOT IN ('fr', 'es') GROUP BY 1")
def f4_censored(s, d):
    gone = s.createDataFrame([("fr",), ("es",)], "lang string")
    return table(s, d, "documents").join(gone, "lang", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def f5_flagged_rows(s, d):
    flag = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" Yes ")).when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("None")).when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.lit(" 0"))
    other = F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("edge")).otherwise(F.lit("nan"))
    return table(s, d, "orders").filter(~M.flagged(flag, other)).select("o_orderkey")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount > 0 AND l_tax > 0 GROUP BY 1")
def f7_finite_pairs(s, d):
    a, b = (F.when(F.col(c) == 0, F.lit(float("nan"))).otherwise(F.col(c)) for c in ("l_discount", "l_tax"))
    x = table(s, d, "lineitem").select("l_returnflag", M.number(a).alias("a"), M.number(b).alias("b"))
    return x.filter("a is not null and b is not null").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10")
def f8_least_size(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 10")


# --- sets -----------------------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u1_union(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(s, d, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def u2_union_by_name(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    return T.union_by_name(a, table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def u3_intersect(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey"))


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def u4_u5_difference(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(s, d, "lineitem").select("l_orderkey"))


@query("SELECT DISTINCT url FROM pages")
def u6_distinct_files(s, d):
    p = table(s, d, "pages").select("url")
    return p.union(p).distinct()


@query("SELECT c_mktsegment AS strain FROM customer UNION SELECT l_returnflag FROM lineitem")
def u7_union_of_strains(s, d):
    return table(s, d, "customer").select(F.col("c_mktsegment").alias("strain")).union(table(s, d, "lineitem").select("l_returnflag")).distinct()
