"""Histograms, summaries and conditional statistics of the split members and saturation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.functions.scalar import float_bin, half_even, int_bin, level, number, reasons, threshold_key
from viewmill.operators.aggregates import (
    distinct_with_null,
    filled_histogram,
    five_numbers,
    long_form,
    sample_std,
    unpivot_bins,
)
from viewmill.session import table

A, B, C = "self_occlusion_attribute", "observation_saturation_view_num", "selected_view_count"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "split_members")
    return df.withColumns({A: number(F.col(A)), "area": number(F.col("area")), "volume": number(F.col("volume"))})


def float_bin_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = members(spark, sf_dir).select(float_bin(F.col(A), 0.05).alias("bin")).where("bin is not null")
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def int_bin_cond_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of A, B, C given the bin of each other one."""
    bins = {A: F.floor(F.col(A) / 0.125), B: int_bin(F.col(B), 16), C: int_bin(F.col(C), 8)}
    return unpivot_bins(members(spark, sf_dir), bins, [A, B, C])


def grouping_sets_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the binned C for all, by pool, by split and by both, zero-filled over the bins there are."""
    rows = members(spark, sf_dir).select("split_name", "pool_type", int_bin(F.col(C), 16).alias("bin")).where("bin is not null")
    sets = [[], [F.col("split_name")], [F.col("pool_type")], [F.col("split_name"), F.col("pool_type")]]
    per = rows.groupBy("split_name", "pool_type", "bin").count()
    with_bin = [[*s, F.col("bin")] for s in sets]
    keys = ["grp", "split", "pool", "bin"]
    counted = per.groupingSets(with_bin, "split_name", "pool_type", "bin").agg(
        F.sum("count").alias("n"), F.grouping_id("split_name", "pool_type", "bin").alias("gid")
    )
    named = counted.select(
        (F.col("gid") / 2).cast("int").alias("grp"), F.coalesce("split_name", F.lit("*")).alias("split"), F.coalesce("pool_type", F.lit("*")).alias("pool"), "bin", "n"
    )
    bins = rows.select(F.collect_set("bin").alias("bins"))  # a bounded set of bins
    domain = named.select("grp", "split", "pool").distinct().join(F.broadcast(bins)).select("grp", "split", "pool", F.explode("bins").alias("bin"))
    return filled_histogram(named, domain, keys).select(*keys, "n")


def five_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summaries of six measures for each split."""
    measures = [A, B, C, "gt_surface_voxel_count", "area", "volume"]
    out = five_numbers(long_form(members(spark, sf_dir), measures, ["split_name"]), ["split_name", "measure"])
    return out.select("split_name", "measure", "n", *(F.round(c, 6).alias(c) for c in ("mean", "min", "p25", "median", "p75", "max")))


def method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each batch: means, sample deviations, objects, fit types with null as one, and the rate of fitted rows."""
    rows = table(spark, sf_dir, "saturation").withColumn("a", number(F.col("a_fit")))
    return rows.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("a"), 6).alias("a_mean"),
        F.round(sample_std("a"), 6).alias("a_std"),
        F.min("a").alias("a_min"),
        F.max("a").alias("a_max"),
        distinct_with_null("fit_type").cast("long").alias("n_fit_types"),
        F.round(F.count("a") / F.count(F.lit(1)), 6).alias("fit_rate"),
        F.round(F.avg(F.when(F.col("a").isNotNull(), F.col("b_continuous"))), 6).alias("b_mean_fitted"),
    )


def fit_type_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name:count;...`` of the fit types of each batch, null last."""
    counts = table(spark, sf_dir, "saturation").groupBy("batch_id", "fit_type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col("fit_type").isNull().alias("last"), F.coalesce("fit_type", F.lit("null")).alias("name"), "n")
    ordered = F.array_sort(F.collect_list(entry))
    text = F.transform(ordered, lambda e: F.concat_ws(":", e["name"], e["n"].cast("string")))
    return counts.groupBy("batch_id").agg(F.array_join(text, ";").alias("fit_types"))


def pop_std_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation and mean gap between the fitted and the discrete A of each day."""
    rows = table(spark, sf_dir, "saturation").select("run_day", number(F.col("a_fit")).alias("a"), number(F.col("a_discrete")).alias("d"))
    gap = F.col("a") - F.col("d")
    ok = rows.where("a between 0 and 1 and d is not null")
    return ok.groupBy("run_day").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(gap), 9).alias("bias"), F.round(F.stddev_pop(gap), 9).alias("std"), F.round(1 - F.avg("a"), 9).alias("coverage_gap")
    )


def two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics over objects of their summed step gains."""
    rows = table(spark, sf_dir, "method_steps").where("oracle_nbv_gain is not null")
    per = rows.groupBy("run_id").agg(F.sum("oracle_nbv_gain").alias("x"), F.count(F.lit(1)).alias("steps"))
    out = five_numbers(per.select(F.col("x").cast("double").alias("x"), F.lit("all").alias("what")), ["what"])
    return out.select("n", F.round("mean", 6).alias("mean"), "min", "median", "max")


def pool_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = level(F.col(B), [(128, "main"), (300, "long_tail")], "extreme").alias("pool")
    return members(spark, sf_dir).groupBy(pool, "pool_type").agg(F.count(F.lit(1)).alias("n"))


def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality flags of each member with a weighted sum, and the rounded ratio of C to B."""
    a, b, c, v = (F.col(x) for x in (A, B, C, "gt_surface_voxel_count"))
    rules = {"high_a": (a > 0.9, 4), "low_a": (a < 0.2, 2), "large_b": (b > 300, 5), "tiny_b": (b < 6, 3), "large_c": (c > 100, 3), "few_voxels": (v < 1500, 2), "c_over_b": (c > b, 2)}
    score = sum(F.when(cond, weight).otherwise(0) for cond, weight in rules.values())
    bc = half_even(F.when(b > 0, c / b), 6)
    flags = reasons([(name, cond) for name, (cond, _) in rules.items()])
    return members(spark, sf_dir).select("member_id", F.array_join(flags, "|").alias("flags"), score.alias("score"), bc.alias("bc_ratio"))


def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = risk_flags(spark, sf_dir).select(F.explode(F.split("flags", r"\|")).alias("flag")).where("flag != ''")
    return flags.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the group totals of the histogram add up? One row for each grouping with its total and the row count."""
    hist = grouping_sets_hist(spark, sf_dir).groupBy("grp").agg(F.sum("n").alias("total"))
    rows = members(spark, sf_dir).agg(F.count(C).alias("n_rows"))
    return hist.join(F.broadcast(rows)).select("grp", "total", "n_rows", (F.col("total") == F.col("n_rows")).alias("ok"))


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of steps at or above coverage thresholds, keyed by the threshold's text."""
    cuts = F.array(*(F.lit(t) for t in (0.1, 0.25, 0.5, 0.75, 0.9, 0.975)))
    rows = table(spark, sf_dir, "method_steps").select(number(F.col("covered_ratio")).alias("r"), F.explode(cuts).alias("t"))
    return rows.where("r is not null").groupBy(threshold_key(F.col("t")).alias("threshold")).agg(F.round(F.avg((F.col("r") >= F.col("t")).cast("int")), 6).alias("share"))


QUERIES = {f.__name__: f for f in (
    float_bin_hist, int_bin_cond_stats, grouping_sets_hist, five_number, method_table, fit_type_lists, pop_std_bias,
    two_level, pool_split, risk_flags, flag_counts, integrity, thresholds,
)}

_N = "CASE WHEN isfinite({0}) THEN {0} END"
_M = f"WITH m AS (SELECT * REPLACE ({_N.format(A)} AS {A}, {_N.format('area')} AS area, {_N.format('volume')} AS volume) FROM split_members)"
_BINS = {A: f"floor({A} / 0.125)::BIGINT", B: f"(floor({B} / 16.0) * 16)::BIGINT", C: f"(floor({C} / 8.0) * 8)::BIGINT"}
_COND = " UNION ALL ".join(
    f"SELECT '{b}' AS binned, {e} AS bin, '{v}' AS value, {v}::DOUBLE AS x FROM m" for b, e in _BINS.items() for v in (A, B, C) if v != b
)
_HIST = _M + f""", r AS (SELECT split_name, pool_type, (floor({C} / 16.0) * 16)::INTEGER AS bin FROM m WHERE {C} IS NOT NULL),
g AS (
  SELECT 3 AS grp, '*' AS split, '*' AS pool, bin, count(*) AS n FROM r GROUP BY bin
  UNION ALL SELECT 1, split_name, '*', bin, count(*) FROM r GROUP BY split_name, bin
  UNION ALL SELECT 2, '*', pool_type, bin, count(*) FROM r GROUP BY pool_type, bin
  UNION ALL SELECT 0, split_name, pool_type, bin, count(*) FROM r GROUP BY split_name, pool_type, bin),
h AS (SELECT d.grp, d.split, d.pool, b.bin, coalesce(g.n, 0)::BIGINT AS n FROM (SELECT DISTINCT grp, split, pool FROM g) d
  CROSS JOIN (SELECT DISTINCT bin FROM r) b LEFT JOIN g ON g.grp = d.grp AND g.split = d.split AND g.pool = d.pool AND g.bin = b.bin)
"""
_FIVE = ", ".join(
    [f"round(avg(x), 6) AS mean", "round(min(x), 6) AS min"]
    + [f"round(quantile_cont(x, {q}), 6) AS {n}" for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    + ["round(max(x), 6) AS max"]
)
_RULES = [("high_a", f"{A} > 0.9", 4), ("low_a", f"{A} < 0.2", 2), ("large_b", f"{B} > 300", 5), ("tiny_b", f"{B} < 6", 3), ("large_c", f"{C} > 100", 3), ("few_voxels", "gt_surface_voxel_count < 1500", 2), ("c_over_b", f"{C} > {B}", 2)]
_RISK = _M + ", k AS (SELECT member_id, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c, _ in _RULES) + "], lambda x: x IS NOT NULL) AS f, " + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for _, c, w in _RULES) + f" AS score, round_even(CASE WHEN {B} > 0 THEN {C}::DOUBLE / {B} END, 6) AS bc_ratio FROM m)"

SQL = {
    "float_bin_hist": _M + f" SELECT round(round(({A} - {A} % 0.05::DOUBLE) / 0.05::DOUBLE) * 0.05::DOUBLE, 2) AS bin, count(*) AS n FROM m WHERE {A} IS NOT NULL GROUP BY 1",
    "int_bin_cond_stats": _M + f" SELECT binned, bin, value, count(*) AS n, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max FROM ({_COND}) WHERE bin IS NOT NULL AND x IS NOT NULL GROUP BY ALL",
    "grouping_sets_hist": _HIST + " SELECT * FROM h",
    "five_number": _M + " SELECT split_name, measure, count(x) AS n, " + _FIVE + " FROM (" + " UNION ALL ".join(f"SELECT split_name, '{c}' AS measure, {c}::DOUBLE AS x FROM m" for c in (A, B, C, "gt_surface_voxel_count", "area", "volume")) + ") GROUP BY ALL",
    "method_table": f"""SELECT batch_id, count(*) AS n, round(avg(a), 6) AS a_mean, round(CASE WHEN count(a) = 1 THEN 0.0::DOUBLE ELSE stddev_samp(a) END, 6) AS a_std, min(a) AS a_min, max(a) AS a_max,
count(DISTINCT fit_type) + max((fit_type IS NULL)::INTEGER) AS n_fit_types, round(count(a)::DOUBLE / count(*), 6) AS fit_rate, round(avg(CASE WHEN a IS NOT NULL THEN b_continuous END), 6) AS b_mean_fitted
FROM (SELECT *, {_N.format('a_fit')} AS a FROM saturation) GROUP BY batch_id""",
    "fit_type_lists": """SELECT batch_id, string_agg(coalesce(fit_type, 'null') || ':' || n, ';' ORDER BY fit_type IS NULL, fit_type) AS fit_types
FROM (SELECT batch_id, fit_type, count(*) AS n FROM saturation GROUP BY ALL) GROUP BY batch_id""",
    "pop_std_bias": f"""SELECT run_day, count(*) AS n, round(avg(a - d), 9) AS bias, round(stddev_pop(a - d), 9) AS std, round(1 - avg(a), 9) AS coverage_gap
FROM (SELECT run_day, {_N.format('a_fit')} AS a, {_N.format('a_discrete')} AS d FROM saturation) WHERE a BETWEEN 0 AND 1 AND d IS NOT NULL GROUP BY run_day""",
    "two_level": """SELECT count(*) AS n, round(avg(x), 6) AS mean, min(x)::DOUBLE AS min, median(x)::DOUBLE AS median, max(x)::DOUBLE AS max
FROM (SELECT run_id, sum(oracle_nbv_gain) AS x FROM method_steps WHERE oracle_nbv_gain IS NOT NULL GROUP BY run_id)""",
    "pool_split": _M + f" SELECT CASE WHEN {B} <= 128 THEN 'main' WHEN {B} <= 300 THEN 'long_tail' WHEN {B} IS NOT NULL THEN 'extreme' END AS pool, pool_type, count(*) AS n FROM m GROUP BY ALL",
    "risk_flags": _RISK + " SELECT member_id, array_to_string(f, '|') AS flags, score, bc_ratio FROM k",
    "flag_counts": _RISK + " SELECT flag, count(*) AS n FROM (SELECT unnest(f) AS flag FROM k) GROUP BY 1",
    "integrity": _HIST + f", t AS (SELECT count({C}) AS n_rows FROM m) SELECT grp, sum(n)::BIGINT AS total, any_value(n_rows) AS n_rows, sum(n) = any_value(n_rows) AS ok FROM h, t GROUP BY grp",
    "thresholds": f"""SELECT rtrim(rtrim(printf('%.3f', t), '0'), '.') AS threshold, round(avg((r >= t)::INTEGER), 6) AS share
FROM (SELECT {_N.format('covered_ratio')} AS r, unnest([0.1, 0.25, 0.5, 0.75, 0.9, 0.975]::DOUBLE[]) AS t FROM method_steps) WHERE r IS NOT NULL GROUP BY 1""",
}
