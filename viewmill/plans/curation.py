"""Filtering, robust scoring and stratification of the annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.functions.scalar import error_word, label, reasons, robust_z, shape_class, tertile
from viewmill.operators.aggregates import robust_stats
from viewmill.operators.filters import above, below_or_missing, canonical_ids, compile_rule, geometry_columns
from viewmill.session import clean_key, table

MEASURES = ["elongation", "planarity", "fill_ratio", "hull_ratio", "compactness", "log_faces"]


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with their measures and the names of all failed checks."""
    df = geometry_columns(table(spark, sf_dir, "annotations"))
    rules = [
        ("load_failed", ~F.coalesce("load_ok", F.lit(False))),
        ("has_error", F.col("error_word").isNotNull()),
        ("few_vertices", below_or_missing(F.col("vertex_count"), 50)),
        ("few_faces", below_or_missing(F.col("face_count"), 100)),
        ("many_faces", above(F.col("face_count"), 20000)),
        ("degenerate", above(F.nanvl("degenerate_face_ratio", F.lit(None)), 0.02)),
        ("no_volume", F.col("fill_ratio").isNull()),
        ("no_hull", F.col("hull_ratio").isNull()),
        ("flat_box", F.col("planarity").isNull() | F.col("elongation").isNull()),
        ("hull_below_volume", F.col("hull_ratio") > 1),
    ]
    return df.withColumn("failed", reasons(rules))


def passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).where(F.size("failed") == 0)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing rows with robust z scores and tertiles; the one row of statistics is broadcast."""
    rows = passing(spark, sf_dir)
    stats = F.broadcast(robust_stats(rows, MEASURES))
    with_stats = rows.join(stats)
    z = {f"rz_{m}": robust_z(F.col(m), F.col(f"med_{m}"), F.col(f"mad_{m}")) for m in MEASURES}
    out = with_stats.withColumns(z)
    flags = sum((F.coalesce(F.abs(f"rz_{m}"), F.lit(float("inf"))) > 6).cast("int") for m in MEASURES)
    return out.withColumns(
        {
            "n_flags": flags,
            "fill_tertile": tertile(F.col("fill_ratio"), F.col("q1_fill_ratio"), F.col("q2_fill_ratio"), F.col("n_fill_ratio")),
            "shape": shape_class(F.col("elongation"), F.col("planarity")),
        }
    )


def robust_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, outliers and mean score of each shape and fill stratum."""
    return scored(spark, sf_dir).groupBy("shape", "fill_tertile").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_flags") == 0).alias("n_kept"),
        F.count_if(F.col("n_flags") > 1).alias("n_multi_flag"),
        F.round(F.avg("rz_fill_ratio"), 6).alias("mean_rz_fill"),
    )


def hard_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("row_id", F.concat_ws(",", "failed").alias("failed"))


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checked(spark, sf_dir).select(F.explode("failed").alias("reason"), F.size("failed").alias("n"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n") == 1).alias("n_only_reason"))


def robust_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("row_id", *(F.round(f"rz_{m}", 6).alias(f"rz_{m}") for m in MEASURES), "n_flags")


def tertile_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("row_id", "fill_tertile", "shape")


def keep_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: rows in, after the checks, after the outlier filter, and the shares kept."""
    total = checked(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.size("failed") == 0).alias("n_pass"))
    kept = scored(spark, sf_dir).agg(F.count_if(F.col("n_flags") == 0).alias("n_stat"))
    share = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6)
    return total.join(F.broadcast(kept)).select("n_in", "n_pass", "n_stat", share("n_pass", "n_in").alias("pass_ratio"), share("n_stat", "n_pass").alias("stat_ratio"))


def error_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most common error messages."""
    rows = table(spark, sf_dir, "annotations").select(error_word(F.col("error")).alias("error")).where("error is not null")
    return rows.groupBy("error").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "error").limit(3)


def valid_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct objects in the known strata, by recorded category names."""
    shapes, fills = ("compact", "elongated", "bladed", "flat_or_sheet_like"), ("low", "mid", "high")
    rows = table(spark, sf_dir, "annotations").select(
        label(F.col("shape_type")).alias("shape"), label(F.col("fill_bucket")).alias("fill"), clean_key("uid").alias("uid")
    )
    known = rows.where(F.col("shape").isin(*shapes) & F.col("fill").isin(*fills) & F.col("uid").isNotNull())
    return known.groupBy("shape", "fill").agg(F.count_distinct("uid").alias("n_objects"), F.count(F.lit(1)).alias("n_rows"))


def rule_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that satisfy a nested and/or rule over their measurements."""
    rule = {
        "logic": "or",
        "rules": [
            {
                "logic": "and",
                "rules": [
                    {"field": "self_occlusion_attribute", "op": ">=", "value": 0.5},
                    {"field": "observation_saturation_view_num", "op": "<", "value": 64},
                    {"field": "selected_view_count", "op": "!=", "value": 20},
                ],
            },
            {"field": "gt_surface_voxel_count", "op": "<=", "value": 1500},
        ],
    }
    members = table(spark, sf_dir, "split_members")
    return members.where(compile_rule(rule)).groupBy("split_name").agg(F.count(F.lit(1)).alias("n"))


def clean_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists of each step in range, without views visited before, sorted and distinct."""
    steps = table(spark, sf_dir, "method_steps")
    ids = canonical_ids(F.col("candidate_view_ids"), F.col("visited_view_ids"), 128)
    return steps.select("row_id", F.size(ids).alias("n_left"), F.element_at(ids, 1).alias("first_left")).where("n_left > 0")


QUERIES = {
    "robust_strata": robust_strata,
    "hard_filter_reasons": hard_filter_reasons,
    "reason_counts": reason_counts,
    "robust_z": robust_z_scores,
    "tertile_bucket": tertile_bucket,
    "keep_ratio": keep_ratio,
    "error_topk": error_topk,
    "valid_strata": valid_strata,
    "rule_engine": rule_engine,
    "clean_candidates": clean_candidates,
}

_NUM = "CASE WHEN isfinite({0}) THEN {0} END"
_ERROR = "CASE WHEN lower(trim(error)) NOT IN ('', 'none', 'null', 'nan') THEN lower(trim(error)) END"
_BASE = f"""
WITH b AS (
  SELECT *, list_reverse_sort([{_NUM.format('x')} for x in bbox_extent]) AS e, {_NUM.format('volume')} AS v,
    {_NUM.format('convex_hull_volume')} AS h, {_NUM.format('area')} AS ar, {_ERROR} AS error_word FROM annotations),
m AS (
  SELECT *, CASE WHEN e[2] > 1e-12 THEN e[1] / e[2] END AS elongation, CASE WHEN e[3] > 1e-12 THEN e[2] / e[3] END AS planarity,
    CASE WHEN e[1] * e[2] * e[3] > 1e-12 THEN v / (e[1] * e[2] * e[3]) END AS fill_ratio, CASE WHEN h > 1e-12 THEN v / h END AS hull_ratio,
    CASE WHEN ar > 1e-12 AND v IS NOT NULL THEN pow(greatest(v, 0.0::DOUBLE), 2.0::DOUBLE / 3) / ar WHEN ar > 1e-12 THEN 0.0::DOUBLE END AS compactness,
    ln(1 + greatest(coalesce(face_count, 0), 0)::DOUBLE) AS log_faces
  FROM b),
c AS (
  SELECT *, list_filter([
    CASE WHEN NOT coalesce(load_ok, false) THEN 'load_failed' END, CASE WHEN error_word IS NOT NULL THEN 'has_error' END,
    CASE WHEN vertex_count IS NULL OR vertex_count < 50 THEN 'few_vertices' END,
    CASE WHEN face_count IS NULL OR face_count < 100 THEN 'few_faces' END, CASE WHEN face_count > 20000 THEN 'many_faces' END,
    CASE WHEN isfinite(degenerate_face_ratio) AND degenerate_face_ratio > 0.02 THEN 'degenerate' END,
    CASE WHEN fill_ratio IS NULL THEN 'no_volume' END, CASE WHEN hull_ratio IS NULL THEN 'no_hull' END,
    CASE WHEN planarity IS NULL OR elongation IS NULL THEN 'flat_box' END, CASE WHEN hull_ratio > 1 THEN 'hull_below_volume' END],
    lambda x: x IS NOT NULL) AS failed
  FROM m),
p AS (SELECT * FROM c WHERE len(failed) = 0)
"""
_SCORED = (
    _BASE
    + ", s AS (SELECT "
    + ", ".join(f"median({m}) AS med_{m}, mad({m}) AS mad_{m}" for m in MEASURES)
    + ", quantile_cont(fill_ratio, 1.0::DOUBLE / 3) AS q1, quantile_cont(fill_ratio, 2.0::DOUBLE / 3) AS q2, count(fill_ratio) AS nf FROM p), z AS (SELECT p.*, "
    + ", ".join(f"CASE WHEN mad_{m} IS NULL OR mad_{m} < 1e-12 THEN 0 * {m} ELSE ({m} - med_{m}) / (1.4826 * mad_{m} + 1e-12) END AS rz_{m}" for m in MEASURES)
    + """, CASE WHEN nf < 3 OR fill_ratio IS NULL THEN 'unknown' WHEN fill_ratio <= q1 THEN 'low' WHEN fill_ratio <= q2 THEN 'mid' ELSE 'high' END AS fill_tertile,
  CASE WHEN elongation >= 1.8 AND planarity >= 1.8 THEN 'bladed' WHEN elongation >= 1.8 THEN 'elongated' WHEN planarity >= 1.8 THEN 'flat_or_sheet_like' ELSE 'compact' END AS shape
  FROM p, s), f AS (SELECT *, """
    + " + ".join(f"(coalesce(abs(rz_{m}), 1e300) > 6)::INTEGER" for m in MEASURES)
    + " AS n_flags FROM z)"
)
_LABEL = r"CASE WHEN {0} NOT IN ('', 'unknown', 'null', 'none') THEN {0} END"
_KEY = r"regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g')"

SQL = {
    "robust_strata": _SCORED
    + """ SELECT shape, fill_tertile, count(*) AS n, count(*) FILTER (n_flags = 0) AS n_kept, count(*) FILTER (n_flags > 1) AS n_multi_flag,
round(avg(rz_fill_ratio), 6) AS mean_rz_fill FROM f GROUP BY ALL""",
    "hard_filter_reasons": _BASE + " SELECT row_id, array_to_string(failed, ',') AS failed FROM c",
    "reason_counts": _BASE
    + " SELECT reason, count(*) AS n_rows, count(*) FILTER (n = 1) AS n_only_reason FROM (SELECT unnest(failed) AS reason, len(failed) AS n FROM c) GROUP BY 1",
    "robust_z": _SCORED + " SELECT row_id, " + ", ".join(f"round(rz_{m}, 6) AS rz_{m}" for m in MEASURES) + ", n_flags FROM f",
    "tertile_bucket": _SCORED + " SELECT row_id, fill_tertile, shape FROM f",
    "keep_ratio": _SCORED
    + """ SELECT n_in, n_pass, n_stat, round(n_pass / greatest(n_in, 1)::DOUBLE, 6) AS pass_ratio, round(n_stat / greatest(n_pass, 1)::DOUBLE, 6) AS stat_ratio
FROM (SELECT count(*) AS n_in, count(*) FILTER (len(failed) = 0) AS n_pass FROM c), (SELECT count(*) FILTER (n_flags = 0) AS n_stat FROM f)""",
    "error_topk": f"SELECT {_ERROR} AS error, count(*) AS n FROM annotations WHERE {_ERROR} IS NOT NULL GROUP BY 1 ORDER BY n DESC, error LIMIT 3",
    "valid_strata": f"""SELECT shape, fill, count(DISTINCT uid) AS n_objects, count(*) AS n_rows FROM (
SELECT {_LABEL.format(_KEY.format('shape_type'))} AS shape, {_LABEL.format(_KEY.format('fill_bucket'))} AS fill,
  nullif(lower(regexp_replace(uid, '^\\s+|\\s+$', '', 'g')), '') AS uid FROM annotations)
WHERE shape IN ('compact', 'elongated', 'bladed', 'flat_or_sheet_like') AND fill IN ('low', 'mid', 'high') AND uid IS NOT NULL GROUP BY ALL""",
    "rule_engine": """SELECT split_name, count(*) AS n FROM split_members WHERE (self_occlusion_attribute >= 0.5 AND observation_saturation_view_num < 64
AND NOT abs(selected_view_count - 20) <= 1e-6) OR gt_surface_voxel_count <= 1500 GROUP BY 1""",
    "clean_candidates": """WITH s AS (SELECT row_id, list_sort(list_distinct(list_filter(candidate_view_ids,
  lambda x: x IS NOT NULL AND x >= 0 AND x < 128 AND NOT list_contains(coalesce(visited_view_ids, []), x)))) AS ids FROM method_steps)
SELECT row_id, len(ids)::INTEGER AS n_left, ids[1] AS first_left FROM s WHERE len(ids) > 0""",
}
