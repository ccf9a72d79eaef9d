"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.llm.bpe import decode_ids, encode_texts
from viewmill.llm.leak import decontaminated, leaks
from viewmill.llm.overlap import cross_split_pairs
from viewmill.llm.percentiles import percentiles_of_parts, saturation_percentiles, saturation_values, value_parts
from viewmill.llm.quota import categorised, draw, quotas, report, strata
from viewmill.llm.toxicity import LIMIT, document_scores
from viewmill.llm.topn import top_candidates
from viewmill.session import table, written


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_candidates(table(spark, sf_dir, "method_steps"))
    return top.select("uid", F.col("item_rank").cast("int").alias("item_rank"), "run_id", "start_view_id", "step_id", "candidate_view_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "percentile_limits")
    found = saturation_percentiles(table(spark, sf_dir, "saturation"), limits)
    above = found.join(F.broadcast(limits), ["metric", "pct"]).where("low > limit_value")  # limits: nine fixed rows
    return above.select("batch_id", "metric", "pct")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = saturation_percentiles(table(spark, sf_dir, "saturation"), table(spark, sf_dir, "percentile_limits"))
    return found.select("batch_id", "metric", "pct", F.col("n").alias("n_values"), F.col("low").alias("value"))


def p2_day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts to keep: counts of the first two digits of the values of each batch, metric and day."""
    return value_parts(saturation_values(table(spark, sf_dir, "saturation")), ["batch_id", "metric"], ["run_day"])


def p2_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from the kept parts of all days alone, as intervals of relative width below 2^-20."""
    pcts = table(spark, sf_dir, "percentile_limits").select("metric", "pct").distinct()
    found = percentiles_of_parts(written(p2_day_parts(spark, sf_dir), "day-parts"), ["batch_id", "metric"], pcts)
    return found.select("batch_id", "metric", "pct", F.col("n").alias("n_values"), "low", "high")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, sf_dir, "split_members"))
    a, b = F.col("eval_member"), F.col("train_member")
    return pairs.select(F.least(a, b).alias("member_id_a"), F.greatest(a, b).alias("member_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping members and pairs for each evaluation split and origin."""
    members = table(spark, sf_dir, "split_members")
    about = members.select(F.col("member_id").alias("eval_member"), "split_name", "origin")
    pairs = cross_split_pairs(members).join(about, "eval_member")
    return pairs.groupBy("split_name", "origin").agg(
        F.count_distinct("eval_member").alias("n_members"), F.count(F.lit(1)).alias("n_pairs")
    )


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    objects = written(categorised(table(spark, sf_dir, "annotations")), "objects")
    return objects, strata(objects, table(spark, sf_dir, "target_mix"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fall short after quotas were allocated and objects drawn."""
    return report(*_lines(spark, sf_dir)).where("shortfall > 0").select("request_id", "shape_type", "fill_bucket")


def p5_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota, drawn objects and shortfall of each line of target_mix."""
    lines = report(*_lines(spark, sf_dir))
    return lines.select("request_id", "shape_type", "fill_bucket", "wanted", "available", "quota", "n_drawn", "shortfall")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, lines = _lines(spark, sf_dir)
    return draw(objects, quotas(lines)).select("request_id", "shape_type", "fill_bucket", "uid", "draw_rank")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does every text come back from its ids? Documents, tokens and failures for each source."""
    docs = table(spark, sf_dir, "documents")
    ids = written(p7_ids(spark, sf_dir), "ids")
    back = decode_ids(ids).withColumnRenamed("text", "back")
    both = docs.select("doc_id", "source", "text").join(ids, "doc_id").join(back, "doc_id")
    same = F.coalesce("text", F.lit("")) == F.col("back")
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.count_if(~same).alias("n_failures")
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of each suite and the documents that hold them, by source."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    found = leaks(docs, items).select("doc_id", "item_id").distinct()
    named = found.join(items.select("item_id", "suite", "item_split"), "item_id").join(docs.select("doc_id", "source"), "doc_id")
    return named.groupBy("suite", "item_split", "source").agg(
        F.count_distinct("item_id").alias("n_items"), F.count_distinct("doc_id").alias("n_docs")
    )


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = document_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mod_samples"))
    return scores.where(F.col("score") > LIMIT).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored documents and the share above the limit for each source."""
    docs = table(spark, sf_dir, "documents")
    scores = document_scores(docs, table(spark, sf_dir, "mod_samples"))
    both = docs.select("doc_id", "source").distinct().join(scores, "doc_id")
    found = F.count_if(F.col("score") > LIMIT)
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), found.alias("n_found"), F.round(found / F.count(F.lit(1)), 6).alias("rate")
    )


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_percentiles": p2_percentiles,
    "p2_day_parts": p2_day_parts,
    "p2_from_parts": p2_from_parts,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p5_found": p5_found,
    "p5_quotas": p5_quotas,
    "p5_sample": p5_sample,
    "p7_ids": p7_ids,
    "p7_roundtrip": p7_roundtrip,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_cleaned": p8_cleaned,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

_TRIM = r"nullif(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '')"

_P2 = rf"""
WITH o AS (
  SELECT batch_id, coalesce({_TRIM.format('uid')}, 'row ' || row_id) AS u, a_fit, b_discrete, curve_raw,
    row_number() OVER (PARTITION BY batch_id, coalesce({_TRIM.format('uid')}, 'row ' || row_id) ORDER BY run_day, row_id) AS k
  FROM saturation),
v AS (
  SELECT batch_id, 'a_fit' AS metric, a_fit AS value FROM o WHERE k = 1 AND a_fit BETWEEN 0 AND 1 AND isfinite(a_fit)
  UNION ALL SELECT batch_id, 'b_discrete', b_discrete::DOUBLE FROM o WHERE k = 1 AND b_discrete BETWEEN 1 AND 10000
  UNION ALL SELECT batch_id, 'curve_raw', y FROM (SELECT batch_id, unnest(curve_raw).y AS y FROM o WHERE k = 1)
    WHERE y >= 0 AND isfinite(y)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id, metric ORDER BY value) AS rn, count(*) OVER (PARTITION BY batch_id, metric) AS n_values
  FROM v),
p AS (
  SELECT r.batch_id, r.metric, l.pct, r.n_values, r.value, l.limit_value FROM r JOIN percentile_limits l ON r.metric = l.metric
  WHERE rn = greatest(1, CAST(ceil(l.pct * n_values / 100.0) AS BIGINT)))
"""

_P3 = r"""
WITH m AS (
  SELECT *, nullif(regexp_extract(regexp_replace(lower(uid), '[-{}\s]', '', 'g'), '([0-9a-f]{32})', 1), '') AS hex,
    split_name IN ('main_raw_train', 'main_balanced_train') AS is_train
  FROM split_members
  WHERE split_name IN ('main_raw_train', 'main_balanced_train', 'main_analysis_test', 'hidden_test', 'demo_hidden_test', 'demo_long_tail')),
x AS (
  SELECT e.member_id AS em, t.member_id AS tm, e.split_name, e.origin FROM m e JOIN m t ON NOT e.is_train AND t.is_train AND (
    (e.hex IS NOT NULL AND t.hex IS NOT NULL AND hamming(coalesce(e.hex, repeat('x', 32)), coalesce(t.hex, repeat('y', 32))) <= 2)
    OR (e.observation_saturation_view_num = t.observation_saturation_view_num AND e.selected_view_count = t.selected_view_count
      AND abs(e.self_occlusion_attribute - t.self_occlusion_attribute) <= 0.001 * greatest(abs(e.self_occlusion_attribute), abs(t.self_occlusion_attribute))
      AND abs(e.gt_surface_voxel_count - t.gt_surface_voxel_count) <= 0.001 * greatest(abs(e.gt_surface_voxel_count), abs(t.gt_surface_voxel_count))
      AND abs(e.area - t.area) <= 0.001 * greatest(abs(e.area), abs(t.area))
      AND abs(e.volume - t.volume) <= 0.001 * greatest(abs(e.volume), abs(t.volume))
      AND isfinite(e.self_occlusion_attribute + e.area + e.volume + t.self_occlusion_attribute + t.area + t.volume))))
"""

_CATEGORY = r"nullif(regexp_replace(lower(regexp_replace({}, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g'), '')"

_P5 = rf"""
WITH o AS (
  SELECT {_CATEGORY.format('shape_type')} AS s, {_CATEGORY.format('fill_bucket')} AS f, count(DISTINCT {_TRIM.format('uid')}) AS n
  FROM annotations GROUP BY ALL),
l AS (
  SELECT t.request_id, t.shape_type, t.fill_bucket, o.s, o.f, t.target_share AS share, t.min_count, t.target_n, coalesce(o.n, 0) AS available,
    greatest(t.min_count, round(t.target_share * t.target_n))::BIGINT AS wanted
  FROM target_mix t LEFT JOIN o ON o.s = {_CATEGORY.format('t.shape_type')} AND o.f = {_CATEGORY.format('t.fill_bucket')})
"""

SQL = {
    "p1_found": rf"""
WITH e AS (
  SELECT {_TRIM.format('uid')} AS uid, run_id, start_view_id, step_id, universe_voxel_count,
    unnest(list_zip(candidate_view_ids, candidate_marginal_gains, true)) AS p
  FROM method_steps),
i AS (
  SELECT uid, run_id, start_view_id, step_id, p[1] AS candidate_view_id, max(p[2]) AS gain FROM e
  WHERE uid IS NOT NULL AND p[1] IS NOT NULL AND p[2] >= 0 AND p[2] <= coalesce(universe_voxel_count, p[2])
  GROUP BY ALL),
r AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY gain DESC, run_id, start_view_id, step_id, candidate_view_id)::INTEGER AS item_rank FROM i)
SELECT uid, item_rank, run_id, start_view_id, step_id, candidate_view_id FROM r WHERE item_rank <= 10""",
    "p2_found": _P2 + "SELECT batch_id, metric, pct FROM p WHERE value > limit_value",
    "p2_percentiles": _P2 + "SELECT batch_id, metric, pct, n_values, value FROM p",
    "p3_found": _P3 + "SELECT DISTINCT least(em, tm) AS member_id_a, greatest(em, tm) AS member_id_b FROM x",
    "p3_report": _P3 + "SELECT split_name, origin, count(DISTINCT em) AS n_members, count(*) AS n_pairs FROM (SELECT DISTINCT * FROM x) GROUP BY ALL",
    "p5_quotas": _P5
    + """, b AS (SELECT *, share * target_n AS ideal, least(min_count, available)::DOUBLE AS lo, available::DOUBLE AS hi FROM l),
pt AS (SELECT DISTINCT request_id, unnest([lo / ideal, hi / ideal]) AS sc FROM b WHERE ideal > 0),
ev AS (SELECT pt.request_id, sc, max(target_n) AS size, sum(greatest(lo, least(hi, sc * ideal))) AS tot FROM pt JOIN b USING (request_id) GROUP BY ALL),
sg AS (SELECT *, lead(sc) OVER w AS sc2, lead(tot) OVER w AS tot2 FROM ev WINDOW w AS (PARTITION BY request_id ORDER BY sc)),
scale AS (SELECT request_id, min(CASE WHEN tot2 > tot THEN sc + (size - tot) * (sc2 - sc) / (tot2 - tot) ELSE sc END) AS scale
  FROM sg WHERE tot <= size AND tot2 >= size GROUP BY 1),
x AS (SELECT b.*, CASE WHEN sum(hi) OVER r <= target_n THEN hi WHEN sum(lo) OVER r >= target_n THEN lo
    ELSE greatest(lo, least(hi, coalesce(scale, 0) * ideal)) END AS exact
  FROM b LEFT JOIN scale USING (request_id) WINDOW r AS (PARTITION BY request_id)),
y AS (SELECT *, floor(exact + 1e-9) AS base FROM x),
z AS (SELECT *, base < hi AND ideal > 0 AS grows, greatest(target_n - sum(base) OVER (PARTITION BY request_id), 0) AS rest FROM y),
q AS (SELECT *, (base + CASE WHEN grows AND row_number() OVER (PARTITION BY request_id ORDER BY grows DESC, round(exact - base, 9) DESC,
    s NULLS FIRST, f NULLS FIRST, shape_type, fill_bucket) <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM z)
SELECT request_id, shape_type, fill_bucket, wanted, available, quota, least(quota, available) AS n_drawn, greatest(wanted - available, 0) AS shortfall FROM q""",
    "p5_found": _P5 + "SELECT request_id, shape_type, fill_bucket FROM l WHERE available < wanted",
}
