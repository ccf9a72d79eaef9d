"""Windows over curves, runs and events; splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewmill.functions.scalar import number
from viewmill.operators.windows import (
    checkpoints,
    first_seen,
    hamilton_quotas,
    hash_order,
    monotone_gain,
    stabilised_at,
    take_quota,
    water_level,
)
from viewmill.session import clean_key, table


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid points of each saturation row: row_id, n, y (of several y at one n the largest)."""
    rows = table(spark, sf_dir, "saturation").select("row_id", F.inline("curve_raw"))
    ok = rows.select("row_id", "n", number(F.col("y")).alias("y")).where("n is not null and y >= 0")
    return ok.groupBy("row_id", "n").agg(F.max("y").alias("y"))


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each step of a run from a start view: the first delivery."""
    rows = table(spark, sf_dir, "method_steps").where("covered_voxel_count is not null")
    keep = F.struct("covered_voxel_count", "covered_ratio", "oracle_nbv_view_id", "oracle_nbv_gain", "visited_view_ids")
    return rows.groupBy("run_id", "start_view_id", "step_id").agg(F.min_by(keep, F.col("row_id")).alias("r")).select("run_id", "start_view_id", "step_id", "r.*")


def cummax_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monotone_gain(curve_points(spark, sf_dir), ["row_id"], "n", "y").select("row_id", "n", "y_mono", F.round("gain", 6).alias("gain"))


def normalised_curve_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves normalised by their largest value: mean level and mean gain at each n."""
    points = monotone_gain(curve_points(spark, sf_dir), ["row_id"], "n", "y")
    top = F.max("y_mono").over(Window.partitionBy("row_id"))
    norm = points.withColumn("top", top).where("top > 0")
    return norm.groupBy("n").agg(
        F.count(F.lit(1)).alias("n_curves"), F.round(F.avg(F.col("y_mono") / F.col("top")), 6).alias("level"), F.round(F.avg(F.col("gain") / F.col("top")), 6).alias("gain")
    )


def snap_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each curve the value at the next n that is at least 64, else at its last n."""
    points = curve_points(spark, sf_dir)
    at = F.coalesce(F.min(F.when(F.col("n") >= 64, F.col("n"))), F.max("n"))
    chosen = points.groupBy("row_id").agg(at.alias("n"))
    return points.join(chosen, ["row_id", "n"]).select("row_id", "n", "y")


def map_stabilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stabilised_at(run_steps(spark, sf_dir), ["run_id", "start_view_id"], "step_id", "covered_voxel_count", 0.05, 2)


def checkpoints_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered ratio at budgets of 1, 2, 4 and 8 steps, or at the end of shorter runs."""
    out = checkpoints(run_steps(spark, sf_dir), ["run_id", "start_view_id"], "step_id", [1, 2, 4, 8], "covered_ratio")
    return out.select("run_id", "start_view_id", "budget", F.col("value").alias("covered_ratio"), "reached")


def first_seen_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and known views of each run at each step at which any is new."""
    seen = run_steps(spark, sf_dir).select("run_id", "start_view_id", "step_id", F.explode("visited_view_ids").alias("view_id"))
    return first_seen(seen.where("view_id is not null"), ["run_id", "start_view_id"], "view_id", "step_id")


def cumulative_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running time of each user's events, clicks counted as idle (null adds nothing)."""
    rows = table(spark, sf_dir, "events").withColumn("busy", F.when(F.col("event_type") != "click", F.col("value")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    run = F.coalesce(F.sum("busy").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return rows.select("event_id", F.round(run, 4).alias("running"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of each run in step order up to the first gain that isn't positive, each view once (K8)."""
    w = Window.partitionBy("run_id", "start_view_id").orderBy("step_id")
    steps = run_steps(spark, sf_dir).withColumn("alive", F.min((F.coalesce("oracle_nbv_gain", F.lit(0)) > 0).cast("int")).over(w))
    live = steps.where("alive = 1 and oracle_nbv_view_id is not null")
    once = live.groupBy("run_id", "start_view_id", "oracle_nbv_view_id").agg(F.min("step_id").alias("step_id"))
    place = F.row_number().over(Window.partitionBy("run_id", "start_view_id").orderBy("step_id", "oracle_nbv_view_id"))
    return once.select("run_id", "start_view_id", place.alias("place"), F.col("oracle_nbv_view_id").alias("view_id"))


def required_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that saw every one of the views 1, 2 and 3."""
    seen = run_steps(spark, sf_dir).select("run_id", "start_view_id", F.explode("visited_view_ids").alias("v")).where("v in (1, 2, 3)")
    return seen.groupBy("run_id", "start_view_id").agg(F.count_distinct("v").alias("n")).where("n = 3").select("run_id", "start_view_id")


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds over the values of C in the analysis test: each round takes the next member of every value."""
    rows = table(spark, sf_dir, "split_members").where("split_name = 'main_analysis_test' and selected_view_count is not null")
    w = Window.partitionBy("selected_view_count").orderBy(hash_order("member_id"))
    turn = F.row_number().over(w)
    return rows.select("member_id", "selected_view_count", turn.alias("round")).where("round <= 3")


def tertile_rank_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Easy, medium and hard thirds of each split by C; a boundary value goes to the lower group whole."""
    rows = table(spark, sf_dir, "split_members").where("selected_view_count is not null")
    per = rows.groupBy("split_name", "selected_view_count").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("split_name").orderBy("selected_view_count")
    before = F.sum("n").over(w) - F.col("n")
    total = F.sum("n").over(Window.partitionBy("split_name"))
    group = F.when(F.col("before") < F.floor(F.col("total") / 3), "easy").when(F.col("before") < F.floor(2 * F.col("total") / 3), "medium").otherwise("hard")
    out = per.withColumns({"before": before, "total": total}).withColumn("grp", group)
    return out.groupBy("split_name", "grp").agg(F.sum("n").alias("n"), F.min("selected_view_count").alias("c_min"), F.max("selected_view_count").alias("c_max"))


def hamilton_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas of 200 members over the values of C, ties to the larger C."""
    counts = table(spark, sf_dir, "split_members").where("selected_view_count is not null").groupBy("selected_view_count").agg(F.count(F.lit(1)).alias("n"))
    return hamilton_quotas(counts, "n", 200, F.desc("selected_view_count"))


def simple_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded quotas of at least 1; their sum may miss the target."""
    counts = table(spark, sf_dir, "split_members").where("selected_view_count is not null").groupBy("selected_view_count").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy()) * 200
    return counts.select("selected_view_count", F.greatest(F.lit(1), F.bround(share).cast("long")).alias("quota"))


def balanced_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water-filling quotas of 600 members over pool types and splits."""
    counts = table(spark, sf_dir, "split_members").groupBy("split_name", "pool_type").agg(F.count(F.lit(1)).alias("n"))
    return water_level(counts, "n", 600)


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of the balanced quotas, by hash order."""
    rows = table(spark, sf_dir, "split_members").select("split_name", "pool_type", "member_id")
    return take_quota(rows, ["split_name", "pool_type"], balanced_quota(spark, sf_dir), [hash_order("member_id"), F.col("member_id")])


def group_until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups by hash order while each brings the total nearer to 300; stops at the first that doesn't."""
    groups = table(spark, sf_dir, "split_members").groupBy("origin", "split_name").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(hash_order("origin", "split_name"))
    total = F.sum("n").over(w)
    nearer = F.abs(F.col("total") - 300) < F.abs(F.col("total") - F.col("n") - 300)
    marked = groups.withColumn("total", total).withColumn("ok", nearer.cast("int"))
    return marked.withColumn("all_ok", F.min("ok").over(w)).where("all_ok = 1").select("origin", "split_name", "n", "total")


def leak_free_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated objects dealt to test (a tenth by hash) and train, without those of the hidden test."""
    uids = table(spark, sf_dir, "annotations").select(clean_key("uid").alias("uid")).where("uid is not null").distinct()
    hidden = table(spark, sf_dir, "split_members").where("split_name = 'hidden_test'").select(clean_key("uid").alias("uid"))
    free = uids.join(hidden, "uid", "left_anti")
    return free.select("uid", F.when(F.substring(hash_order("uid"), 1, 2) < "1a", "test").otherwise("train").alias("side"))


def start_view_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two start views of each run by hash order."""
    starts = table(spark, sf_dir, "method_steps").select("run_id", "start_view_id").distinct()
    w = Window.partitionBy("run_id").orderBy(hash_order("run_id", "start_view_id"))
    return starts.withColumn("k", F.row_number().over(w)).where("k <= 2").select("run_id", "start_view_id")


def range_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in sorted order cut into batches of 64 by global position (S22, O8): batch, first and last uid, size.

    Positions come from the counts of range partitions by leading digits, not from one sorted task.
    """
    uids = table(spark, sf_dir, "annotations").select(clean_key("uid").alias("uid")).where("uid is not null").distinct()
    cut = uids.withColumn("head", F.substring("uid", 1, 3))
    sizes = cut.groupBy("head").agg(F.count(F.lit(1)).alias("m"))  # at most 4096 heads for hexadecimal uids
    before = sizes.withColumn("before", F.sum("m").over(Window.orderBy("head")) - F.col("m")).select("head", "before")
    place = F.col("before") + F.row_number().over(Window.partitionBy("head").orderBy("uid"))
    numbered = cut.join(F.broadcast(before), "head").withColumn("batch", F.floor((place - 1) / 64))
    return numbered.groupBy("batch").agg(F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"), F.count(F.lit(1)).alias("size"))


QUERIES = {f.__name__: f for f in (
    cummax_gain, normalised_curve_stats, snap_next, map_stabilisation, checkpoints_k, first_seen_merge, cumulative_runtime, replay,
    required_checkpoints, round_robin, tertile_rank_split, hamilton_quota, simple_quota, balanced_quota, quota_sample,
    group_until_target, leak_free_split, start_view_subset, range_batches,
)}

_UID = r"nullif(lower(regexp_replace(uid, '^\s+|\s+$', '', 'g')), '')"
_CURVE = """WITH c0 AS (SELECT row_id, unnest(curve_raw) AS p FROM saturation),
c AS (SELECT row_id, p.n AS n, max(p.y) AS y FROM c0 WHERE p.n IS NOT NULL AND isfinite(p.y) AND p.y >= 0 GROUP BY ALL),
g AS (SELECT *, lead(y_mono) OVER w - y_mono AS gain FROM (SELECT *, max(y) OVER (PARTITION BY row_id ORDER BY n) AS y_mono FROM c) WINDOW w AS (PARTITION BY row_id ORDER BY n))
"""
_STEPS = """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk
  FROM method_steps WHERE covered_voxel_count IS NOT NULL) WHERE rk = 1)
"""
_HASH = lambda *c: "sha256(concat_ws('|', " + ", ".join(["'42'", *(f"{x}::VARCHAR" for x in c)]) + "))"
_C = "SELECT selected_view_count, count(*) AS n FROM split_members WHERE selected_view_count IS NOT NULL GROUP BY 1"
_WATER = """WITH c AS (SELECT split_name, pool_type, count(*) AS n FROM split_members GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS i, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, count(*) OVER () AS m FROM c WINDOW w AS (ORDER BY n, split_name, pool_type)),
l AS (SELECT i AS li, before AS lb, floor((600 - before) / (m - i + 1)::DOUBLE) AS lvl FROM o WHERE n > (600 - before) / (m - i + 1)::DOUBLE ORDER BY i LIMIT 1),
q AS (SELECT split_name, pool_type, n, (CASE WHEN li IS NULL OR i < li THEN n ELSE least(n, lvl + (m - i + 1 <= 600 - lb - lvl * (m - li + 1))::INTEGER) END)::BIGINT AS quota FROM o LEFT JOIN l ON true)
"""

SQL = {
    "cummax_gain": _CURVE + "SELECT row_id, n, y_mono, round(gain, 6) AS gain FROM g",
    "normalised_curve_stats": _CURVE + """SELECT n, count(*) AS n_curves, round(avg(y_mono / top), 6) AS level, round(avg(gain / top), 6) AS gain
FROM (SELECT *, max(y_mono) OVER (PARTITION BY row_id) AS top FROM g) WHERE top > 0 GROUP BY n""",
    "snap_next": _CURVE + "SELECT row_id, n, y FROM (SELECT *, coalesce(min(CASE WHEN n >= 64 THEN n END) OVER w, max(n) OVER w) AS k FROM c WINDOW w AS (PARTITION BY row_id)) WHERE n = k",
    "map_stabilisation": _STEPS + """, a AS (SELECT *, lag(covered_voxel_count) OVER w AS p FROM s WINDOW w AS (PARTITION BY run_id, start_view_id ORDER BY step_id)),
b AS (SELECT *, coalesce(((covered_voxel_count - p) / greatest(p, 1)::DOUBLE < 0.05::DOUBLE)::INTEGER, 0) AS sm FROM a),
d AS (SELECT *, sum(1 - sm) OVER (PARTITION BY run_id, start_view_id ORDER BY step_id) AS isl FROM b),
e AS (SELECT *, sum(sm) OVER (PARTITION BY run_id, start_view_id, isl ORDER BY step_id) AS run FROM d)
SELECT run_id, start_view_id, min(CASE WHEN run >= 2 THEN step_id END) AS stable_at, max(run)::BIGINT AS longest_run, count(*) AS n_steps FROM e GROUP BY ALL""",
    "checkpoints_k": _STEPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id ORDER BY step_id) - 1 AS pos FROM s),
a AS (SELECT run_id, start_view_id, max(pos) AS e, arg_max(covered_ratio, pos) AS t, map_from_entries(list((pos, covered_ratio))) AS m FROM r GROUP BY ALL)
SELECT run_id, start_view_id, budget, coalesce(m[budget], t) AS covered_ratio, e >= budget AS reached FROM (SELECT *, unnest([1, 2, 4, 8]) AS budget FROM a)""",
    "first_seen_merge": _STEPS + """, v AS (SELECT run_id, start_view_id, step_id, unnest(visited_view_ids) AS v FROM s),
f AS (SELECT run_id, start_view_id, v, min(step_id) AS step_id FROM v WHERE v IS NOT NULL GROUP BY ALL),
n AS (SELECT run_id, start_view_id, step_id, count(*) AS n_new FROM f GROUP BY ALL)
SELECT *, sum(n_new) OVER (PARTITION BY run_id, start_view_id ORDER BY step_id)::BIGINT AS n_known FROM n""",
    "cumulative_runtime": "SELECT event_id, round(coalesce(sum(CASE WHEN event_type <> 'click' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0), 4) AS running FROM events",
    "replay": _STEPS + """, a AS (SELECT *, min((coalesce(oracle_nbv_gain, 0) > 0)::INTEGER) OVER (PARTITION BY run_id, start_view_id ORDER BY step_id) AS alive FROM s),
o AS (SELECT run_id, start_view_id, oracle_nbv_view_id AS view_id, min(step_id) AS step_id FROM a WHERE alive = 1 AND oracle_nbv_view_id IS NOT NULL GROUP BY ALL)
SELECT run_id, start_view_id, row_number() OVER (PARTITION BY run_id, start_view_id ORDER BY step_id, view_id)::INTEGER AS place, view_id FROM o""",
    "required_checkpoints": _STEPS + "SELECT run_id, start_view_id FROM (SELECT run_id, start_view_id, unnest(visited_view_ids) AS v FROM s) WHERE v IN (1, 2, 3) GROUP BY ALL HAVING count(DISTINCT v) = 3",
    "round_robin": f"""SELECT * FROM (SELECT member_id, selected_view_count, row_number() OVER (PARTITION BY selected_view_count ORDER BY {_HASH('member_id')})::INTEGER AS round
FROM split_members WHERE split_name = 'main_analysis_test' AND selected_view_count IS NOT NULL) WHERE round <= 3""",
    "tertile_rank_split": """WITH p AS (SELECT split_name, selected_view_count AS c, count(*) AS n FROM split_members WHERE selected_view_count IS NOT NULL GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY split_name ORDER BY c) - n AS before, sum(n) OVER (PARTITION BY split_name) AS total FROM p)
SELECT split_name, CASE WHEN before < floor(total / 3.0) THEN 'easy' WHEN before < floor(2 * total / 3.0) THEN 'medium' ELSE 'hard' END AS grp, sum(n)::BIGINT AS n, min(c) AS c_min, max(c) AS c_max FROM b GROUP BY ALL""",
    "hamilton_quota": f"""WITH c AS ({_C}), e AS (SELECT *, n * 200.0::DOUBLE / sum(n) OVER () AS x FROM c), b AS (SELECT *, floor(x + 1e-9) AS base FROM e)
SELECT selected_view_count, n, (base + (row_number() OVER (ORDER BY round(x - base, 9) DESC, selected_view_count DESC) <= 200 - sum(base) OVER ())::INTEGER)::BIGINT AS quota FROM b""",
    "simple_quota": f"SELECT selected_view_count, greatest(1, round_even(n / sum(n) OVER ()::DOUBLE * 200, 0)::BIGINT) AS quota FROM ({_C})",
    "balanced_quota": _WATER + "SELECT * FROM q",
    "quota_sample": _WATER + f"""SELECT split_name, pool_type, member_id FROM (SELECT m.split_name, m.pool_type, member_id, quota,
row_number() OVER (PARTITION BY m.split_name, m.pool_type ORDER BY {_HASH('member_id')}) AS r FROM split_members m JOIN q ON m.split_name = q.split_name AND m.pool_type = q.pool_type) WHERE r <= quota""",
    "group_until_target": f"""WITH g AS (SELECT origin, split_name, count(*) AS n FROM split_members GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (ORDER BY {_HASH('origin', 'split_name')}) AS total FROM g),
k AS (SELECT *, min((abs(total - 300) < abs(total - n - 300))::INTEGER) OVER (ORDER BY {_HASH('origin', 'split_name')}) AS ok FROM t)
SELECT origin, split_name, n, total::BIGINT AS total FROM k WHERE ok = 1""",
    "leak_free_split": f"""SELECT uid, CASE WHEN substr({_HASH('uid')}, 1, 2) < '1a' THEN 'test' ELSE 'train' END AS side FROM (SELECT DISTINCT {_UID} AS uid FROM annotations)
WHERE uid IS NOT NULL AND uid NOT IN (SELECT {_UID} FROM split_members WHERE split_name = 'hidden_test' AND {_UID} IS NOT NULL)""",
    "start_view_subset": f"""SELECT run_id, start_view_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {_HASH('run_id', 'start_view_id')}) AS k
FROM (SELECT DISTINCT run_id, start_view_id FROM method_steps)) WHERE k <= 2""",
    "range_batches": f"""SELECT batch, min(uid) AS first_uid, max(uid) AS last_uid, count(*) AS size FROM (SELECT uid, (row_number() OVER (ORDER BY uid) - 1) // 64 AS batch
FROM (SELECT DISTINCT {_UID} AS uid FROM annotations) WHERE uid IS NOT NULL) GROUP BY batch""",
}
