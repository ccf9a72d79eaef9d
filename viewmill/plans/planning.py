"""Iterative planning queries: budgeted and residual covers, paths, farthest points, occupancy and rays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewmill.functions.scalar import binary_entropy, occupancy_class
from viewmill.operators.cover import greedy_cover
from viewmill.operators.geometry import rotate, sphere_pose, voxel_keys
from viewmill.operators.path import farthest_points, open_paths, representatives
from viewmill.operators.windows import tiled_to
from viewmill.plans.coverage import OBJECT, VIEW, VOXEL, cache_points, candidates, first_view, views
from viewmill.plans.coverage import _BEST, _COVER, _VIEWS, greedy_sql
from viewmill.plans.records import POINTS_SQL
from viewmill.plans.sequences import SQL as SEQUENCE_SQL
from viewmill.plans.sequences import replay, run_steps
from viewmill.session import table


def max_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels that three greedily chosen views of each object cover (N6; at least 1 - 1/e of the optimum)."""
    picks = greedy_cover(views(spark, sf_dir), OBJECT, VIEW, VOXEL, budget=3)
    return picks.groupBy("obj").agg(F.count(F.lit(1)).alias("n_views"), F.max("n_covered").alias("n_covered"))


def residual_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cover by the other views of what each object's first view leaves open."""
    cov = views(spark, sf_dir)
    first = first_view(cov)
    covered = cov.join(first, ["obj", "view_number"], "left_semi").select("obj", "voxel")
    rest = cov.join(covered, ["obj", "voxel"], "left_anti")
    return greedy_cover(rest, OBJECT, VIEW, VOXEL)


def open_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest way over all views that each run chose, from the first one on; ``method`` tells exact from heuristic."""
    steps = run_steps(spark, sf_dir).where("oracle_nbv_view_id between 0 and 127")
    once = steps.groupBy("run_id", "start_view_id", "oracle_nbv_view_id").agg(F.min("step_id").alias("step_id"))
    idx = F.row_number().over(Window.partitionBy("run_id", "start_view_id").orderBy("step_id", "oracle_nbv_view_id")) - 1
    nodes = once.withColumn("idx", idx).withColumns(sphere_pose(F.col("oracle_nbv_view_id"), 128, 1.0))
    out = open_paths(nodes.select("run_id", "start_view_id", "idx", "x", "y", "z"), ["run_id", "start_view_id"])
    return out.select("run_id", "start_view_id", "n_nodes", F.round("cost", 6).alias("cost"), "method")


def farthest_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four views of each object chosen as far apart as a greedy choice makes them."""
    ids = views(spark, sf_dir).select("obj", "view_number").distinct().where("view_number between 0 and 127")
    posed = ids.withColumns(sphere_pose(F.col("view_number"), 128, 1.0))
    out = farthest_points(posed, ["obj"], "view_number", 4)
    return out.select("obj", "place", "view_number", F.round("gap", 6).alias("gap"))


def topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of steps whose recorded oracle view is among the 1, 3 and 5 best candidates."""
    w = Window.partitionBy("row_id").orderBy(F.desc("gain"), "view_id")
    ranked = candidates(spark, sf_dir).withColumn("rank", F.row_number().over(w))
    truth = table(spark, sf_dir, "method_steps").where("oracle_nbv_view_id is not null").select("row_id", F.col("oracle_nbv_view_id").alias("view_id"))
    hits = truth.join(ranked, ["row_id", "view_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("int"), F.lit(0))), 6).alias(f"top{k}") for k in (1, 3, 5)))


def bucket_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean oracle gain of each step number and a quota relative to the first one's, at most what there is."""
    rows = run_steps(spark, sf_dir).where("oracle_nbv_gain > 0")
    per = rows.groupBy("step_id").agg(F.count(F.lit(1)).alias("n"), F.avg("oracle_nbv_gain").alias("gain"))
    base = per.where("step_id = 0").select(F.col("gain").alias("gain0"))
    quota = F.least(F.col("n"), F.ceil(F.round(100 / F.col("gain0") * F.col("gain"), 9)))
    return per.join(F.broadcast(base)).select("step_id", "n", F.round("gain", 6).alias("gain"), quota.cast("long").alias("quota"))


def occupancy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds of each cell after the object's views in order (hit +0.85, miss -0.4, clamped to [-2, 3.5]) by class."""
    cells = voxel_keys(cache_points(spark, sf_dir), 0.5).select("obj", "view_number", "vx", "vy", "vz").distinct()
    seen = cells.groupBy("obj", "vx", "vy", "vz").agg(F.collect_set("view_number").alias("hits"))  # at most the views of an object
    order = cells.groupBy("obj").agg(F.array_sort(F.collect_set("view_number")).alias("views"))
    step = lambda s, v: F.greatest(F.lit(-2.0), F.least(F.lit(3.5), s + F.when(F.array_contains("hits", v), 0.85).otherwise(-0.4)))
    odds = seen.join(order, "obj").withColumn("odds", F.aggregate("views", F.lit(0.0), step))
    p = 1 / (1 + F.exp(-F.col("odds")))
    return odds.groupBy("obj", occupancy_class(p).alias("class")).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum(binary_entropy(p)), 5).alias("entropy"))


def ray_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each view's pose a ray through the middle of its object: steps to the first occupied cell, if any.

    The pose is turned by a tenth of a radian around the y axis; the walk has 96 steps of 1/32.
    """
    points = cache_points(spark, sf_dir).where("view_number between 0 and 127")
    occupied = voxel_keys(points, 0.25).select("obj", "vx", "vy", "vz").distinct()
    pose = sphere_pose(F.col("view_number"), 128, 2.0)
    posed = points.select("obj", "view_number").distinct().withColumns({f"e{k}": v for k, v in pose.items()})
    turned = rotate([F.col(f"e{c}") for c in "xyz"], [F.lit(0.0), F.lit(1.0), F.lit(0.0)], F.lit(0.1))
    rays = posed.select("obj", "view_number", *(t.alias(f"d{c}") for t, c in zip(turned, "xyz", strict=True)), F.explode(F.sequence(F.lit(0), F.lit(95))).alias("step"))
    at = 1 - (F.col("step") + 0.5) / 64
    walk = rays.withColumns({c: F.round(F.col(f"d{c}") * at, 9) for c in "xyz"})
    hits = voxel_keys(walk, 0.25).join(occupied, ["obj", "vx", "vy", "vz"], "left_semi")
    first = hits.groupBy("obj", "view_number").agg(F.min("step").alias("first_hit"))
    return posed.select("obj", "view_number").join(first, ["obj", "view_number"], "left")


def view_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three representative views of each object by position."""
    ids = views(spark, sf_dir).select("obj", "view_number").distinct().where("view_number between 0 and 127")
    posed = ids.withColumns(sphere_pose(F.col("view_number"), 128, 1.0))
    return representatives(posed, ["obj"], "view_number", 3)


def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each run ended, by the first rule that holds at its last step."""
    last = run_steps(spark, sf_dir).groupBy("run_id", "start_view_id").agg(
        F.max_by(F.struct("covered_ratio", "oracle_nbv_gain", "oracle_nbv_view_id"), "step_id").alias("r"), F.count(F.lit(1)).alias("n")
    )
    reason = (
        F.when(F.col("r.covered_ratio") >= 0.999, "full_coverage")
        .when(F.coalesce("r.oracle_nbv_gain", F.lit(0)) <= 0, "no_gain")
        .when(F.col("r.oracle_nbv_view_id").isNull(), "no_view")
        .when(F.col("n") >= 6, "budget")
        .otherwise("cut_off")
    )
    return last.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n_runs"))


def fallback_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's replayed views followed by all other views of the ring of 128 in id order: place and origin."""
    played = replay(spark, sf_dir).select("run_id", "start_view_id", "view_id", F.col("place").alias("p"))
    runs = played.select("run_id", "start_view_id").distinct()
    rest = runs.select("run_id", "start_view_id", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("view_id"))
    rest = rest.join(played, ["run_id", "start_view_id", "view_id"], "left_anti").withColumn("p", F.lit(None).cast("int"))
    w = Window.partitionBy("run_id", "start_view_id").orderBy(F.asc_nulls_last("p"), "view_id")
    both = played.unionByName(rest)
    return both.select("run_id", "start_view_id", "view_id", F.row_number().over(w).alias("place"), F.when(F.col("p").isNull(), "fallback").otherwise("replay").alias("origin"))


def top_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five members of each pool with the smallest and five with the largest B (O3)."""
    b = F.col("observation_saturation_view_num")
    rows = table(spark, sf_dir, "split_members").where(b.isNotNull()).select("pool_type", "member_id", b.alias("b"))
    low = F.row_number().over(Window.partitionBy("pool_type").orderBy("b", "member_id"))
    high = F.row_number().over(Window.partitionBy("pool_type").orderBy(F.desc("b"), "member_id"))
    ends = [rows.withColumn("k", o).where("k <= 5").select(F.lit(n).alias("end"), "pool_type", "k", "member_id") for n, o in (("low", low), ("high", high))]
    return ends[0].unionByName(ends[1])


def tiled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each object repeated in order up to 2048 rows exactly (X32): rows, distinct points, rows of the first point."""
    points = cache_points(spark, sf_dir).select("obj", "x", "y", "z").distinct()
    tiled = tiled_to(points, ["obj"], ["x", "y", "z"], 2048)
    return tiled.groupBy("obj").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("x", "y", "z").alias("n_points"), F.count_if(F.col("place") == 1).alias("first_rows"))


QUERIES = {f.__name__: f for f in (
    max_coverage, residual_cover, open_path, farthest_views, topk_accuracy, bucket_quotas, occupancy_map, ray_walk,
    view_clusters, stop_reasons, fallback_order, top_examples, tiled_points,
)}

_GOLDEN = math.pi * (3 - math.sqrt(5))
_X = "{r}::DOUBLE * sqrt(1 - pow(1 - 2 * (view_number + 0.5::DOUBLE) / 128, 2))"
_EYE = f"{_X} * cos(view_number * {_GOLDEN!r}::DOUBLE) AS ex, {{r}}::DOUBLE * (1 - 2 * (view_number + 0.5::DOUBLE) / 128) AS ey, {_X} * sin(view_number * {_GOLDEN!r}::DOUBLE) AS ez"
_CAND = """WITH e AS (SELECT row_id, unnest(list_zip(candidate_view_ids, candidate_marginal_gains)) AS p FROM method_steps),
c AS (SELECT row_id, p[1] AS view_id, max(p[2]) AS gain FROM e WHERE p[1] IS NOT NULL AND p[2] >= 0 GROUP BY ALL)
"""
_CELL = ", ".join(f"floor({c} / {{0}}::DOUBLE)::BIGINT AS v{c}" for c in "xyz")

_REST = """, cov AS (SELECT w.obj, w.view_number, list(w.voxel) AS vs FROM w LEFT JOIN cv ON w.obj = cv.obj AND w.voxel = cv.voxel WHERE cv.voxel IS NULL GROUP BY ALL)
"""

SQL = {
    "max_coverage": _COVER + greedy_sql(_BEST, steps=3) + "SELECT obj, count(*) AS n_views, max(n_covered) AS n_covered FROM pk GROUP BY 1",
    "residual_cover": _VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + _REST + greedy_sql(_BEST) + "SELECT obj, step, view_number, gain, n_covered FROM pk",
    "farthest_views": _VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", ps AS (SELECT obj, view_number, {_EYE.format(r=1.0)} FROM (SELECT DISTINCT obj, view_number FROM w WHERE view_number BETWEEN 0 AND 127)),
fp AS (SELECT obj, view_number, ex, ey, ez, 'inf'::DOUBLE AS gap, 0 AS place FROM ps
UNION ALL SELECT obj, view_number, ex, ey, ez, least(gap, round(sqrt((ex - fx) * (ex - fx) + (ey - fy) * (ey - fy) + (ez - fz) * (ez - fz)), 9)), place + 1 FROM (
  SELECT *, first_value(ex) OVER o AS fx, first_value(ey) OVER o AS fy, first_value(ez) OVER o AS fz FROM fp WINDOW o AS (PARTITION BY obj ORDER BY gap DESC, view_number)) WHERE place < 3)
SELECT obj, place, view_number, CASE WHEN isfinite(gap) THEN round(gap, 6) END AS gap FROM (SELECT *, row_number() OVER (PARTITION BY obj, place ORDER BY gap DESC, view_number) AS k FROM fp) WHERE k = 1 AND gap > 0""",
    "open_path": f"""WITH RECURSIVE s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk FROM method_steps WHERE covered_voxel_count IS NOT NULL)
  WHERE rk = 1 AND oracle_nbv_view_id BETWEEN 0 AND 127),
o AS (SELECT run_id, start_view_id, oracle_nbv_view_id AS view_number, min(step_id) AS step_id FROM s GROUP BY ALL),
nd AS (SELECT run_id, start_view_id, row_number() OVER (PARTITION BY run_id, start_view_id ORDER BY step_id, view_number) - 1 AS idx,
  count(*) OVER (PARTITION BY run_id, start_view_id) AS n, {_EYE.format(r=1.0)} FROM o),
pa AS (SELECT run_id, start_view_id, n, [idx] AS seen, 0.0::DOUBLE AS cost, ex, ey, ez FROM nd WHERE idx = 0
UNION ALL SELECT pa.run_id, pa.start_view_id, pa.n, list_append(seen, nd.idx),
  round(cost + sqrt((pa.ex - nd.ex) * (pa.ex - nd.ex) + (pa.ey - nd.ey) * (pa.ey - nd.ey) + (pa.ez - nd.ez) * (pa.ez - nd.ez)), 9), nd.ex, nd.ey, nd.ez
  FROM pa JOIN nd ON pa.run_id = nd.run_id AND pa.start_view_id = nd.start_view_id WHERE NOT list_contains(seen, nd.idx))
SELECT run_id, start_view_id, n AS n_nodes, round(min(cost), 6) AS cost, 'exact' AS method FROM pa WHERE len(seen) = n GROUP BY ALL""",
    "stop_reasons": """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk FROM method_steps WHERE covered_voxel_count IS NOT NULL) WHERE rk = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id ORDER BY step_id DESC) AS k, count(*) OVER (PARTITION BY run_id, start_view_id) AS n FROM s)
SELECT CASE WHEN covered_ratio >= 0.999 THEN 'full_coverage' WHEN coalesce(oracle_nbv_gain, 0) <= 0 THEN 'no_gain' WHEN oracle_nbv_view_id IS NULL THEN 'no_view'
WHEN n >= 6 THEN 'budget' ELSE 'cut_off' END AS reason, count(*) AS n_runs FROM l WHERE k = 1 GROUP BY 1""",
    "fallback_order": "WITH r AS (" + SEQUENCE_SQL["replay"] + """), x AS (SELECT run_id, start_view_id, view_id, place AS p FROM r
UNION ALL SELECT run_id, start_view_id, v, NULL FROM (SELECT DISTINCT run_id, start_view_id FROM r), (SELECT unnest(range(128))::INTEGER AS v))
SELECT run_id, start_view_id, view_id, row_number() OVER (PARTITION BY run_id, start_view_id ORDER BY p NULLS LAST, view_id)::INTEGER AS place,
CASE WHEN p IS NULL THEN 'fallback' ELSE 'replay' END AS origin FROM (SELECT *, count(p) OVER (PARTITION BY run_id, start_view_id, view_id) AS c FROM x) WHERE p IS NOT NULL OR c = 0""",
    "top_examples": """WITH b AS (SELECT pool_type, member_id, observation_saturation_view_num AS b FROM split_members WHERE observation_saturation_view_num IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY pool_type ORDER BY b, member_id)::INTEGER AS lo, row_number() OVER (PARTITION BY pool_type ORDER BY b DESC, member_id)::INTEGER AS hi FROM b)
SELECT 'low' AS "end", pool_type, lo AS k, member_id FROM r WHERE lo <= 5 UNION ALL SELECT 'high', pool_type, hi, member_id FROM r WHERE hi <= 5""",
    "tiled_points": POINTS_SQL + """, q AS (SELECT DISTINCT obj, x, y, z FROM points), n AS (SELECT obj, count(*) AS n FROM q GROUP BY obj)
SELECT obj, 2048::BIGINT AS n_rows, least(n, 2048) AS n_points, ceil(2048 / n::DOUBLE)::BIGINT AS first_rows FROM n""",
    "topk_accuracy": _CAND + """, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gain DESC, view_id) AS rank FROM c)
SELECT count(*) AS n, round(avg(coalesce((rank <= 1)::INTEGER, 0)), 6) AS top1, round(avg(coalesce((rank <= 3)::INTEGER, 0)), 6) AS top3, round(avg(coalesce((rank <= 5)::INTEGER, 0)), 6) AS top5
FROM method_steps m LEFT JOIN r ON m.row_id = r.row_id AND m.oracle_nbv_view_id = r.view_id WHERE oracle_nbv_view_id IS NOT NULL""",
    "bucket_quotas": """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk FROM method_steps WHERE covered_voxel_count IS NOT NULL) WHERE rk = 1 AND oracle_nbv_gain > 0),
p AS (SELECT step_id, count(*) AS n, avg(oracle_nbv_gain) AS gain FROM s GROUP BY 1), b AS (SELECT gain AS gain0 FROM p WHERE step_id = 0)
SELECT step_id, n, round(gain, 6) AS gain, least(n, ceil(round(100 / gain0 * gain, 9)))::BIGINT AS quota FROM p, b""",
    "occupancy_map": POINTS_SQL + f""", v AS (SELECT DISTINCT obj, view_number, {_CELL.format(0.5)} FROM points),
h AS (SELECT obj, vx, vy, vz, list(view_number) AS hits FROM v GROUP BY ALL), o AS (SELECT obj, list_sort(list(DISTINCT view_number)) AS views FROM v GROUP BY obj),
q AS (SELECT h.obj, list_reduce(list_prepend(0.0::DOUBLE, [CASE WHEN list_contains(hits, w) THEN 0.85::DOUBLE ELSE -0.4::DOUBLE END for w in views]), lambda s, d: greatest(-2.0::DOUBLE, least(3.5::DOUBLE, s + d))) AS odds FROM h JOIN o ON h.obj = o.obj),
p AS (SELECT obj, 1 / (1 + exp(-odds)) AS p FROM q)
SELECT obj, CASE WHEN p <= 0.45 THEN 'free' WHEN p >= 0.65 THEN 'occupied' ELSE 'unknown' END AS class, count(*) AS n_cells, round(sum(-p * ln(p) - (1 - p) * ln(1 - p)), 5) AS entropy FROM p GROUP BY ALL""",
    "ray_walk": POINTS_SQL + f""", pv AS (SELECT * FROM points WHERE view_number BETWEEN 0 AND 127), oc AS (SELECT DISTINCT obj, {_CELL.format(0.25)} FROM pv),
e AS (SELECT *, {_EYE.format(r=2.0)} FROM (SELECT DISTINCT obj, view_number FROM pv)),
d AS (SELECT obj, view_number, ex * cos(0.1::DOUBLE) + ez * sin(0.1::DOUBLE) AS dx, ey AS dy, ez * cos(0.1::DOUBLE) - ex * sin(0.1::DOUBLE) AS dz, unnest(range(96)) AS step FROM e),
w AS (SELECT obj, view_number, step, round(dx * (1 - (step + 0.5::DOUBLE) / 64), 9) AS x, round(dy * (1 - (step + 0.5::DOUBLE) / 64), 9) AS y, round(dz * (1 - (step + 0.5::DOUBLE) / 64), 9) AS z FROM d),
c AS (SELECT obj, view_number, step, {_CELL.format(0.25)} FROM w),
fh AS (SELECT c.obj, c.view_number, min(step) AS first_hit FROM c JOIN oc ON c.obj = oc.obj AND c.vx = oc.vx AND c.vy = oc.vy AND c.vz = oc.vz GROUP BY ALL)
SELECT e.obj, e.view_number, first_hit FROM e LEFT JOIN fh ON e.obj = fh.obj AND e.view_number = fh.view_number""",
}
