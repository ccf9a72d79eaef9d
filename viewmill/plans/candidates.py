"""Candidate views, retry lists, joins over several relations and grids around occupied cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewmill.functions.scalar import error_word, label, number, overlap_quality, sigmoid
from viewmill.operators.aggregates import five_numbers_by_sets, null_safe
from viewmill.operators.cover import argmax_within, greedy_cover, marginal_gain
from viewmill.operators.filters import box_measures, keep_columns, retry_reason
from viewmill.operators.geometry import (
    back_projected,
    covered_points,
    dense_grid,
    finite_inside,
    frontier_level,
    frontier_weights,
    voxel_centre,
    voxel_keys,
)
from viewmill.operators.joins import restored_order, tolerance_anti
from viewmill.operators.path import open_paths
from viewmill.plans.coverage import _BEST, _VIEWS, OBJECT, VIEW, VOXEL, cache_points, first_view, greedy_sql, views
from viewmill.plans.records import POINTS_SQL
from viewmill.plans.relational import _OBJECTS, curves, objects
from viewmill.plans.sequences import run_steps
from viewmill.plans.shapes import SQL as SHAPE_SQL
from viewmill.plans.shapes import knn8
from viewmill.plans.stats import B, members
from viewmill.session import table, written

NEAR = 0.02  # tolerance of a coordinate
CLOSER = 0.1  # distance below which a point is seen
CELL = 0.25
PATH_VIEWS = 6


def retry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation rows to be tried again, with the first matching reason."""
    said = F.when(error_word(F.col("error")).isNotNull(), F.trim("error"))
    reason = retry_reason(said, F.col("load_ok"), exact=["MemoryError"], contains=["timeout"], pattern="empty (scene|mesh)$")
    return table(spark, sf_dir, "annotations").select("row_id", reason.alias("reason")).where("reason is not null")


def retry_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every failed row and every row that wasn't loaded, counted by reason."""
    reason = retry_reason(error_word(F.col("error")), F.col("load_ok"), all_failed=True, not_loaded=True)
    return table(spark, sf_dir, "annotations").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def kept_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept columns that exist, the object's under its usual name."""
    return keep_columns(table(spark, sf_dir, "split_members"), ["member_id", "uid", "no_such_column", "area", "volume"], {"uid": "object_uid"})


def derived_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box measures of each annotation."""
    names = ("e1", "e2", "e3", "bbox_area_ratio", "bbox_volume_ratio", "log_bbox_area_ratio", "euler_signed_norm")
    return box_measures(table(spark, sf_dir, "annotations")).select("row_id", *(F.round(c, 7).alias(c) for c in names))


def novel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each view that no point of the object's first view equals within a tolerance in each coordinate."""
    points = cache_points(spark, sf_dir)
    first = points.join(first_view(points), ["obj", "view_number"], "left_semi").select("obj", "x", "y", "z")
    left = tolerance_anti(points, first, ["obj"], ["x", "y", "z"], NEAR)
    return left.groupBy("obj", "view_number").agg(F.count(F.lit(1)).alias("n_new"))


def point_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each object by their distance from the origin in single precision, in sixteenths."""
    x, y, z = (F.col(c).cast("float") for c in "xyz")
    radius = F.sqrt((x * x + y * y + z * z).cast("double")).cast("float")
    points = cache_points(spark, sf_dir).select("obj", "x", "y", "z").distinct()
    return points.groupBy("obj", F.floor(radius * 16).alias("shell")).agg(F.count(F.lit(1)).alias("n_points"))


def non_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that go on: a gain, or voxels left over."""
    goes_on = (F.coalesce("oracle_nbv_gain", F.lit(0)) > 0) | (F.coalesce("residual_voxel_count", F.lit(0)) > 0)
    return table(spark, sf_dir, "method_steps").groupBy(goes_on.alias("goes_on")).agg(F.count(F.lit(1)).alias("n_rows"))


def clipped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each object within a box of half its size, and those left out (F16)."""
    inside = finite_inside(-0.5, 0.5)
    return cache_points(spark, sf_dir).groupBy("obj").agg(F.count_if(inside).alias("n_inside"), F.count_if(~inside).alias("n_outside"))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose last record has a fitted curve, with five of its columns."""
    kept = curves(spark, sf_dir).where("fit_type = 'lognormal_cdf'")
    review = kept.select("uid", "batch_id", "run_day", number(F.col("a_fit")).alias("a_fit"), "b_discrete", "gt_surface_voxel_count")
    return objects(spark, sf_dir).select("uid", "row_id").join(review, "uid")


def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with a curve and a place in a split, by shape, pool and split; those without a shape are left out."""
    shaped = objects(spark, sf_dir).select("uid", label(F.col("shape_type")).alias("shape")).where("shape is not null")
    placed = members(spark, sf_dir).select(F.lower(F.trim("uid")).alias("uid"), "split_name", "pool_type").distinct()
    both = shaped.join(curves(spark, sf_dir).select("uid", "b_discrete"), "uid").join(placed, "uid")
    return both.groupBy("shape", "split_name", "pool_type").agg(F.count(F.lit(1)).alias("n_objects"), F.count("b_discrete").alias("n_b"), F.sum("b_discrete").alias("sum_b"))


def unmatched_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects without a curve and curves without an object, by name."""
    left, right = objects(spark, sf_dir).select("uid"), curves(spark, sf_dir).select("uid")
    missing = left.join(right, "uid", "left_anti").withColumn("missing", F.lit("curve"))
    return missing.unionByName(right.join(left, "uid", "left_anti").withColumn("missing", F.lit("annotation")))


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in the order of their saturation records, those without any behind in their own order."""
    right = table(spark, sf_dir, "saturation").select(F.lower(F.trim("uid")).alias("uid"), "computed_at", "row_id")
    out = restored_order(objects(spark, sf_dir).select("uid", "row_id"), right, "uid", [F.col("computed_at"), F.col("row_id")], [F.asc("row_id")])
    return out.select("place", "uid", "row_id")


def stats_all_groupings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summaries of B by no, either and both of split and pool (A4)."""
    out = five_numbers_by_sets(members(spark, sf_dir).select("split_name", "pool_type", F.col(B).cast("double").alias("x")), ["split_name", "pool_type"])
    return out.select("grouping", "split_name", "pool_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "min", "p25", "median", "p75", "max")))


def case_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each run that any of four samples takes, once, with the samples that do."""
    steps = run_steps(spark, sf_dir)
    run = Window.partitionBy("run_id", "start_view_id")
    marked = steps.withColumns({"last": F.max("step_id").over(run), "best": F.max("oracle_nbv_gain").over(run)})
    rules = {"first": F.col("step_id") == 0, "last": F.col("step_id") == F.col("last"), "best_gain": F.col("oracle_nbv_gain") == F.col("best"), "half": F.col("covered_ratio") >= 0.5}
    samples = [marked.where(rule).select("run_id", "start_view_id", "step_id", F.lit(name).alias("sample")) for name, rule in rules.items()]
    union = samples[0]
    for s in samples[1:]:
        union = union.unionByName(s)
    return union.groupBy("run_id", "start_view_id", "step_id").agg(F.array_join(F.array_sort(F.collect_set("sample")), ";").alias("samples"))


def b_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B as the ceiling of the continuous value against the recorded one, by batch."""
    b = F.ceil(number(F.col("b_continuous")))
    state = F.when(b.isNull(), "no_value").when(F.col("b_discrete").isNull(), "not_recorded").when(b == F.col("b_discrete"), "equal").otherwise("differs")
    return table(spark, sf_dir, "saturation").groupBy("batch_id", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def voxel_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of each object's points from the middle of their cell."""
    cells = voxel_keys(cache_points(spark, sf_dir).select("obj", "x", "y", "z").distinct(), CELL).withColumns(voxel_centre(CELL))
    d = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0)))
    return cells.groupBy("obj").agg(F.count(F.lit(1)).alias("n_points"), F.round(F.avg(d), 6).alias("mean_offset"))


def depth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points taken as pixels of a 64 x 64 image with their z as depth, and back: points of each object by quarter, and their depth."""
    pixel = lambda a: F.floor((F.col(a) + 1) * 32)
    pixels = cache_points(spark, sf_dir).select("obj", pixel("x").alias("u"), pixel("y").alias("v"), F.col("z").alias("depth"))
    out = back_projected(pixels, 32.0, 32.0, 0.75)
    quarter = [(F.floor(F.col(a) * 4)).alias(f"q{a}") for a in "xy"]
    return out.groupBy("obj", *quarter).agg(F.count(F.lit(1)).alias("n_points"), F.round(F.sum("z"), 6).alias("depth"))


def view_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean point of each cached view."""
    return cache_points(spark, sf_dir).groupBy("obj", "view_number").agg(*(F.round(F.avg(a), 6).alias(a) for a in "xyz"))


def random_then_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six views of each object at random, and the shortest way over their centres from the first one on."""
    w = Window.partitionBy("obj").orderBy(F.md5(F.concat_ws("|", "obj", F.col("view_number").cast("string"))))
    idx = (F.row_number().over(w) - 1).alias("idx")
    nodes = view_centres(spark, sf_dir).select("obj", idx, "x", "y", "z").where(F.col("idx") < PATH_VIEWS)
    return open_paths(nodes, ["obj"]).select("obj", "n_nodes", F.round("cost", 5).alias("cost"))


def precovered_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that cover what the first view leaves open, and the shortest way over them from the first one on."""
    cov = written(views(spark, sf_dir), "views")
    first = first_view(cov)
    covered = cov.join(first, ["obj", "view_number"], "left_semi").select("obj", "voxel")
    picks = greedy_cover(cov.join(covered, ["obj", "voxel"], "left_anti"), OBJECT, VIEW, VOXEL)
    nodes = picks.select("obj", "view_number", (F.col("step") + 1).alias("idx")).unionByName(first.withColumn("idx", F.lit(0)))
    posed = nodes.join(view_centres(spark, sf_dir), ["obj", "view_number"]).select("obj", "idx", "x", "y", "z")
    return open_paths(posed, ["obj"]).select("obj", "n_nodes", F.round("cost", 5).alias("cost"))


def one_step_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each further view adds to the share of the object's points that its first view sees, and which adds most.

    A view that isn't on the ring of 128 is recorded as no candidate.
    """
    points = cache_points(spark, sf_dir)
    targets = points.select("obj", "x", "y", "z").distinct().withColumn("p", F.concat_ws("|", "x", "y", "z"))
    size = targets.groupBy("obj").agg(F.count(F.lit(1)).alias("n_points"))
    per_view = points.select("obj", "view_number").distinct().join(targets, "obj")
    hits = written(covered_points(per_view, points, ["obj", "view_number"], "p", CLOSER), "seen-points")
    first = first_view(points)
    seen = hits.join(first, ["obj", "view_number"], "left_semi").select("obj", "p")
    gains = marginal_gain(hits, seen, ["obj"], "view_number", "p").join(size, "obj")
    others = gains.join(first, ["obj", "view_number"], "left_anti")
    scored = others.select("obj", "view_number", F.round(F.col("gain") / F.col("n_points"), 9).alias("gain"), F.when(F.col("view_number").between(0, 127), "ok").otherwise("invalid").alias("status"))
    best = argmax_within(scored.where("status = 'ok'").select("obj", "view_number", "gain"), ["obj"], "gain", "view_number")
    chosen = best.select("obj", F.col("view_number").alias("b"))
    return scored.join(chosen, "obj", "left").select("obj", "view_number", "status", F.round("gain", 6).alias("gain"), F.coalesce(F.col("view_number") == F.col("b"), F.lit(False)).alias("is_best"))


def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further views scored by coverage and overlap with the first view; the weight follows the coverage so far."""
    cov = written(views(spark, sf_dir), "views")
    first = first_view(cov)
    seen = cov.join(first, ["obj", "view_number"], "left_semi").select("obj", "voxel")
    total = cov.groupBy("obj").agg(F.count_distinct("voxel").alias("n"))
    state = seen.groupBy("obj").agg(F.count(F.lit(1)).alias("n_seen")).join(total, "obj")
    sizes = cov.groupBy("obj", "view_number").agg(F.count(F.lit(1)).alias("size"))
    gains = marginal_gain(cov, seen, OBJECT, VIEW, VOXEL).join(sizes, ["obj", "view_number"]).join(state, "obj").join(first, ["obj", "view_number"], "left_anti")
    w = sigmoid(10 * (F.col("n_seen") / F.col("n") - 0.5))
    overlap = (F.col("size") - F.col("gain")) / F.col("size")
    score = w * (F.col("gain") / F.col("n")) + (1 - w) * overlap_quality(overlap)
    return gains.select("obj", "view_number", F.round(overlap, 6).alias("overlap"), F.round(score, 6).alias("score"))


def plan_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's fixed plan of views with a cursor: the next view after each step, and why the plan ends."""
    w = Window.partitionBy("run_id", "start_view_id").orderBy("step_id")
    steps = run_steps(spark, sf_dir).where("oracle_nbv_view_id is not null")
    after = F.lead("oracle_nbv_view_id").over(w)
    reason = F.when(after.isNotNull(), "").when(F.col("covered_ratio") >= 0.999, "covered").otherwise("plan_end")
    return steps.select("run_id", "start_view_id", "step_id", F.row_number().over(w).alias("cursor"), after.alias("next_view_id"), reason.alias("stop_reason"))


def checkpoint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered share at named checkpoints; it is computed once for each number of visited views."""
    cov = written(views(spark, sf_dir), "views")
    order = cov.select("obj", "view_number").distinct().withColumn("place", F.row_number().over(Window.partitionBy("obj").orderBy("view_number")))
    size = cov.groupBy("obj").agg(F.count_distinct("view_number").alias("n_views"), F.count_distinct("voxel").alias("n_voxels"))
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("k")) for n, k in (("first", 1), ("k2", 2), ("k4", 4), ("k8", 8), ("end", 1 << 30))))
    asked = size.select("obj", "n_views", "n_voxels", F.inline(names)).withColumn("visited", F.least("k", "n_views"))
    once = asked.select("obj", "visited").distinct()
    seen_at = cov.join(order, ["obj", "view_number"]).groupBy("obj", "voxel").agg(F.min("place").alias("place"))
    per = once.join(seen_at, "obj").where("place <= visited").groupBy("obj", "visited").agg(F.count(F.lit(1)).alias("n_covered"))
    return asked.join(per, ["obj", "visited"]).select("obj", "name", "visited", F.round(F.col("n_covered") / F.col("n_voxels"), 6).alias("ratio"))


def near_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each object's cells by their distance to the nearest cell with few neighbours."""
    cells = voxel_keys(cache_points(spark, sf_dir), CELL).select("obj", "vx", "vy", "vz").distinct()
    edge = frontier_level(cells, ["obj"]).where("n_neighbours <= 2")
    out = frontier_weights(cells, edge, ["obj"], 0.5, 3)
    return out.groupBy("obj").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("weight") > 0).alias("n_near"), F.round(F.sum("weight"), 6).alias("weight"))


def dense_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's bounding box of cells, unknown ones at one half: cells, known ones and the sum."""
    cells = voxel_keys(cache_points(spark, sf_dir), CELL).select("obj", "vx", "vy", "vz").distinct().withColumn("p", F.lit(1.0))
    grid = dense_grid(cells, ["obj"], "p", 0.5)
    return grid.groupBy("obj").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("p") == 1.0).alias("n_known"), F.sum("p").alias("total"))


def inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked vectors whose mean distance to their eight nearest is within 1.5 standard deviations above the mean."""
    rows = written(knn8(spark, sf_dir).select("query_id", "mean_distance"), "mean-distances")
    limit = rows.agg((F.avg("mean_distance") + 1.5 * F.stddev_samp("mean_distance")).alias("most"))
    return null_safe(rows, limit, []).where("mean_distance <= most").select("query_id", "mean_distance")


QUERIES = {f.__name__: f for f in (
    retry_list, retry_all, kept_fields, derived_geometry, novel_points, point_radius, non_terminal, clipped_points, reviewed, three_way, unmatched_uids, restored,
    stats_all_groupings, case_union, b_ceil, voxel_offsets, depth_points, random_then_path, precovered_path, one_step_gain, boundary_scores,
    plan_cursor, checkpoint_metrics, near_frontier, dense_cells, inliers,
)}

_WORD = "CASE WHEN lower(trim(error)) IN ('', 'nan', 'none', 'null', 'na', 'n/a') THEN NULL ELSE trim(error) END"
_C = ", ".join(f"floor({c} / {CELL}::DOUBLE)::BIGINT AS v{c}" for c in "xyz")
_CELLS = POINTS_SQL + f", c AS (SELECT DISTINCT obj, {_C} FROM points)\n"
_D = "sqrt((pa.x - nd.x) * (pa.x - nd.x) + (pa.y - nd.y) * (pa.y - nd.y) + (pa.z - nd.z) * (pa.z - nd.z))"
_STEPS = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk FROM method_steps WHERE covered_voxel_count IS NOT NULL) WHERE rk = 1)"
_CENTRES = "vc AS (SELECT obj, view_number, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM points GROUP BY ALL)"
#: All ways over nd (obj, idx, n, x, y, z) from idx 0 on.
_WAYS = f"""pa AS (SELECT obj, n, [idx] AS seen, 0.0::DOUBLE AS cost, x, y, z FROM nd WHERE idx = 0
UNION ALL SELECT pa.obj, pa.n, list_append(seen, nd.idx), round(cost + {_D}, 9), nd.x, nd.y, nd.z FROM pa JOIN nd ON pa.obj = nd.obj WHERE NOT list_contains(seen, nd.idx))
SELECT obj, n AS n_nodes, round(min(cost), 5) AS cost FROM pa WHERE len(seen) = n GROUP BY ALL"""
_FIVE = ", ".join(f"round({e}, 6) AS {n}" for n, e in {"mean": "avg(x)", "min": "min(x)", "p25": "quantile_cont(x, 0.25)", "median": "quantile_cont(x, 0.5)", "p75": "quantile_cont(x, 0.75)", "max": "max(x)"}.items())
KNN_SQL = SHAPE_SQL["knn8"]

SQL = {
    "retry_list": f"""SELECT row_id, CASE WHEN e = 'MemoryError' THEN 'error=MemoryError' WHEN contains(e, 'timeout') THEN 'contains=timeout'
WHEN regexp_matches(e, 'empty (scene|mesh)$') THEN 'matches=empty (scene|mesh)$' END AS reason FROM (SELECT row_id, {_WORD} AS e FROM annotations) WHERE reason IS NOT NULL""",
    "retry_all": f"""SELECT CASE WHEN e IS NOT NULL THEN 'all_failed' WHEN NOT coalesce(load_ok, false) THEN 'not_loaded' END AS reason, count(*) AS n
FROM (SELECT load_ok, {_WORD} AS e FROM annotations) GROUP BY 1""",
    "derived_geometry": """WITH b AS (SELECT *, list_sort([CASE WHEN isfinite(v) THEN v END for v in bbox_extent], 'DESC', 'NULLS LAST') AS e FROM annotations),
c AS (SELECT *, e[1] AS e1, e[2] AS e2, e[3] AS e3, CASE WHEN isfinite(area) AND area >= 0 THEN area END AS ar, CASE WHEN isfinite(volume) THEN abs(volume) END AS vo FROM b),
d AS (SELECT *, 2 * (e1 * e2 + e1 * e3 + e2 * e3) AS su, e1 * e2 * e3 AS bv, ln(1 + greatest(face_count, 0)::DOUBLE) AS lf FROM c),
r AS (SELECT *, CASE WHEN su > 1e-12 THEN ar / su END AS ra, CASE WHEN bv > 1e-12 THEN vo / bv END AS rv FROM d)
SELECT row_id, round(e1, 7) AS e1, round(e2, 7) AS e2, round(e3, 7) AS e3, round(ra, 7) AS bbox_area_ratio, round(rv, 7) AS bbox_volume_ratio, round(ln(1 + ra), 7) AS log_bbox_area_ratio,
round(CASE WHEN lf > 1e-12 THEN euler_number / lf END, 7) AS euler_signed_norm FROM r""",
    "kept_fields": "SELECT member_id, uid AS object_uid, area, volume FROM split_members",
    "novel_points": POINTS_SQL + f""", fv AS (SELECT obj, min(view_number) AS v FROM points GROUP BY 1), b AS (SELECT p.obj, x, y, z FROM points p JOIN fv ON p.obj = fv.obj AND p.view_number = fv.v)
SELECT p.obj, p.view_number, count(*) AS n_new FROM points p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.obj = p.obj AND abs(b.x - p.x) <= {NEAR}::DOUBLE AND abs(b.y - p.y) <= {NEAR}::DOUBLE AND abs(b.z - p.z) <= {NEAR}::DOUBLE) GROUP BY ALL""",
    "point_radius": POINTS_SQL + """, q AS (SELECT DISTINCT obj, x, y, z FROM points)
SELECT obj, floor(sqrt((x::FLOAT * x::FLOAT + y::FLOAT * y::FLOAT + z::FLOAT * z::FLOAT)::DOUBLE)::FLOAT * 16)::BIGINT AS shell, count(*) AS n_points FROM q GROUP BY ALL""",
    "non_terminal": "SELECT coalesce(oracle_nbv_gain, 0) > 0 OR coalesce(residual_voxel_count, 0) > 0 AS goes_on, count(*) AS n_rows FROM method_steps GROUP BY 1",
    "clipped_points": POINTS_SQL + """ SELECT obj, count(*) FILTER (abs(x) <= 0.5 AND abs(y) <= 0.5 AND abs(z) <= 0.5) AS n_inside,
count(*) FILTER (abs(x) > 0.5 OR abs(y) > 0.5 OR abs(z) > 0.5) AS n_outside FROM points GROUP BY 1""",
    "reviewed": _OBJECTS + """SELECT o.uid, o.row_id, s.batch_id, s.run_day, CASE WHEN isfinite(s.a_fit) THEN s.a_fit END AS a_fit, s.b_discrete, s.gt_surface_voxel_count
FROM o JOIN s ON o.uid = s.uid WHERE s.fit_type = 'lognormal_cdf'""",
    "three_way": _OBJECTS + r""", h AS (SELECT uid, regexp_replace(lower(regexp_replace(shape_type, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g') AS shape FROM o),
p AS (SELECT DISTINCT lower(trim(uid)) AS uid, split_name, pool_type FROM split_members)
SELECT shape, split_name, pool_type, count(*) AS n_objects, count(b_discrete) AS n_b, sum(b_discrete)::BIGINT AS sum_b
FROM h JOIN s ON h.uid = s.uid JOIN p ON h.uid = p.uid WHERE shape NOT IN ('', 'unknown', 'null', 'none') GROUP BY ALL""",
    "unmatched_uids": _OBJECTS + "SELECT uid, 'curve' AS missing FROM o WHERE uid NOT IN (SELECT uid FROM s) UNION ALL SELECT uid, 'annotation' FROM s WHERE uid NOT IN (SELECT uid FROM o)",
    "restored": _OBJECTS + """, r AS (SELECT uid, min(p) AS p FROM (SELECT lower(trim(uid)) AS uid, row_number() OVER (ORDER BY computed_at NULLS FIRST, row_id) AS p FROM saturation) GROUP BY 1)
SELECT row_number() OVER (ORDER BY p NULLS LAST, row_id) AS place, o.uid, o.row_id FROM o LEFT JOIN r ON o.uid = r.uid""",
    "stats_all_groupings": f"""WITH m AS (SELECT split_name, pool_type, {B}::DOUBLE AS x FROM split_members)
SELECT concat_ws(',', CASE WHEN grouping(split_name) = 0 THEN 'split_name' END, CASE WHEN grouping(pool_type) = 0 THEN 'pool_type' END) AS grouping, split_name, pool_type, count(x) AS n, {_FIVE}
FROM m GROUP BY GROUPING SETS ((), (split_name), (pool_type), (split_name, pool_type))""",
    "case_union": f"""WITH {_STEPS}, m AS (SELECT *, max(step_id) OVER w AS last, max(oracle_nbv_gain) OVER w AS best FROM s WINDOW w AS (PARTITION BY run_id, start_view_id)),
u AS (SELECT run_id, start_view_id, step_id, 'first' AS sample FROM m WHERE step_id = 0 UNION ALL SELECT run_id, start_view_id, step_id, 'last' FROM m WHERE step_id = last
UNION ALL SELECT run_id, start_view_id, step_id, 'best_gain' FROM m WHERE oracle_nbv_gain = best UNION ALL SELECT run_id, start_view_id, step_id, 'half' FROM m WHERE covered_ratio >= 0.5)
SELECT run_id, start_view_id, step_id, string_agg(sample, ';' ORDER BY sample) AS samples FROM u GROUP BY ALL""",
    "b_ceil": """SELECT batch_id, CASE WHEN b IS NULL THEN 'no_value' WHEN b_discrete IS NULL THEN 'not_recorded' WHEN b = b_discrete THEN 'equal' ELSE 'differs' END AS state, count(*) AS n
FROM (SELECT batch_id, b_discrete, CASE WHEN isfinite(b_continuous) THEN ceil(b_continuous) END AS b FROM saturation) GROUP BY ALL""",
    "voxel_offsets": POINTS_SQL + f""", q AS (SELECT DISTINCT obj, x, y, z FROM points), c AS (SELECT *, {_C} FROM q)
SELECT obj, count(*) AS n_points, round(avg(sqrt(pow(x - (vx + 0.5) * {CELL}, 2) + pow(y - (vy + 0.5) * {CELL}, 2) + pow(z - (vz + 0.5) * {CELL}, 2))), 6) AS mean_offset FROM c GROUP BY 1""",
    "depth_points": POINTS_SQL + """, q AS (SELECT obj, (floor((x + 1) * 32) + 0.5 - 32) / 32 * z AS x, (floor((y + 1) * 32) + 0.5 - 32) / 32 * z AS y, z FROM points WHERE z > 0 AND isfinite(z))
SELECT obj, floor(x * 4)::BIGINT AS qx, floor(y * 4)::BIGINT AS qy, count(*) AS n_points, round(sum(z), 6) AS depth FROM q WHERE abs(x) <= 0.75 AND abs(y) <= 0.75 AND z <= 0.75 GROUP BY ALL""",
    "random_then_path": POINTS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_CENTRES},
ro AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY md5(obj || '|' || view_number)) - 1 AS idx FROM vc), nd AS (SELECT *, count(*) OVER (PARTITION BY obj) AS n FROM ro WHERE idx < {PATH_VIEWS}),
{_WAYS}""",
    "precovered_path": _VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + """, cov AS (SELECT w.obj, w.view_number, list(w.voxel) AS vs FROM w LEFT JOIN cv ON w.obj = cv.obj AND w.voxel = cv.voxel WHERE cv.voxel IS NULL GROUP BY ALL)
""" + greedy_sql(_BEST) + f""", {_CENTRES}, ch AS (SELECT obj, view_number, step + 1 AS idx FROM pk UNION ALL SELECT obj, view_number, 0 FROM f1),
nd AS (SELECT ch.obj, idx, x, y, z, count(*) OVER (PARTITION BY ch.obj) AS n FROM ch JOIN vc ON ch.obj = vc.obj AND ch.view_number = vc.view_number),
{_WAYS}""",
    "one_step_gain": POINTS_SQL + f""", t AS (SELECT DISTINCT obj, x, y, z FROM points), fv AS (SELECT obj, min(view_number) AS v FROM points GROUP BY 1),
h AS (SELECT DISTINCT t.obj, t.x, t.y, t.z, p.view_number FROM t JOIN points p ON t.obj = p.obj AND (t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) + (t.z - p.z) * (t.z - p.z) < {CLOSER}::DOUBLE * {CLOSER}::DOUBLE),
o AS (SELECT h.*, h.view_number = fv.v AS own, max((h.view_number = fv.v)::INTEGER) OVER (PARTITION BY h.obj, h.x, h.y, h.z) AS before FROM h JOIN fv ON h.obj = fv.obj),
n AS (SELECT obj, count(*) AS n FROM t GROUP BY 1),
e AS (SELECT o.obj, o.view_number, round(count(*) FILTER (before = 0)::DOUBLE / any_value(n.n), 9) AS gain, CASE WHEN o.view_number BETWEEN 0 AND 127 THEN 'ok' ELSE 'invalid' END AS status
  FROM o JOIN n ON o.obj = n.obj WHERE NOT own GROUP BY o.obj, o.view_number),
b AS (SELECT obj, view_number FROM (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY gain DESC, view_number) AS r FROM e WHERE status = 'ok') WHERE r = 1)
SELECT e.obj, e.view_number, status, round(gain, 6) AS gain, coalesce(e.view_number = b.view_number, false) AS is_best FROM e LEFT JOIN b ON e.obj = b.obj""",
    "boundary_scores": _VIEWS + """, sz AS (SELECT obj, count(DISTINCT voxel)::DOUBLE AS n FROM w GROUP BY 1), sn AS (SELECT obj, count(*)::DOUBLE AS n_seen FROM cv GROUP BY 1),
e AS (SELECT w.obj, w.view_number, count(*)::DOUBLE AS size, count(*) FILTER (cv.voxel IS NULL)::DOUBLE AS gain FROM w LEFT JOIN cv ON w.obj = cv.obj AND w.voxel = cv.voxel GROUP BY ALL),
r AS (SELECT e.*, n, (size - gain) / size AS ov, 1 / (1 + exp(-10 * (n_seen / n - 0.5))) AS wt FROM e JOIN sz ON e.obj = sz.obj JOIN sn ON e.obj = sn.obj JOIN f1 ON e.obj = f1.obj WHERE e.view_number <> f1.view_number)
SELECT obj, view_number, round(ov, 6) AS overlap, round(wt * (gain / n) + (1 - wt) * CASE WHEN ov <= 0.4 THEN -6.25 * ov * ov + 5 * ov WHEN ov < 0.5 THEN 1 ELSE greatest(0, -4 * ov * ov + 4 * ov) END, 6) AS score FROM r""",
    "plan_cursor": f"""WITH {_STEPS}, p AS (SELECT *, lead(oracle_nbv_view_id) OVER w AS nx, row_number() OVER w AS cursor FROM s WHERE oracle_nbv_view_id IS NOT NULL
WINDOW w AS (PARTITION BY run_id, start_view_id ORDER BY step_id))
SELECT run_id, start_view_id, step_id, cursor::INTEGER AS cursor, nx AS next_view_id, CASE WHEN nx IS NOT NULL THEN '' WHEN covered_ratio >= 0.999 THEN 'covered' ELSE 'plan_end' END AS stop_reason FROM p""",
    "checkpoint_metrics": _VIEWS + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY obj ORDER BY view_number) AS place FROM w),
z AS (SELECT obj, count(DISTINCT view_number) AS n_views, count(DISTINCT voxel) AS n_voxels FROM w GROUP BY 1),
a AS (SELECT z.*, name, least(kk, n_views) AS visited FROM z, (VALUES ('first', 1), ('k2', 2), ('k4', 4), ('k8', 8), ('end', 1073741824)) AS c(name, kk))
SELECT a.obj, name, visited::INTEGER AS visited, round(count(DISTINCT r.voxel)::DOUBLE / any_value(n_voxels), 6) AS ratio FROM a JOIN r ON a.obj = r.obj AND r.place <= a.visited GROUP BY a.obj, name, visited""",
    "near_frontier": _CELLS + f""", nb AS (SELECT a.obj, a.vx, a.vy, a.vz, count(b.obj) AS nn FROM c a LEFT JOIN c b ON a.obj = b.obj AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1
  AND (a.vx <> b.vx OR a.vy <> b.vy OR a.vz <> b.vz) GROUP BY ALL),
d AS (SELECT c.obj, c.vx, c.vy, c.vz, min(CASE WHEN greatest(abs(c.vx - e.vx), abs(c.vy - e.vy), abs(c.vz - e.vz)) <= 3 THEN (c.vx - e.vx) * (c.vx - e.vx) + (c.vy - e.vy) * (c.vy - e.vy) + (c.vz - e.vz) * (c.vz - e.vz) END) AS d2
  FROM c LEFT JOIN (SELECT * FROM nb WHERE nn <= 2) e ON c.obj = e.obj GROUP BY ALL)
SELECT obj, count(*) AS n_cells, count(d2) AS n_near, round(sum(coalesce(exp(-0.25 * d2), 0)), 6) AS weight FROM d GROUP BY 1""",
    "inliers": "WITH k AS (" + KNN_SQL + """) SELECT query_id, mean_distance FROM (SELECT *, avg(mean_distance) OVER () + 1.5 * stddev_samp(mean_distance) OVER () AS most FROM k) WHERE mean_distance <= most""",
    "dense_cells": _CELLS + """SELECT obj, (max(vx) - min(vx) + 1) * (max(vy) - min(vy) + 1) * (max(vz) - min(vz) + 1) AS n_cells, count(*) AS n_known,
((max(vx) - min(vx) + 1) * (max(vy) - min(vy) + 1) * (max(vz) - min(vz) + 1) + count(*)) / 2.0::DOUBLE AS total FROM c GROUP BY 1""",
}
