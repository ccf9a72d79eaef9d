"""Point-set, pose and path queries over cached points, view ids and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewmill.functions.scalar import binary_entropy, number, occupancy_class, ramp, sigmoid
from viewmill.operators.aggregates import exact_percentiles, long_form
from viewmill.operators.compact import cache_members
from viewmill.operators.geometry import (
    covered_points,
    frontier_level,
    fuse,
    hits_box,
    occupied,
    project,
    safe_distance,
    set_distance,
    sphere_pose,
    voxel_keys,
    with_rotation,
)
from viewmill.operators.joins import nearest
from viewmill.plans.coverage import cache_points
from viewmill.plans.records import POINTS_SQL
from viewmill.plans.sequences import run_steps
from viewmill.session import table


def voxel_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean point and number of points of every occupied cell of each object."""
    cells = fuse(cache_points(spark, sf_dir), ["obj"], 0.5)
    return cells.select("obj", "vx", "vy", "vz", *(F.round(c, 6).alias(c) for c in "xyz"), "n_points")


def voxel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupied(cache_points(spark, sf_dir), ["obj"], 0.25)


def nn_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the points of each object's odd views that lie within 0.3 of a point of its even views."""
    points = cache_points(spark, sf_dir).select("obj", "view_number", *"xyz")
    ident = F.xxhash64("view_number", *"xyz").alias("pid")
    odd = points.where("view_number % 2 = 1").select("obj", ident, *"xyz")
    hit = covered_points(odd, points.where("view_number % 2 = 0"), ["obj"], "pid", 0.3)
    n = odd.groupBy("obj").agg(F.count(F.lit(1)).alias("n_points"))
    k = hit.groupBy("obj").agg(F.count(F.lit(1)).alias("n_covered"))
    out = n.join(k, "obj", "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0)))
    return out.withColumn("ratio", F.round(F.col("n_covered") / F.col("n_points"), 6))


def chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chamfer distance between each cached view and the object's next one (both are one record's points)."""
    known = cache_members(table(spark, sf_dir, "view_cache_files")).where("identified")
    obj = F.element_at(F.split("cache_dir", "/"), -1).alias("obj")
    clouds = known.groupBy(obj, "view_number").agg(F.min_by("points", "file_id").alias("points"))
    w = Window.partitionBy("obj").orderBy("view_number")
    pairs = clouds.withColumns({"next_view": F.lead("view_number").over(w), "other": F.lead("points").over(w)}).where("next_view is not null")
    a, b = F.col("points"), F.col("other")
    return pairs.select("obj", "view_number", "next_view", F.round(set_distance(a, b) + set_distance(b, a), 6).alias("chamfer"))


def frontier26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each object by the number of occupied cells around them."""
    cells = voxel_keys(cache_points(spark, sf_dir), 0.5).select("obj", "vx", "vy", "vz").distinct()
    return frontier_level(cells, ["obj"]).groupBy("obj", "level").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_neighbours").alias("n_neighbours"))


def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and largest radius of each object's points."""
    points = cache_points(spark, sf_dir).select("obj", *"xyz").distinct()
    centre = points.groupBy("obj").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    r = F.sqrt(sum((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"))
    out = points.join(centre, "obj").groupBy("obj").agg(*(F.first(f"m{c}").alias(f"m{c}") for c in "xyz"), F.max(r).alias("r"))
    scale = F.when(F.col("r") > 0, F.col("r")).otherwise(1.0)
    return out.select("obj", *(F.round(f"m{c}", 6).alias(f"c{c}") for c in "xyz"), F.round(scale, 6).alias("scale"))


def path_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each run's way over the views it took, around the object's unit sphere."""
    steps = run_steps(spark, sf_dir).where("oracle_nbv_view_id between 0 and 127")
    posed = steps.withColumns(sphere_pose(F.col("oracle_nbv_view_id"), 128, 1.5))
    w = Window.partitionBy("run_id", "start_view_id").orderBy("step_id")
    before = posed.withColumns({f"p{c}": F.lag(c).over(w) for c in "xyz"})
    leg = safe_distance([F.col(f"p{c}") for c in "xyz"], [F.col(c) for c in "xyz"], 1.0)
    legs = before.withColumn("leg", F.when(F.col("px").isNotNull(), leg).otherwise(0.0))
    run = F.sum("leg").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return legs.select("run_id", "start_view_id", "step_id", F.round("leg", 6).alias("leg"), F.round(run, 6).alias("cost"))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each cached view seen in an image of 64 pixels from the view's own pose: pixels and depth range."""
    points = cache_points(spark, sf_dir).where("view_number between 0 and 127")
    ids = points.select("view_number").distinct()  # at most 128
    poses = with_rotation(ids.withColumns({f"e{c}": v for c, v in sphere_pose(F.col("view_number"), 128, 3.0).items()}), ["ex", "ey", "ez"], F.lit(0.0))
    posed = points.join(F.broadcast(poses), "view_number")
    eye, rotation = [F.col(f"e{c}") for c in "xyz"], [F.col(f"r{i}") for i in range(9)]
    u, v, z = project([F.col(c) for c in "xyz"], eye, rotation, 64, 77.25)
    seen = posed.select("obj", "view_number", u.alias("u"), v.alias("v"), z.alias("depth")).where("depth is not null")
    return seen.groupBy("view_number").agg(
        F.count(F.lit(1)).alias("n_points"), F.count_distinct("obj", "u", "v").alias("n_pixels"), F.round(F.min("depth"), 5).alias("nearest"), F.round(F.max("depth"), 5).alias("farthest")
    )


def box_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do rays from each point away from the x axis meet the cube around the middle?"""
    points = cache_points(spark, sf_dir)
    hit = hits_box([F.col(c) for c in "xyz"], [F.lit(1.0), F.col("y") * 0.1, F.lit(0.0)], -0.25, 0.25)
    return points.groupBy("view_number").agg(F.count_if(hit).alias("n_hits"), F.count(F.lit(1)).alias("n_rays"))


def entropy_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy of each cell (share of the object's views that see it) by class, with entropy and weights."""
    cells = voxel_keys(cache_points(spark, sf_dir), 0.5).select("obj", "view_number", "vx", "vy", "vz").distinct()
    views = cells.groupBy("obj").agg(F.count_distinct("view_number").alias("n_views"))
    p = cells.groupBy("obj", "vx", "vy", "vz").agg(F.count(F.lit(1)).alias("k")).join(views, "obj").withColumn("p", F.col("k") / F.col("n_views"))
    return p.groupBy(occupancy_class(F.col("p")).alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(binary_entropy(F.col("p"))), 6).alias("entropy"),
        F.round(F.avg(ramp(F.col("p"), 0.2, 0.8)), 6).alias("ramp"), F.round(F.avg(sigmoid(F.col("p") * 4 - 2)), 6).alias("weight"),
    )


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of each split scaled to 0..255 between their 1st and 99th percentile; counts by value."""
    rows = table(spark, sf_dir, "split_members").select("split_name", number(F.col("area")).alias("area")).where("area is not null")
    cuts = exact_percentiles(long_form(rows, ["area"], ["split_name"]), ["split_name"], "x", [0.01, 0.99])
    ends = cuts.groupBy("split_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.col("hi") - F.col("lo")
    unit = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("area") - F.col("lo")) / span))).otherwise(1.0)
    out = rows.join(F.broadcast(ends), "split_name").select("split_name", F.floor(unit * 255).cast("int").alias("value"))
    return out.groupBy("split_name", "value").agg(F.count(F.lit(1)).alias("n"))


def knn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight nearest other vectors for every vector whose id 20 divides: mean distance and density."""
    rows = table(spark, sf_dir, "embeddings")
    out = nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", k=9, metric="near").where("query_id != id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = out.withColumn("rank", F.row_number().over(w)).where("rank <= 8")
    d = F.avg(F.sqrt(F.greatest(-F.col("score"), F.lit(0.0))))
    per = near.groupBy("query_id").agg(F.round(d, 5).alias("mean_distance"), F.max("id").alias("largest_id"))
    density = 1 / (F.col("mean_distance") + 1e-6)
    top = per.agg(F.max(density).alias("top"))
    return per.join(F.broadcast(top)).select("query_id", "mean_distance", "largest_id", F.round(density / F.col("top"), 4).alias("density"))


QUERIES = {f.__name__: f for f in (
    voxel_fuse, voxel_count, nn_coverage, chamfer, frontier26, normalise, path_cost, projected, box_hits, entropy_class, robust_scale, knn8,
)}

_V = ", ".join(f"floor({c} / {{0}}::DOUBLE)::BIGINT AS v{c}" for c in "xyz")
_POSE = "{r}::DOUBLE * sqrt(1 - pow(1 - 2 * ({i} + 0.5::DOUBLE) / 128, 2)) * cos({i} * (pi() * (3 - sqrt(5.0::DOUBLE)))) AS {p}x, {r}::DOUBLE * (1 - 2 * ({i} + 0.5::DOUBLE) / 128) AS {p}y, {r}::DOUBLE * sqrt(1 - pow(1 - 2 * ({i} + 0.5::DOUBLE) / 128, 2)) * sin({i} * (pi() * (3 - sqrt(5.0::DOUBLE)))) AS {p}z"
_STEPS = """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk
  FROM method_steps WHERE covered_voxel_count IS NOT NULL) WHERE rk = 1 AND oracle_nbv_view_id BETWEEN 0 AND 127)"""
_NEAR = "list_aggregate(list_transform({a}, lambda p: list_min(list_transform({b}, lambda q: (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)))), 'sum') / len({a})"
_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"

SQL = {
    "voxel_fuse": POINTS_SQL + f" SELECT obj, vx, vy, vz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n_points FROM (SELECT obj, x, y, z, {_V.format(0.5)} FROM points) GROUP BY obj, vx, vy, vz",
    "voxel_count": POINTS_SQL + f" SELECT obj, count(DISTINCT (vx, vy, vz)) AS n_cells FROM (SELECT obj, {_V.format(0.25)} FROM points) GROUP BY obj",
    "nn_coverage": POINTS_SQL + """, o AS (SELECT DISTINCT obj, view_number, x, y, z FROM points WHERE view_number % 2 = 1), e AS (SELECT * FROM points WHERE view_number % 2 = 0),
h AS (SELECT o.*, EXISTS (SELECT 1 FROM e WHERE e.obj = o.obj AND (e.x - o.x) * (e.x - o.x) + (e.y - o.y) * (e.y - o.y) + (e.z - o.z) * (e.z - o.z) < 0.3::DOUBLE * 0.3::DOUBLE) AS hit FROM o)
SELECT obj, count(*) AS n_points, count(*) FILTER (hit) AS n_covered, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS ratio FROM h GROUP BY obj""",
    "chamfer": POINTS_SQL + f""", c AS (SELECT split_part(cache_dir, '/', -1) AS obj, view_number, arg_min(pts, file_id) AS a FROM k GROUP BY ALL),
n AS (SELECT *, lead(view_number) OVER w AS next_view, lead(a) OVER w AS b FROM c WINDOW w AS (PARTITION BY obj ORDER BY view_number))
SELECT obj, view_number, next_view, round({_NEAR.format(a='a', b='b')} + {_NEAR.format(a='b', b='a')}, 6) AS chamfer FROM n WHERE next_view IS NOT NULL""",
    "frontier26": POINTS_SQL + f""", v AS (SELECT DISTINCT obj, {_V.format(0.5)} FROM points),
n AS (SELECT a.obj, a.vx, a.vy, a.vz, count(b.obj) AS k FROM v a LEFT JOIN v b ON a.obj = b.obj AND abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1
  AND NOT (a.vx = b.vx AND a.vy = b.vy AND a.vz = b.vz) GROUP BY ALL)
SELECT obj, CASE WHEN k = 0 THEN 0 WHEN k = 26 THEN 2 ELSE 1 END AS level, count(*) AS n_cells, sum(k)::BIGINT AS n_neighbours FROM n GROUP BY ALL""",
    "normalise": POINTS_SQL + """, q AS (SELECT DISTINCT obj, x, y, z FROM points), m AS (SELECT obj, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM q GROUP BY obj)
SELECT q.obj, round(any_value(mx), 6) AS cx, round(any_value(my), 6) AS cy, round(any_value(mz), 6) AS cz,
round(CASE WHEN max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) > 0 THEN max(sqrt((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) ELSE 1.0 END, 6) AS scale
FROM q JOIN m ON q.obj = m.obj GROUP BY q.obj""",
    "path_cost": _STEPS + f""", p AS (SELECT run_id, start_view_id, step_id, {_POSE.format(r=1.5, i='oracle_nbv_view_id', p='')} FROM s),
l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM p WINDOW w AS (PARTITION BY run_id, start_view_id ORDER BY step_id)),
a AS (SELECT *, sqrt(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2)) AS st, sqrt(px * px + py * py + pz * pz) AS ra, sqrt(x * x + y * y + z * z) AS rb,
  greatest(0, least(1, -(px * (x - px) + py * (y - py) + pz * (z - pz)) / greatest(pow(x - px, 2) + pow(y - py, 2) + pow(z - pz, 2), 1e-18))) AS t FROM l),
d AS (SELECT *, sqrt(pow(px + t * (x - px), 2) + pow(py + t * (y - py), 2) + pow(pz + t * (z - pz), 2)) >= 1 - 1e-9 AS miss,
  greatest(ra, 1) AS oa, greatest(rb, 1) AS ob, acos(greatest(-1, least(1, (x * px + y * py + z * pz) / greatest(ra * rb, 1e-18)))) AS ang FROM a),
f AS (SELECT run_id, start_view_id, step_id, CASE WHEN px IS NULL THEN 0.0::DOUBLE WHEN miss THEN st
  ELSE greatest(st, sqrt(oa * oa - 1) + sqrt(ob * ob - 1) + greatest(ang - acos(1 / oa) - acos(1 / ob), 0)) END AS leg FROM d)
SELECT run_id, start_view_id, step_id, round(leg, 6) AS leg, round(sum(leg) OVER (PARTITION BY run_id, start_view_id ORDER BY step_id), 6) AS cost FROM f""",
    "box_hits": POINTS_SQL + """, r AS (SELECT view_number, x, y, z, (-0.25 - x) AS a1, (0.25 - x) AS a2, y * 0.1::DOUBLE AS d FROM points),
t AS (SELECT *, abs(d) < 1e-12 AS flat, CASE WHEN abs(d) >= 1e-12 THEN (-0.25 - y) / d END AS b1, CASE WHEN abs(d) >= 1e-12 THEN (0.25 - y) / d END AS b2 FROM r)
SELECT view_number, count(*) FILTER (z BETWEEN -0.25 AND 0.25 AND NOT (flat AND NOT y BETWEEN -0.25 AND 0.25)
  AND greatest(least(a1, a2), CASE WHEN flat THEN -1e300 ELSE least(b1, b2) END) <= least(greatest(a1, a2), CASE WHEN flat THEN 1e300 ELSE greatest(b1, b2) END)
  AND least(greatest(a1, a2), CASE WHEN flat THEN 1e300 ELSE greatest(b1, b2) END) >= 0) AS n_hits, count(*) AS n_rays FROM t GROUP BY view_number""",
    "entropy_class": POINTS_SQL + f""", v AS (SELECT DISTINCT obj, view_number, {_V.format(0.5)} FROM points), n AS (SELECT obj, count(DISTINCT view_number) AS n FROM v GROUP BY obj),
p AS (SELECT v.obj, vx, vy, vz, count(*) / any_value(n)::DOUBLE AS p FROM v JOIN n ON v.obj = n.obj GROUP BY ALL),
q AS (SELECT p, greatest(least(p, 1 - 1e-9), 1e-9) AS q FROM p)
SELECT CASE WHEN p <= 0.45 THEN 'free' WHEN p >= 0.65 THEN 'occupied' ELSE 'unknown' END AS class, count(*) AS n, round(avg(-q * ln(q) - (1 - q) * ln(1 - q)), 6) AS entropy,
round(avg(greatest(0, least(1, (p - 0.2) / 0.6))), 6) AS ramp, round(avg(1 / (1 + exp(-(p * 4 - 2)))), 6) AS weight FROM q GROUP BY 1""",
    "robust_scale": """WITH r AS (SELECT split_name, area FROM split_members WHERE isfinite(area)),
e AS (SELECT split_name, quantile_cont(area, 0.01) AS lo, quantile_cont(area, 0.99) AS hi FROM r GROUP BY 1)
SELECT r.split_name, floor((CASE WHEN hi > lo THEN greatest(0, least(1, (area - lo) / (hi - lo))) ELSE 1 END) * 255)::INTEGER AS value, count(*) AS n
FROM r JOIN e ON r.split_name = e.split_name GROUP BY ALL""",
    "knn8": f"""WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_D2} AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT query_id, round(avg(sqrt(d)), 5) AS mean_distance, max(id) AS largest_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM d) WHERE r <= 8 GROUP BY 1)
SELECT query_id, mean_distance, largest_id, round((1 / (mean_distance + 1e-6)) / max(1 / (mean_distance + 1e-6)) OVER (), 4) AS density FROM k""",
}
