"""Coverage queries: views over voxels (cached view files) and suppliers over parts (line items)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewmill.functions.scalar import first_reason
from viewmill.operators.compact import cache_members
from viewmill.operators.cover import (
    argmax_within,
    coverage_ratio,
    greedy_cover,
    greedy_rollouts,
    marginal_gain,
    needed_voxels,
    seen_by_at_least,
    threshold_then_cheapest,
    utility,
)
from viewmill.operators.geometry import packed_voxel, voxel_keys
from viewmill.plans.records import POINTS_SQL
from viewmill.session import table, written

CELL = 0.25
OBJECT, VIEW, VOXEL = ["obj"], "view_number", "voxel"


def cache_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct points of each cached view: obj (the last folder), view_number, x, y, z.

    Parsed once and written, since most queries use them more than once.
    """
    known = cache_members(table(spark, sf_dir, "view_cache_files")).where("identified")
    obj = F.element_at(F.split("cache_dir", "/"), -1).alias("obj")
    return written(known.select(obj, "view_number", F.inline("points")).distinct(), "cache-points")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation obj, view_number, voxel."""
    cells = voxel_keys(cache_points(spark, sf_dir), CELL)
    return cells.select("obj", "view_number", packed_voxel("vx", "vy", "vz").alias("voxel")).distinct()


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()


def first_view(cov: DataFrame) -> DataFrame:
    return cov.groupBy("obj").agg(F.min("view_number").alias("view_number"))


def gain_over_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels each view adds to what the object's first view covers."""
    cov = views(spark, sf_dir)
    covered = cov.join(first_view(cov), ["obj", "view_number"], "left_semi").select("obj", "voxel")
    return marginal_gain(cov, covered, OBJECT, VIEW, VOXEL)


def supplier_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that each supplier adds to those of the first tenth of the suppliers."""
    cov = supply(spark, sf_dir).withColumn("all", F.lit(1))
    covered = cov.where("l_suppkey % 10 = 1").select("all", "l_partkey").distinct()
    return marginal_gain(cov, covered, ["all"], "l_suppkey", "l_partkey").select("l_suppkey", "gain")


def greedy_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cover of every object from its first view."""
    cov = views(spark, sf_dir)
    return greedy_cover(cov, OBJECT, VIEW, VOXEL, first_view(cov))


def rollouts_all_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cover of every object from every one of its views."""
    return greedy_rollouts(views(spark, sf_dir), OBJECT, VIEW, VOXEL)


def greedy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views needed and voxels covered for each object, counted by views; covered equals the object's voxels."""
    cov = views(spark, sf_dir)
    picks = greedy_cover(cov, OBJECT, VIEW, VOXEL).groupBy("obj").agg(F.count(F.lit(1)).alias("n_views"), F.max("n_covered").alias("n_covered"))
    size = cov.groupBy("obj").agg(F.count_distinct("voxel").alias("n_voxels"), F.count_distinct("view_number").alias("all_views"))
    return picks.join(size, "obj").select(
        (F.col("n_covered") == F.col("n_voxels")).alias("complete"), "n_views", (F.col("n_views") <= F.col("all_views")).alias("within")
    ).groupBy("complete", "within", "n_views").agg(F.count(F.lit(1)).alias("n_objects"))


def min_views_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of each object that two views or more see."""
    kept = seen_by_at_least(views(spark, sf_dir), OBJECT, VIEW, VOXEL, 2)
    return kept.groupBy("obj").agg(F.count_distinct("voxel").alias("n_voxels"), F.count(F.lit(1)).alias("n_rows"))


def union_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir).groupBy("obj").agg(F.count_distinct("voxel").alias("n_voxels"), F.count_distinct("view_number").alias("n_views"))


def selection_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each object's voxels that its even views cover."""
    cov = views(spark, sf_dir)
    return coverage_ratio(cov, cov.where("view_number % 2 = 0").select("obj", "view_number").distinct(), OBJECT, VIEW, VOXEL)


def needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels still to cover after the first view that an even view can give, counted for each object."""
    cov = views(spark, sf_dir)
    covered = cov.join(first_view(cov), ["obj", "view_number"], "left_semi").select("obj", "voxel")
    evens = cov.where("view_number % 2 = 0").select("obj", "view_number").distinct()
    return needed_voxels(cov, covered, evens, OBJECT, VIEW, VOXEL).groupBy("obj").agg(F.count(F.lit(1)).alias("n_needed"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate views of each step row with gain and a cost (distance of the ids around the ring of 128)."""
    rows = table(spark, sf_dir, "method_steps").select(
        "row_id", "start_view_id", F.explode(F.arrays_zip(F.col("candidate_view_ids").alias("id"), F.col("candidate_marginal_gains").alias("gain"))).alias("p")
    )
    ok = rows.where("p.id is not null and p.gain >= 0")
    apart = F.abs(F.col("p.id") - F.col("start_view_id"))
    return ok.groupBy("row_id", F.col("p.id").alias("view_id")).agg(
        F.max("p.gain").alias("gain"), F.max(F.least(apart, 128 - apart)).alias("cost")
    )


def utility_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate with the best balance of gain and cost of each step."""
    rows = candidates(spark, sf_dir)
    scored = rows.withColumn("utility", F.round(utility(F.col("gain"), F.col("cost"), ["row_id"], 0.3), 9))
    return argmax_within(scored, ["row_id"], "utility", "view_id").select("row_id", "view_id", F.round("utility", 6).alias("utility"))


def threshold_lexi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest candidate with at least nine tenths of the step's best gain."""
    return threshold_then_cheapest(candidates(spark, sf_dir), ["row_id"], "gain", "cost", "view_id", 0.9)


def oracle_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is the recorded oracle view a best candidate (largest gain, smallest id)? Reasons counted."""
    best = candidates(spark, sf_dir).groupBy("row_id").agg(F.max_by(F.struct("view_id", "gain"), F.struct(F.col("gain"), -F.col("view_id"))).alias("b"))
    rows = table(spark, sf_dir, "method_steps").select("row_id", "oracle_nbv_view_id", "oracle_nbv_gain", "visited_view_ids").join(best, "row_id", "left")
    reason = first_reason(
        [
            ("no_prediction", F.col("oracle_nbv_view_id").isNull()),
            ("out_of_range", ~F.col("oracle_nbv_view_id").between(0, 127)),
            ("visited", F.array_contains("visited_view_ids", F.col("oracle_nbv_view_id"))),
            ("no_candidates", F.col("b").isNull()),
            ("best", F.col("oracle_nbv_view_id") == F.col("b.view_id")),
            ("tied", F.col("oracle_nbv_gain") == F.col("b.gain")),
        ],
        "worse",
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-hot vector of visited views as text of 128 digits, and its number of ones."""
    rows = table(spark, sf_dir, "method_steps").where("visited_view_ids is not null")
    bits = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.array_contains("visited_view_ids", i).cast("int"))
    known = F.filter("visited_view_ids", lambda x: x.isNotNull())
    clean = rows.withColumn("visited_view_ids", known)
    return clean.select("row_id", F.array_join(F.transform(bits, lambda b: b.cast("string")), "").alias("state"), F.aggregate(bits, F.lit(0), lambda s, b: s + b).alias("n_ones"))


def ranked_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of each step whose id isn't divisible by 5, by gain then id."""
    w = Window.partitionBy("row_id").orderBy(F.desc("gain"), "view_id")
    rows = candidates(spark, sf_dir).where("view_id % 5 != 0").withColumn("rank", F.row_number().over(w))
    return rows.where("rank <= 3").select("row_id", "rank", "view_id", "gain")


QUERIES = {f.__name__: f for f in (
    supplier_gain, greedy_rollout, rollouts_all_starts, greedy_summary, min_views_filter, union_size, selection_ratio, needed, utility_argmax,
    threshold_lexi, oracle_agrees, state_vectors, ranked_feasible,
)} | {"marginal_gain": gain_over_first}

_VIEWS = POINTS_SQL + f""", w AS (SELECT DISTINCT obj, view_number,
  floor(x / {CELL}::DOUBLE)::BIGINT || ',' || floor(y / {CELL}::DOUBLE)::BIGINT || ',' || floor(z / {CELL}::DOUBLE)::BIGINT AS voxel FROM points),
f1 AS (SELECT obj, min(view_number) AS view_number FROM w GROUP BY obj),
cv AS (SELECT w.obj, w.voxel FROM w JOIN f1 ON w.obj = f1.obj AND w.view_number = f1.view_number)
"""
_CAND = """WITH e AS (SELECT row_id, start_view_id, unnest(list_zip(candidate_view_ids, candidate_marginal_gains)) AS p FROM method_steps),
c AS (SELECT row_id, p[1] AS view_id, max(p[2]) AS gain, max(least(abs(p[1] - start_view_id), 128 - abs(p[1] - start_view_id))) AS cost FROM e WHERE p[1] IS NOT NULL AND p[2] >= 0 GROUP BY ALL)
"""

#: cov: each view's voxels as a list. ``greedy(first, keys)`` follows the best view from the rows of ``first``.
_COVER = _VIEWS.replace("WITH ", "WITH RECURSIVE ", 1) + ", cov AS (SELECT obj, view_number, list(voxel) AS vs FROM w GROUP BY ALL)\n"


def greedy_sql(first: str, keys: str = "obj", steps: int = 1 << 30) -> str:
    return f""", pk AS ({first} UNION ALL
SELECT {keys}, step + 1, view_number, gain, n_covered + gain, list_concat(covered, new) FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gain DESC, view_number) AS k FROM (
    SELECT {", ".join("pk." + k for k in keys.split(", "))}, pk.step, c.view_number, pk.n_covered, pk.covered, list_filter(c.vs, lambda x: NOT list_contains(pk.covered, x)) AS new, len(new) AS gain
    FROM pk JOIN cov c ON pk.obj = c.obj WHERE pk.step + 1 < {steps}) WHERE gain > 0) WHERE k = 1)
"""


_FIRST = "SELECT c.obj, {0}0 AS step, c.view_number, len(vs) AS gain, len(vs) AS n_covered, vs AS covered FROM cov c"
_BEST = """SELECT obj, 0 AS step, view_number, len(vs) AS gain, len(vs) AS n_covered, vs AS covered FROM (
  SELECT *, row_number() OVER (PARTITION BY obj ORDER BY len(vs) DESC, view_number) AS k FROM cov) WHERE k = 1"""

SQL = {
    "greedy_rollout": _COVER + greedy_sql(_FIRST.format("") + " JOIN f1 ON c.obj = f1.obj AND c.view_number = f1.view_number") + "SELECT obj, step, view_number, gain, n_covered FROM pk",
    "rollouts_all_starts": _COVER + greedy_sql(_FIRST.format("c.view_number AS start, "), "obj, start") + "SELECT obj, start, step, view_number, gain, n_covered FROM pk",
    "greedy_summary": _COVER + greedy_sql(_BEST) + """, p AS (SELECT obj, count(*) AS n_views, max(n_covered) AS n_covered FROM pk GROUP BY 1),
u AS (SELECT obj, count(DISTINCT voxel) AS n_voxels, count(DISTINCT view_number) AS all_views FROM w GROUP BY 1)
SELECT n_covered = n_voxels AS complete, n_views <= all_views AS within, n_views, count(*) AS n_objects FROM p JOIN u USING (obj) GROUP BY ALL""",
    "marginal_gain": _VIEWS + """SELECT w.obj, w.view_number, count(DISTINCT CASE WHEN cv.voxel IS NULL THEN w.voxel END) AS gain
FROM w LEFT JOIN cv ON w.obj = cv.obj AND w.voxel = cv.voxel GROUP BY ALL""",
    "supplier_gain": """WITH c AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), d AS (SELECT DISTINCT l_partkey FROM c WHERE l_suppkey % 10 = 1)
SELECT l_suppkey, count(*) FILTER (d.l_partkey IS NULL) AS gain FROM c LEFT JOIN d ON c.l_partkey = d.l_partkey GROUP BY 1""",
    "min_views_filter": _VIEWS + "SELECT obj, count(*) AS n_voxels, sum(k)::BIGINT AS n_rows FROM (SELECT obj, voxel, count(DISTINCT view_number) AS k FROM w GROUP BY ALL) WHERE k >= 2 GROUP BY obj",
    "union_size": _VIEWS + "SELECT obj, count(DISTINCT voxel) AS n_voxels, count(DISTINCT view_number) AS n_views FROM w GROUP BY obj",
    "selection_ratio": _VIEWS + """SELECT obj, count(DISTINCT voxel) AS n_voxels, count(DISTINCT CASE WHEN view_number % 2 = 0 THEN voxel END) AS n_covered,
round(count(DISTINCT CASE WHEN view_number % 2 = 0 THEN voxel END)::DOUBLE / count(DISTINCT voxel), 6) AS ratio FROM w GROUP BY obj""",
    "needed": _VIEWS + """SELECT w.obj, count(DISTINCT w.voxel) AS n_needed FROM w LEFT JOIN cv ON w.obj = cv.obj AND w.voxel = cv.voxel
WHERE cv.voxel IS NULL AND view_number % 2 = 0 GROUP BY w.obj""",
    "utility_argmax": _CAND + """, u AS (SELECT row_id, view_id, round((1 - 0.3::DOUBLE) * gain / (CASE WHEN sum(gain) OVER w = 0 THEN 1 ELSE sum(gain) OVER w END)::DOUBLE
  - 0.3::DOUBLE * cost / (CASE WHEN sum(cost) OVER w = 0 THEN 1 ELSE sum(cost) OVER w END)::DOUBLE, 9) AS utility FROM c WINDOW w AS (PARTITION BY row_id)),
t AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY view_id) AS k FROM (SELECT *, max(utility) OVER (PARTITION BY row_id) AS best FROM u) WHERE utility >= best - 1e-12)
SELECT row_id, view_id, round(utility, 6) AS utility FROM t WHERE k = 1""",
    "threshold_lexi": _CAND + """, t AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY cost, gain DESC, view_id) AS k
FROM (SELECT *, max(gain) OVER (PARTITION BY row_id) AS best FROM c) WHERE gain + 1e-9 >= 0.9::DOUBLE * best) SELECT row_id, view_id, gain, cost FROM t WHERE k = 1""",
    "oracle_agrees": _CAND + """, b AS (SELECT row_id, view_id, gain FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gain DESC, view_id) AS k FROM c) WHERE k = 1)
SELECT CASE WHEN oracle_nbv_view_id IS NULL THEN 'no_prediction' WHEN oracle_nbv_view_id NOT BETWEEN 0 AND 127 THEN 'out_of_range'
WHEN list_contains(visited_view_ids, oracle_nbv_view_id) THEN 'visited' WHEN b.row_id IS NULL THEN 'no_candidates' WHEN oracle_nbv_view_id = b.view_id THEN 'best'
WHEN oracle_nbv_gain = b.gain THEN 'tied' ELSE 'worse' END AS reason, count(*) AS n FROM method_steps m LEFT JOIN b ON m.row_id = b.row_id GROUP BY 1""",
    "state_vectors": """SELECT row_id, array_to_string([CASE WHEN list_contains(visited_view_ids, i) THEN '1' ELSE '0' END for i in range(128)], '') AS state,
len(list_filter(range(128), lambda i: list_contains(visited_view_ids, i)))::INTEGER AS n_ones FROM method_steps WHERE visited_view_ids IS NOT NULL""",
    "ranked_feasible": _CAND + "SELECT row_id, rank, view_id, gain FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gain DESC, view_id)::INTEGER AS rank FROM c WHERE view_id % 5 <> 0) WHERE rank <= 3",
}
