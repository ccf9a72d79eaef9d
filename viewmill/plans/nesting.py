"""Arrays, maps and JSON: unnesting with positions, pivots by key, fallbacks and nested outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.functions.scalar import file_safe, safe_number
from viewmill.operators.compact import cache_members
from viewmill.plans.records import MEMBERS_SQL
from viewmill.plans.sequences import run_steps
from viewmill.session import table


def zipped_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate ids with gains by position up to the shorter list: pairs, nulls and total gain of each step row (K7)."""
    zipped = F.slice(
        F.arrays_zip(F.col("candidate_view_ids").alias("id"), F.col("candidate_marginal_gains").alias("gain")),
        1, F.least(F.size("candidate_view_ids"), F.size("candidate_marginal_gains")),
    )
    rows = table(spark, sf_dir, "method_steps").where("candidate_view_ids is not null and candidate_marginal_gains is not null")
    whole = F.filter("z", lambda p: p["id"].isNotNull() & p["gain"].isNotNull())
    return rows.withColumn("z", zipped).select(
        "row_id", F.size("z").alias("n_pairs"), (F.size("z") - F.size(whole)).alias("n_null"),
        F.aggregate(whole, F.lit(0).cast("long"), lambda s, p: s + p["gain"]).alias("total_gain"),
    )


def checkpoint_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of each user's largest value by event type, looked up by name with a fallback."""
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    maps = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))  # a few types each
    look = lambda k: F.col("m")[k]
    return maps.select(
        "user_id", F.size("m").alias("n_types"), look("purchase").alias("purchase"), F.coalesce(look("purchase"), look("click"), look("view")).alias("terminal")
    )


def props_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties of events parsed with a schema, pivoted to one column for each range of k (K3)."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.from_json("props", "k int").alias("p"))
    bands = {"low": (0, 33), "mid": (34, 66), "high": (67, 99)}
    return rows.groupBy("event_type").agg(
        *(F.round(F.avg(F.when(F.col("p.k").between(*b), F.col("value"))), 6).alias(f"avg_{n}") for n, b in bands.items()),
        F.count("p.k").alias("n_with_k"),
    )


def steps_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second visited view by position, null where the list is shorter, and the list without repeats in order."""
    rows = table(spark, sf_dir, "method_steps").where("visited_view_ids is not null")
    once = F.array_distinct(F.filter("visited_view_ids", lambda x: x.isNotNull()))
    return rows.select("row_id", F.get("visited_view_ids", 1).alias("second"), F.size(once).alias("n_once"), F.element_at(F.when(F.size(once) > 0, once), -1).alias("last"))


def accepted_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of a step: views visited less the start, else the step's number, else 0 (K4)."""
    rows = table(spark, sf_dir, "method_steps")
    n = F.coalesce(F.when(F.col("visited_view_ids").isNotNull(), F.size("visited_view_ids") - 1), F.col("step_id"), F.lit(0))
    return rows.groupBy(n.alias("actions")).agg(F.count(F.lit(1)).alias("n"))


def score_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each vector that reach a threshold: their indices and number."""
    rows = table(spark, sf_dir, "embeddings")
    kept = rows.select("vec_id", F.posexplode("embedding").alias("i", "score")).where("score >= 0.2")
    return kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))


def nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record for each cache folder: its views in order with their sizes (J17, M14), summed up again."""
    known = cache_members(table(spark, sf_dir, "view_cache_files")).where("identified")
    per = known.groupBy("cache_dir", "view_number").agg(F.max(F.size("points")).alias("n_points"))
    index = per.groupBy("cache_dir").agg(F.array_sort(F.collect_list(F.struct("view_number", "n_points"))).alias("views"))  # views of one folder
    total = F.aggregate("views", F.lit(0), lambda s, v: s + v["n_points"])
    return index.select("cache_dir", F.size("views").alias("n_views"), F.element_at("views", 1)["view_number"].alias("first_view"), total.alias("n_points"))


def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-safe key of each step: padded ids and the covered ratio in whole percent with a p for the point."""
    rows = run_steps(spark, sf_dir).where("covered_ratio is not null and not isnan(covered_ratio)")
    ratio = file_safe(F.floor(F.col("covered_ratio") * 100) / 100)
    return rows.select("run_id", "start_view_id", "step_id", F.concat_ws("_", F.lpad(F.col("start_view_id").cast("string"), 3, "0"), F.lpad(F.col("step_id").cast("string"), 3, "0"), ratio).alias("key"))


def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read from part names, with a default where there is none."""
    text = F.element_at(F.split("p_name", " "), -1)
    rows = table(spark, sf_dir, "part").select(safe_number(text, -1.0).alias("x"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == -1).alias("n_default"), F.round(F.sum("x"), 3).alias("total"))


QUERIES = {f.__name__: f for f in (
    zipped_gains, checkpoint_map, props_pivot, steps_to_end, accepted_actions, score_selection, nested_index, file_keys, safe_casts,
)}

SQL = {
    "zipped_gains": """WITH z AS (SELECT row_id, list_zip(candidate_view_ids, candidate_marginal_gains, true) AS z FROM method_steps WHERE candidate_view_ids IS NOT NULL AND candidate_marginal_gains IS NOT NULL)
SELECT row_id, len(z)::INTEGER AS n_pairs, len(list_filter(z, lambda p: p[1] IS NULL OR p[2] IS NULL))::INTEGER AS n_null,
coalesce(list_sum([p[2]::BIGINT for p in z if p[1] IS NOT NULL AND p[2] IS NOT NULL]), 0)::BIGINT AS total_gain FROM z""",
    "checkpoint_map": """WITH p AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL)
SELECT user_id, count(*)::INTEGER AS n_types, max(v) FILTER (event_type = 'purchase') AS purchase,
coalesce(max(v) FILTER (event_type = 'purchase'), max(v) FILTER (event_type = 'click'), max(v) FILTER (event_type = 'view')) AS terminal FROM p GROUP BY 1""",
    "props_pivot": """WITH r AS (SELECT event_type, value, (props::JSON ->> '$.k')::INTEGER AS k FROM events)
SELECT event_type, round(avg(value) FILTER (k BETWEEN 0 AND 33), 6) AS avg_low, round(avg(value) FILTER (k BETWEEN 34 AND 66), 6) AS avg_mid,
round(avg(value) FILTER (k BETWEEN 67 AND 99), 6) AS avg_high, count(k) AS n_with_k FROM r GROUP BY 1""",
    "steps_to_end": """SELECT row_id, visited_view_ids[2] AS second, len(list_distinct(visited_view_ids))::INTEGER AS n_once,
list_filter(visited_view_ids, lambda x, i: x IS NOT NULL AND NOT list_contains(visited_view_ids[1:i - 1], x))[-1] AS last FROM method_steps WHERE visited_view_ids IS NOT NULL""",
    "accepted_actions": "SELECT coalesce(len(visited_view_ids) - 1, step_id, 0)::INTEGER AS actions, count(*) AS n FROM method_steps GROUP BY 1",
    "score_selection": """WITH e AS (SELECT vec_id, unnest(embedding) AS score, unnest(range(len(embedding)))::INTEGER AS i FROM embeddings)
SELECT vec_id, count(*) AS n, min(i) AS first, max(i) AS last FROM e WHERE score::DOUBLE >= 0.2::DOUBLE GROUP BY 1""",
    "nested_index": MEMBERS_SQL + """, p AS (SELECT cache_dir, view_number, max(len(pts)) AS n FROM k GROUP BY ALL)
SELECT cache_dir, count(*)::INTEGER AS n_views, min(view_number) AS first_view, sum(n)::INTEGER AS n_points FROM p GROUP BY 1""",
    "file_keys": """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk FROM method_steps WHERE covered_voxel_count IS NOT NULL) WHERE rk = 1)
SELECT run_id, start_view_id, step_id, lpad(start_view_id::VARCHAR, 3, '0') || '_' || lpad(step_id::VARCHAR, 3, '0') || '_' || replace(rtrim(rtrim(printf('%.3f', floor(covered_ratio * 100) / 100), '0'), '.'), '.', 'p') AS key
FROM s WHERE isfinite(covered_ratio)""",
    "safe_casts": """SELECT count(*) AS n, count(*) FILTER (x = -1) AS n_default, round(sum(x), 3) AS total
FROM (SELECT coalesce(try_cast(string_split(p_name, ' ')[-1] AS DOUBLE), -1.0::DOUBLE) AS x FROM part)""",
}
