"""Streaming queries over the given tables, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.streaming.steps import drained, file_stream, first_deliveries, stabilisation, windowed_counts


def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in windows of six hours; no event comes too late for its window."""
    counts = windowed_counts(file_stream(spark, sf_dir, "events"), "3650 days", "6 hours")
    out = drained(counts, "windows", "update")
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 4).alias("total"))


def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps delivered once, counted by run: redeliveries are dropped by keyed state."""
    steps = file_stream(spark, sf_dir, "method_steps").select("run_id", "start_view_id", "step_id", "ingested_at")
    out = drained(first_deliveries(steps, "3650 days"), "deliveries")
    return out.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_steps"))


def stream_stabilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step at which each run's covered voxels stabilise, from a stream of its steps."""
    steps = file_stream(spark, sf_dir, "method_steps")
    out = drained(stabilisation(steps), "stabilisation", "update")
    final = out.groupBy("run_id", "start_view_id").agg(F.max_by(F.struct("stable_at", "n_steps"), "n_steps").alias("r"))
    return final.select("run_id", "start_view_id", F.when(F.col("r.stable_at") >= 0, F.col("r.stable_at")).alias("stable_at"), F.col("r.n_steps").alias("n_steps"))


QUERIES = {f.__name__: f for f in (stream_windowed_counts, stream_first_deliveries, stream_stabilisation)}

SQL = {
    "stream_stabilisation": """WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, start_view_id, step_id ORDER BY row_id) AS rk
  FROM method_steps WHERE covered_voxel_count IS NOT NULL) WHERE rk = 1),
a AS (SELECT *, lag(covered_voxel_count) OVER (PARTITION BY run_id, start_view_id ORDER BY step_id) AS p FROM s),
b AS (SELECT *, coalesce(((covered_voxel_count - p) / greatest(p, 1)::DOUBLE < 0.05::DOUBLE)::INTEGER, 0) AS sm FROM a),
d AS (SELECT *, sum(1 - sm) OVER (PARTITION BY run_id, start_view_id ORDER BY step_id) AS isl FROM b),
e AS (SELECT *, sum(sm) OVER (PARTITION BY run_id, start_view_id, isl ORDER BY step_id) AS run FROM d)
SELECT run_id, start_view_id, min(CASE WHEN run >= 2 THEN step_id END)::BIGINT AS stable_at, count(*) AS n_steps FROM e GROUP BY ALL""",
    "stream_windowed_counts": """SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    "stream_first_deliveries": """SELECT run_id, count(*) AS n_steps FROM (SELECT DISTINCT run_id, start_view_id, step_id FROM method_steps) GROUP BY 1""",
}
