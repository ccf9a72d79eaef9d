"""Queries of the small-file and nested-record operators (problems 4 and 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.operators.compact import consolidate_view_cache, copy_pairs
from viewmill.operators.nested import list_occurrences, shred
from viewmill.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_pairs(consolidate_view_cache(table(spark, sf_dir, "view_cache_files"))["members"])


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = consolidate_view_cache(table(spark, sf_dir, "view_cache_files"))["records"]
    return records.where("identified").select(
        "cache_dir", "view_number", F.size("points").alias("n_points"), "n_files", "first_file_id"
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = list_occurrences(shred(table(spark, sf_dir, "rollouts_raw")))
    return found.where("elem is not null").select(
        "record_id", "rollout_pos", "step_pos", "elem_pos", F.expr("try_cast(elem as int)").alias("view_id")
    )


def p6_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct objects and their occurrences of each kind."""
    tables = shred(table(spark, sf_dir, "rollouts_raw"))
    return tables["objects"].groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_objects"), F.sum(F.size("attrs")).alias("n_attributes")
    )


QUERIES = {"p4_found": p4_found, "p4_records": p4_records, "p6_found": p6_found, "p6_objects": p6_objects}

#: WITH clause that ends in ``k``: file_id, cache_dir, view_number, pts of the identified files.
MEMBERS_SQL = r"""
WITH f AS (
  SELECT file_id,
    lower(replace(trim(view_cache_dir), '\', '/')) AS d0,
    coalesce(nullif(regexp_extract(lower(file_name), 'view[^0-9]*([0-9]+)', 1), ''),
             nullif(regexp_extract(lower(file_name), '([0-9]+)', 1), ''))::BIGINT AS view_number,
    [ [try_cast(x AS DOUBLE) + 0.0 for x in r] for r in
      [ string_split_regex(trim(l, E' \t'), '[ \t]+') for l in string_split_regex(payload, '[\r\n]+')
        if not starts_with(trim(l, E' \t'), '#') ] if len(r) = 3 ] AS pts0
  FROM view_cache_files),
g AS (
  SELECT file_id, view_number,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      d0, '(/\.)+(/|$)', '/', 'g'), '^\./', ''), '/+', '/', 'g'), '[^/]+/\.\./', '', 'g'), '/$', '') AS cache_dir,
    list_sort(list_distinct([ {'x': r[1], 'y': r[2], 'z': r[3]} for r in pts0
      if r[1] is not null and r[2] is not null and r[3] is not null ])) AS pts
  FROM f),
k AS (SELECT * FROM g WHERE cache_dir IS NOT NULL AND view_number IS NOT NULL AND len(pts) > 0)
"""

#: WITH clause that ends in ``points``: obj, view_number, x, y, z of the cached views.
POINTS_SQL = (
    MEMBERS_SQL
    + """, points AS (SELECT DISTINCT split_part(cache_dir, '/', -1) AS obj, view_number, p.x AS x, p.y AS y, p.z AS z
  FROM (SELECT cache_dir, view_number, unnest(pts) AS p FROM k))"""
)

SQL = {
    "p4_found": MEMBERS_SQL
    + """SELECT a.file_id AS file_id_a, b.file_id AS file_id_b FROM k a JOIN k b
ON a.cache_dir = b.cache_dir AND a.view_number = b.view_number AND a.pts = b.pts AND a.file_id < b.file_id""",
    "p4_records": MEMBERS_SQL
    + """SELECT cache_dir, view_number, len(pts)::INTEGER AS n_points, count(DISTINCT file_id) AS n_files, min(file_id) AS first_file_id
FROM k GROUP BY cache_dir, view_number, pts""",
}
