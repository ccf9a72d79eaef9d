"""Joins, set operations, ordering and work lists over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewmill.functions.scalar import label, number
from viewmill.operators.joins import audit_join, keyed_merge, nearest, override_join, tolerance_first
from viewmill.operators.positions import positions
from viewmill.session import clean_key, table


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each annotated object: its first delivery."""
    rows = table(spark, sf_dir, "annotations").withColumn("uid", clean_key("uid")).where("uid is not null")
    return keyed_merge([rows], ["uid"], [F.col("row_id")])


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each measured object: its last computation."""
    rows = table(spark, sf_dir, "saturation").withColumn("uid", clean_key("uid")).where("uid is not null")
    return keyed_merge([rows], ["uid"], [-F.col("row_id")])


def inner_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with their saturation record; the record's row_id and delivery time replace the annotation's."""
    left = objects(spark, sf_dir).select("uid", "row_id", label(F.col("shape_type")).alias("shape"), "ingested_at")
    right = curves(spark, sf_dir).select("uid", "row_id", "ingested_at", "b_discrete")
    return override_join(left, right, ["uid"])


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many objects match a complete saturation record, and what is missing from the others."""
    right = curves(spark, sf_dir).select("uid", number(F.col("a_fit")).alias("a_fit"), "b_discrete", "fit_type")
    out = audit_join(objects(spark, sf_dir).select("uid"), right, ["uid"], ["a_fit", "b_discrete", "fit_type"])
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both raters' labels of equal sample texts merged by rule: agreement, one side only, or the stricter label."""
    rows = table(spark, sf_dir, "mod_samples").withColumn("k", F.lower("sample_text"))
    side = lambda c: rows.where(F.col(c).isNotNull()).groupBy("k").agg(F.max(c).alias(c))
    both = side("rater_a").join(side("rater_b"), "k", "full")
    a, b = F.col("rater_a"), F.col("rater_b")
    verdict = F.when(b.isNull(), a).when(a.isNull(), b).when(a == b, a).when(a == "none", b).when(b == "none", a).otherwise("disputed")
    return both.groupBy(verdict.alias("verdict")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a != b).alias("n_conflicts"), F.count_if(a.isNull() | b.isNull()).alias("n_one_sided")
    )


def anti_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of each kind: annotated and measured, annotated only, measured only."""
    a, s = objects(spark, sf_dir).select("uid"), curves(spark, sf_dir).select("uid")
    count = lambda df, name: df.agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n"))
    return (
        count(a.join(s, "uid", "left_semi"), "both")
        .unionByName(count(a.join(s, "uid", "left_anti"), "annotated_only"))
        .unionByName(count(s.join(a, "uid", "left_anti"), "measured_only"))
    )


def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(raw train union balanced train) minus analysis test, cut with the measured objects; and overlaps."""
    rows = table(spark, sf_dir, "split_members").select("split_name", clean_key("uid").alias("uid")).where("uid is not null")
    of = lambda name: rows.where(F.col("split_name") == name).select("uid")
    raw, balanced, test = of("main_raw_train"), of("main_balanced_train"), of("main_analysis_test")
    measured = curves(spark, sf_dir).select("uid")
    sets = {
        "union": raw.union(balanced).distinct(),
        "union_minus_test": raw.union(balanced).subtract(test),
        "train_overlap": raw.intersect(balanced),
        "measured_train": raw.union(balanced).subtract(test).intersect(measured),
        "all_rows": raw.unionByName(balanced),
    }
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _jobs(uids: DataFrame) -> DataFrame:
    """Each object with every start view and method, under a stable id."""
    starts, methods = F.array(*map(F.lit, (0, 42, 85))), F.array(*map(F.lit, ("greedy", "random", "nearest")))
    jobs = uids.withColumn("start", F.explode(starts)).withColumn("method", F.explode(methods))
    return jobs.withColumn("job_id", F.concat_ws("__", "method", F.lpad(F.col("start").cast("string"), 3, "0"), "uid"))


def job_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work list of all objects, each with every start view and method; ``shard`` (0 to 3) is the place in the sorted list modulo 4."""
    placed = positions(objects(spark, sf_dir).select("uid"), [], [F.asc("uid")], name="position")
    return _jobs(placed).select("job_id", "uid", "start", "method", ((F.col("position") - 1) % 4).alias("shard"))


def resume_work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members without a usable saturation record yet, with the reason; finished ones are left out."""
    members = table(spark, sf_dir, "split_members").select("member_id", clean_key("uid").alias("uid"))
    state = curves(spark, sf_dir).select("uid", number(F.col("a_fit")).alias("a_fit"))
    out = audit_join(members, state, ["uid"], ["a_fit"])
    return out.where("status != 'matched'").select("member_id", "status")


def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation member the first training member whose area is within 0.0005."""
    rows = table(spark, sf_dir, "split_members").where("area is not null and not isnan(area)")
    train = F.col("split_name").isin("main_raw_train", "main_balanced_train")
    return tolerance_first(rows.where(~train), rows.where(train).withColumnRenamed("member_id", "train_id"), "area", 0.0005, "member_id", "train_id")


def nearest_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three other vectors with the largest dot product, for every vector whose id 20 divides."""
    rows = table(spark, sf_dir, "embeddings")
    out = nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", k=4, metric="dot")
    others = out.where("query_id != id").select("query_id", "id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return others.withColumn("rank", rank).where("rank <= 3").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector at the largest distance, for every vector whose id 20 divides."""
    rows = table(spark, sf_dir, "embeddings")
    out = nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding", k=1, metric="far")
    return out.select("query_id", "id", F.round("score", 6).alias("squared_distance"))


def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of each object: the row that counts and how many there were, the redelivered ones only."""
    merged = objects(spark, sf_dir).where("n_rows > 1")
    return merged.select("uid", "row_id", "n_rows")


def registry_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit types named through a small side with defaults: empty and unknown names fall back to 'other'."""
    names = spark.sql("select * from values ('lognormal_cdf', 'lognormal'), ('discrete', '') as t(fit_type, name)")
    rows = table(spark, sf_dir, "saturation").join(F.broadcast(names), "fit_type", "left")
    return rows.groupBy(F.coalesce(F.nullif("name", F.lit("")), F.col("fit_type"), F.lit("other")).alias("fit")).agg(F.count(F.lit(1)).alias("n"))


def review_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member's place in the review: flagged pools first, then B descending, then id (O1, O2)."""
    pool = F.when(F.col("pool_type") == "extreme", 0).when(F.col("pool_type") == "long_tail", 1).otherwise(2)
    rows = table(spark, sf_dir, "split_members").select("split_name", pool.alias("p"), "member_id", "observation_saturation_view_num")
    order = [F.desc_nulls_last("observation_saturation_view_num"), F.asc("member_id")]
    return positions(rows, ["split_name", "p"], order, None, "place").drop("observation_saturation_view_num")


QUERIES = {f.__name__: f for f in (
    inner_override, full_outer_merge, anti_semi, set_algebra, job_matrix, resume_work_list, tolerance_join,
    nearest_dot, farthest, ordered_merge, registry_default, review_order,
)} | {"audit_join": audit}

_UID = r"nullif(lower(regexp_replace(uid, '^\s+|\s+$', '', 'g')), '')"
_OBJECTS = f"""WITH o AS (SELECT * FROM (SELECT * REPLACE ({_UID} AS uid), row_number() OVER (PARTITION BY {_UID} ORDER BY row_id) AS k,
  count(*) OVER (PARTITION BY {_UID}) AS n_rows FROM annotations) WHERE k = 1 AND uid IS NOT NULL),
s AS (SELECT * FROM (SELECT * REPLACE ({_UID} AS uid), row_number() OVER (PARTITION BY {_UID} ORDER BY row_id DESC) AS k FROM saturation) WHERE k = 1 AND uid IS NOT NULL)
"""
_LABEL = r"regexp_replace(lower(regexp_replace(shape_type, '^\s+|\s+$', '', 'g')), '[\s-]', '_', 'g')"
_A = "CASE WHEN isfinite(a_fit) THEN a_fit END"
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"
_SETS = f"""WITH m AS (SELECT split_name, {_UID} AS uid FROM split_members WHERE {_UID} IS NOT NULL),
r AS (SELECT uid FROM m WHERE split_name = 'main_raw_train'), b AS (SELECT uid FROM m WHERE split_name = 'main_balanced_train'),
t AS (SELECT uid FROM m WHERE split_name = 'main_analysis_test'), s AS (SELECT DISTINCT {_UID} AS uid FROM saturation),
u AS (SELECT uid FROM r UNION SELECT uid FROM b)
"""

SQL = {
    "inner_override": _OBJECTS + f"""SELECT o.uid, coalesce(s.row_id, o.row_id) AS row_id, CASE WHEN {_LABEL} NOT IN ('', 'unknown', 'null', 'none') THEN {_LABEL} END AS shape,
coalesce(s.ingested_at, o.ingested_at) AS ingested_at, s.b_discrete FROM o JOIN s ON o.uid = s.uid""",
    "audit_join": _OBJECTS + f"""SELECT CASE WHEN s.uid IS NULL THEN 'missing_row' WHEN {_A} IS NULL THEN 'missing_a_fit' WHEN b_discrete IS NULL THEN 'missing_b_discrete'
WHEN fit_type IS NULL THEN 'missing_fit_type' ELSE 'matched' END AS status, count(*) AS n FROM o LEFT JOIN s ON o.uid = s.uid GROUP BY 1""",
    "full_outer_merge": """WITH a AS (SELECT lower(sample_text) AS k, max(rater_a) AS rater_a FROM mod_samples WHERE rater_a IS NOT NULL GROUP BY 1),
b AS (SELECT lower(sample_text) AS k, max(rater_b) AS rater_b FROM mod_samples WHERE rater_b IS NOT NULL GROUP BY 1)
SELECT CASE WHEN rater_b IS NULL THEN rater_a WHEN rater_a IS NULL THEN rater_b WHEN rater_a = rater_b THEN rater_a WHEN rater_a = 'none' THEN rater_b
WHEN rater_b = 'none' THEN rater_a ELSE 'disputed' END AS verdict, count(*) AS n, count(*) FILTER (rater_a <> rater_b) AS n_conflicts,
count(*) FILTER (rater_a IS NULL OR rater_b IS NULL) AS n_one_sided FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
    "anti_semi": _OBJECTS + """SELECT 'both' AS kind, count(*) AS n FROM o WHERE uid IN (SELECT uid FROM s)
UNION ALL SELECT 'annotated_only', count(*) FROM o WHERE uid NOT IN (SELECT uid FROM s) UNION ALL SELECT 'measured_only', count(*) FROM s WHERE uid NOT IN (SELECT uid FROM o)""",
    "set_algebra": _SETS + """SELECT 'union' AS name, count(*) AS n FROM u UNION ALL SELECT 'union_minus_test', count(*) FROM (FROM u EXCEPT FROM t)
UNION ALL SELECT 'train_overlap', count(*) FROM (FROM r INTERSECT FROM b) UNION ALL SELECT 'measured_train', count(*) FROM ((FROM u EXCEPT FROM t) INTERSECT FROM s)
UNION ALL SELECT 'all_rows', count(*) FROM (FROM r UNION ALL FROM b)""",
    "job_matrix": _OBJECTS + """SELECT method || '__' || lpad(start::VARCHAR, 3, '0') || '__' || uid AS job_id, uid, start, method, shard
FROM (SELECT uid, (row_number() OVER (ORDER BY uid) - 1) % 4 AS shard FROM o), (SELECT unnest([0, 42, 85]) AS start), (SELECT unnest(['greedy', 'random', 'nearest']) AS method)""",
    "resume_work_list": _OBJECTS + f"""SELECT member_id, CASE WHEN s.uid IS NULL THEN 'missing_row' ELSE 'missing_a_fit' END AS status
FROM (SELECT member_id, {_UID} AS uid FROM split_members) m LEFT JOIN s ON m.uid = s.uid WHERE s.uid IS NULL OR {_A} IS NULL""",
    "tolerance_join": """WITH m AS (SELECT *, split_name IN ('main_raw_train', 'main_balanced_train') AS t FROM split_members WHERE isfinite(area))
SELECT e.member_id, min(t.member_id) AS match_train_id FROM m e LEFT JOIN m t ON t.t AND abs(e.area - t.area) <= 0.0005::DOUBLE WHERE NOT e.t GROUP BY 1""",
    "nearest_dot": f"""SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (
SELECT a.vec_id AS query_id, b.vec_id AS id, {_DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 3""",
    "farthest": f"""SELECT query_id, id, round(d, 6) AS squared_distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d DESC, id) AS rank FROM (
SELECT a.vec_id AS query_id, b.vec_id AS id, {_D2} AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)) WHERE rank = 1""",
    "ordered_merge": _OBJECTS + "SELECT uid, row_id, n_rows FROM o WHERE n_rows > 1",
    "registry_default": """SELECT coalesce(nullif(t.name, ''), s.fit_type, 'other') AS fit, count(*) AS n FROM saturation s
LEFT JOIN (VALUES ('lognormal_cdf', 'lognormal'), ('discrete', '')) AS t(fit_type, name) ON s.fit_type = t.fit_type GROUP BY 1""",
    "review_order": """SELECT split_name, p, member_id, row_number() OVER (PARTITION BY split_name, p ORDER BY observation_saturation_view_num DESC NULLS LAST, member_id) AS place
FROM (SELECT *, CASE WHEN pool_type = 'extreme' THEN 0 WHEN pool_type = 'long_tail' THEN 1 ELSE 2 END AS p FROM split_members)""",
}
