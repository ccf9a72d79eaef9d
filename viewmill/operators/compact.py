"""Consolidation of many tiny files into few well-sized ones (problem 4).

The rows of a listing (or of a folder read with ``sources.readers.small_text_files``) are brought to
one row for each cached view record, shuffled with Spark's REBALANCE hint so that adaptive execution
merges and splits output partitions towards a target size, written beside the final place, read back,
and moved to it only when count, sum and xor of the row hashes agree with those of the source.

Defined results
* null or empty payload, a payload without a whole point, a null folder or a name without a view
  number: there is no record to identify; the file is kept as its own record (``record_key`` from its
  file_id, or from the row's content where that is null), never merged with another one;
* lines that aren't three numbers (comments, a line cut off) are no points; -0 equals 0; order and
  repetition of points don't count;
* repeated rows with the same file_id are one file; an empty table gives empty outputs;
* further columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.session import scratch_path, written


def resolved_path(path: Column) -> Column:
    """Lower-case path with ``/`` as the only separator; ``.``, empty and ``x/..`` steps resolved."""
    slashed = F.lower(F.trim(F.regexp_replace(path, r"\\", "/")))
    steps = F.filter(F.split(slashed, "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")

    def step(done: Column, s: Column) -> Column:
        climbs = (s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(climbs, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(s))
        )

    root = F.when(slashed.startswith("/"), "/").otherwise("")
    return F.concat(root, F.array_join(F.aggregate(steps, none, step), "/"))


def view_number(file_name: Column) -> Column:
    """The number behind the word view (else the first number) of a file name."""
    lower = F.lower(file_name)
    named = F.regexp_extract(lower, r"view[^0-9]*([0-9]+)", 1)
    digits = F.when(named != "", named).otherwise(F.regexp_extract(lower, r"([0-9]+)", 1))
    return digits.try_cast("long")


def point_set(payload: Column) -> Column:
    """Sorted distinct points of an ``x y z`` text as array<struct<x,y,z>>."""
    lines = F.split(payload, r"[\r\n]+")
    fields = F.transform(lines, lambda line: F.split(F.trim(F.regexp_replace(line, r"[\s,;]+", " ")), " "))
    rows = F.filter(fields, lambda f: (F.size(f) == 3) & ~F.element_at(f, 1).startswith("#"))

    def number(text: Column) -> Column:
        return text.try_cast("double") + F.lit(0.0)  # -0.0 becomes 0.0

    points = F.transform(rows, lambda f: F.struct(*(number(F.get(f, i)).alias(n) for i, n in enumerate("xyz"))))
    whole = F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    return F.array_sort(F.array_distinct(whole))


def cache_members(files: DataFrame) -> DataFrame:
    """One row for each file: file_id, record_key and the parts of the record's identity."""
    parts = files.select(
        "file_id",
        resolved_path(F.col("view_cache_dir")).alias("cache_dir"),
        view_number(F.col("file_name")).alias("view_number"),
        point_set(F.col("payload")).alias("points"),
        F.col("view_cache_dir").alias("dir"),
        F.col("file_name").alias("name"),
        "payload",
    )
    identified = (
        F.col("cache_dir").isNotNull() & F.col("view_number").isNotNull() & (F.coalesce(F.size("points"), F.lit(0)) > 0)
    )
    text = F.concat_ws("|", F.col("cache_dir"), F.col("view_number").cast("string"), F.col("points").cast("string"))
    content = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("\x00")) for c in ("dir", "name", "payload")))
    alone = F.coalesce(F.concat(F.lit("file|"), F.col("file_id").cast("string")), F.concat(F.lit("row|"), content))
    return parts.select(
        "file_id",
        identified.alias("identified"),
        F.unhex(F.sha2(F.when(identified, text).otherwise(alone), 256)).alias("record_key"),
        "cache_dir",
        "view_number",
        "points",
    )


def multiset_checksum(columns: list[str]) -> list[Column]:
    """Aggregates that are equal for equal multisets of rows, in any order."""
    h = F.xxhash64(*columns)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
        F.bit_xor(h).alias("hash_xor"),
    ]


def folder(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system and the path, as Hadoop sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def files_in(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    fs, at = folder(spark, path)
    return sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(at))


def consolidate(df: DataFrame, out_path: str, target_bytes: int = 256 << 20, staged: str | None = None) -> DataFrame:
    """Write ``df`` to ``out_path`` as files of about ``target_bytes``; commit only what was verified.

    Raises before any work if something stands at ``out_path`` already, and after it if the rows read back
    from the staging folder are not the multiset of the source, or if the files at the final path are not
    those that were verified. The rows come from a folder, ``staged`` if that holds them already, so the
    source's checksum (an aggregate of its own, unharmed by repeated tasks) and the copy see the same rows.
    A session of its own carries the target size, so that concurrent queries keep theirs.
    Returns the checksum of the committed files as one row.
    """
    spark = df.sparkSession
    fs, target = folder(spark, out_path)
    if fs.exists(target):
        raise FileExistsError(f"{out_path} exists already; nothing written")
    if staged is None:
        staged = scratch_path(spark, "to-consolidate")
        df.write.parquet(staged)
    own = spark.newSession()
    own.conf.set("spark.sql.adaptive.enabled", "true")
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    source = own.read.schema(df.schema).parquet(staged)
    staging = f"{out_path}.staging-{uuid.uuid4().hex}"
    sent = source.agg(*multiset_checksum(df.columns)).first().asDict()
    source.hint("rebalance").write.parquet(staging)
    found = own.read.schema(df.schema).parquet(staging).agg(*multiset_checksum(df.columns)).first().asDict()
    if found != sent:
        raise RuntimeError(f"{out_path}: the source has {sent}, read back {found}; nothing committed")
    verified = files_in(spark, staging)
    if fs.exists(target) or not fs.rename(folder(spark, staging)[1], target) or files_in(spark, out_path) != verified:
        raise RuntimeError(f"{out_path}: the verified files are not in place")
    return spark.createDataFrame([tuple(found.values())], "n long, hash_sum decimal(38,0), hash_xor long")


def consolidate_view_cache(files: DataFrame, out_path: str | None = None, target_bytes: int = 128 << 20) -> dict[str, DataFrame]:
    """Consolidate a cache listing: ``records`` (each cached view once) and ``members`` (file to record).

    Payloads are parsed once. Both tables are written with REBALANCE, verified and committed below
    ``out_path`` (by default a new place in the shared folder); the returned frames read the committed
    files. Raises if the listing, the members and the records don't count the same files.
    """
    spark = files.sparkSession
    out = out_path or scratch_path(spark, "view-cache")
    parsed = written(cache_members(files), "cache-members")
    members = parsed.select("file_id", "record_key", "identified").distinct()
    records = parsed.groupBy("record_key").agg(
        F.min("file_id").alias("first_file_id"),
        F.count_distinct("file_id").alias("n_files"),
        F.first("cache_dir").alias("cache_dir"),
        F.first("view_number").alias("view_number"),
        F.first("points").alias("points"),
        F.first("identified").alias("identified"),
    )
    read = {}
    for name, df in (("members", members), ("records", records)):
        consolidate(df, f"{out}/{name}", target_bytes)
        read[name] = spark.read.schema(df.schema).parquet(f"{out}/{name}")
    listed = files.agg(F.count_distinct("file_id").alias("n")).first()[0]
    linked = read["members"].agg(F.count_distinct("file_id").alias("files"), F.count("file_id").alias("links")).first()
    held = read["records"].agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n")).first()[0]
    if linked.files != listed or linked.links != held:
        raise RuntimeError(f"{out}: {listed} files listed, {linked.files} linked by {linked.links} links, {held} held by records")
    return read


def copy_pairs(members: DataFrame, hot: int = 1000) -> DataFrame:
    """Pairs of files of one record, the smaller id first: an equi-join on the record key.

    The files of a record with more than ``hot`` copies are spread over salts, against each of which all are held.
    """
    known = members.where("identified and file_id is not null").select("file_id", "record_key")
    several = known.groupBy("record_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = known.join(several, "record_key").withColumn("salts", F.ceil(F.col("n") / hot))
    left = copies.select("record_key", F.col("file_id").alias("file_id_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    right = copies.select("record_key", F.col("file_id").alias("file_id_b"), F.expr("pmod(xxhash64(file_id), salts)").alias("salt"))
    return left.join(right, ["record_key", "salt"]).where("file_id_a < file_id_b").select("file_id_a", "file_id_b")
