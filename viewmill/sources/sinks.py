"""Writers: JSON lines, CSV over the union of columns, and runs that skip what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewmill.session import written


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_csv_union(parts: list[DataFrame], path: str) -> None:
    """One CSV with the union of the parts' columns in the order of first appearance."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("errorifexists").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a committed output at ``path``?"""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str) -> bool:
    """Write parquet unless a committed output is there; says whether it wrote."""
    if exists(df.sparkSession, path):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def append_missing(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose keys the table at ``path`` lacks; returns those rows."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    fresh = written(fresh, "fresh")
    fresh.write.mode("append").parquet(path)
    return fresh


def job_status(jobs: DataFrame, summaries: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs still to run: without a summary, or whose summary ended by an exception."""
    done = summaries.where(F.col("terminal_source").isin("algorithm", "benchmark")).select(key)
    return jobs.join(done, key, "left_anti")
