"""Equi-joins that keep hot keys from ending in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewmill.session import broadcast_if_small, written


def salted_join(many: DataFrame, few: DataFrame, key: str, hot: int = 1_000_000, at_most: int | None = None) -> DataFrame:
    """Inner join on ``key``; rows of ``many`` with a key of more than ``hot`` rows are spread over salts.

    Only the rows of ``few`` with such a key are repeated, once for each salt. There are at most
    rows / ``hot`` hot keys, counted with map-side sums and written, so that their join can be broadcast.
    ``at_most``: a known bound of the rows of ``many``; where even that isn't hot nothing is counted.
    """
    if at_most is not None and at_most <= hot:
        return many.join(few, key)
    many = written(many, "salted")
    if many.count() <= hot:  # read off the files' footers
        return many.join(few, key)
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot)
    salts = written(counts.select(key, F.ceil(F.col("_n") / hot).cast("int").alias("_salts")), "salts")
    if salts.isEmpty():
        return many.join(few, key)
    spread = many.join(broadcast_if_small(salts), key, "left")
    spread = spread.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = few.join(broadcast_if_small(salts), key, "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return spread.join(copies, [key, "_salt"]).drop("_salt")
