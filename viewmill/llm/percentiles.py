"""Exact or bounded-error percentiles from mergeable parts, by radix selection (problem 2).

A double is mapped to a 64-bit integer with the same order. Each pass counts one 16-bit digit of the
values that share the digits found so far, separately for each part (here a day); parts add up, so
counts of separate partitions or days can be combined at any time. The cumulative counts of the
combined parts show the digit that holds each target rank, and only that digit is followed.

Parts can be kept: ``value_parts`` gives the counts of the first digits of a day's values, ``percentiles_of_parts``
the percentiles of any kept parts together, so a new day is added without reading the old ones' values.

Four passes give exact values. Fewer give an interval [low, high] that holds the value; its relative
width is below 2^-4 after one pass, 2^-20 after two, 2^-36 after three.

Defined results
* percentile ``p`` of ``n`` values is the value of rank max(1, ceil(p * n / 100)) (nearest rank);
* null and NaN are no values; -0 equals 0; infinities are values; repeated values count each;
* a group without values gives no row; an empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewmill.session import broadcast_if_small, clean_key, written

DIGIT = 16
FLIP = 0x7FFFFFFFFFFFFFFF


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """The double's bits as a long of the same order."""
    bits = (x.to_numpy(dtype="float64") + 0.0).view("int64")
    return pd.Series(bits ^ ((bits >> 63) & FLIP))


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(k: pd.Series) -> pd.Series:
    bits = k.to_numpy(dtype="int64")
    return pd.Series((bits ^ ((bits >> 63) & FLIP)).view("float64"))


def digit_parts(keyed: DataFrame, group: list[str], part: list[str], level: int) -> DataFrame:
    """Mergeable part of a pass: how many values of each group and part have each prefix of ``level`` digits."""
    prefix = F.shiftright("key", 64 - DIGIT * level)
    return keyed.groupBy(*group, *part, prefix.alias("prefix")).agg(F.sum("n").alias("n"))


def keyed_values(values: DataFrame, group: list[str], part: list[str]) -> DataFrame:
    """group, part, key and n = 1 of every value that is one."""
    usable = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return usable.select(*group, *part, ordered_bits("value").alias("key"), F.lit(1).cast("long").alias("n"))


def value_parts(values: DataFrame, group: list[str], part: list[str], digits: int = 2) -> DataFrame:
    """What to keep of each part (say a day): counts of the values' first ``digits`` digits, as group, part, prefix, n.

    A kept part stands for its values in every later percentile, within the error of so many digits; the
    values aren't read again.
    """
    return digit_parts(keyed_values(values, group, part), group, part, digits)


def merged_parts(parts: list[DataFrame], group: list[str], part: list[str]) -> DataFrame:
    """Kept parts as one: counts add up, so several tables may hold counts of one part."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*group, *part, "prefix").agg(F.sum("n").alias("n"))


def percentiles_of_parts(parts: DataFrame, group: list[str], pcts: DataFrame, digits: int = 2) -> DataFrame:
    """``percentiles`` from kept parts alone: intervals [low, high] of so many digits."""
    keyed = parts.select(*group, F.shiftleft("prefix", 64 - DIGIT * digits).alias("key"), "n")
    return _followed(written(keyed, "radix-keys"), group, [], pcts, digits)


def percentiles(values: DataFrame, group: list[str], part: list[str], pcts: DataFrame, passes: int = 4) -> DataFrame:
    """Percentiles of ``value`` for each group: group columns, pct, n, low, high (equal after four passes).

    ``pcts`` holds the wanted pct and may hold some of the group columns to restrict it to them.
    The values are written once as (group, part, key) and read once in each pass; only counts are shuffled.
    """
    return _followed(written(keyed_values(values, group, part), "radix-keys"), group, part, pcts, passes)


def _followed(keyed: DataFrame, group: list[str], part: list[str], pcts: DataFrame, passes: int) -> DataFrame:
    """The passes: each counts a digit of the keys and follows those that hold a target rank."""
    shared = [c for c in pcts.columns if c in group]
    pcts = broadcast_if_small(written(pcts, "radix-percentiles"))
    targets = None
    for level in range(1, passes + 1):
        rows = keyed
        if targets is not None:
            wanted = targets.select(*group, F.col("prefix").alias("_w")).distinct()
            match = [F.col(f"v.{g}").eqNullSafe(F.col(f"w.{g}")) for g in group]
            match.append(F.shiftright("v.key", 64 - DIGIT * (level - 1)) == F.col("w._w"))
            rows = keyed.alias("v").join(broadcast_if_small(wanted).alias("w"), match, "left_semi")
        merged = digit_parts(rows, group, part, level).groupBy(*group, "prefix").agg(F.sum("n").alias("n"))
        merged = merged.withColumn("above", F.shiftright("prefix", DIGIT) if level > 1 else F.lit(0).cast("long"))
        bins = merged.withColumn("upto", F.sum("n").over(Window.partitionBy(*group, "above").orderBy("prefix")))
        if targets is None:
            sizes = bins.groupBy(*group).agg(F.sum("n").alias("n_values"))
            joined = sizes.join(pcts, shared) if shared else sizes.crossJoin(pcts)  # every percentile of every group
            rank = F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("n_values") / 100)).cast("long")
            asked = joined.select(*group, "pct", "n_values", rank.alias("rank"), F.lit(0).cast("long").alias("prefix"))
        else:
            asked = targets
        hit = [F.col(f"b.{g}").eqNullSafe(F.col(f"t.{g}")) for g in group]
        hit += [F.col("b.above") == F.col("t.prefix"), F.col("t.rank") > F.col("b.upto") - F.col("b.n"), F.col("t.rank") <= F.col("b.upto")]
        found = bins.alias("b").join(asked.alias("t"), hit).select(
            *(F.col(f"t.{g}").alias(g) for g in group),
            "t.pct",
            "t.n_values",
            (F.col("t.rank") - (F.col("b.upto") - F.col("b.n"))).alias("rank"),
            F.col("b.prefix").alias("prefix"),
        )
        targets = written(found, "radix-targets")
    low = F.shiftleft("prefix", 64 - DIGIT * passes)
    span = (1 << (64 - DIGIT * passes)) - 1
    return targets.select(
        *group, "pct", F.col("n_values").alias("n"), from_ordered_bits(low).alias("low"), from_ordered_bits(low + F.lit(span)).alias("high")
    )


def saturation_values(saturation: DataFrame) -> DataFrame:
    """Valid measurements of each object, once per batch: batch_id, metric, run_day, value.

    Redelivered objects carry the same values; the earliest row of an object in its batch counts, and
    with it its day. Rows without a uid are objects of their own.
    """
    uid = F.coalesce(clean_key("uid"), F.concat(F.lit("row "), F.col("row_id").cast("string")))
    row = F.struct("run_day", "row_id", "a_fit", "b_discrete", "curve_raw")
    once = saturation.groupBy("batch_id", uid.alias("uid")).agg(F.min_by(row, F.struct("run_day", "row_id")).alias("r"))
    number = lambda metric, value: F.array(F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value")))
    curve = F.transform(F.coalesce("r.curve_raw", F.array()), lambda p: F.struct(F.lit("curve_raw").alias("metric"), p["y"].alias("value")))
    each = once.select(
        "batch_id",
        F.col("r.run_day").alias("run_day"),
        F.inline(F.concat(number("a_fit", F.col("r.a_fit")), number("b_discrete", F.col("r.b_discrete")), curve)),
    )
    bound = F.when(F.col("metric") == "a_fit", F.col("value").between(0, 1)).when(
        F.col("metric") == "b_discrete", F.col("value").between(1, 10000)
    )
    return each.where(F.col("value").isNotNull() & ~F.isnan("value") & bound.otherwise(F.col("value") >= 0))


def saturation_percentiles(saturation: DataFrame, limits: DataFrame, passes: int = 4) -> DataFrame:
    """Percentiles of percentile_limits for each batch and metric, from parts counted for each day."""
    pcts = limits.select("metric", "pct").distinct()
    return percentiles(saturation_values(saturation), ["batch_id", "metric"], ["run_day"], pcts, passes)
