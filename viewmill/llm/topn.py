"""Top N items within every group by one global sort (problem 1).

The rows are range-partitioned and sorted on group, order and identifier, so a group of any size is
spread over as many tasks as it needs. Each task numbers the rows of its groups and counts the rows
of its first and its last group, the only ones that can go on in another partition. The prefix sums
of those counts turn local numbers into exact positions; positions up to N are kept.

Defined results
* ties are broken by the order columns to the end; make them end in an identifier for one defined order;
* a null group is a group; rows with equal group and order columns keep any order among themselves;
* nulls come first in ascending and last in descending order;
* an empty table gives an empty result; groups of fewer than N rows give all their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewmill.operators.positions import positions
from viewmill.session import clean_key


def is_valid(pair: Column) -> Column:
    """A pair with an id, and a gain from 0 to the row's voxels."""
    return pair["id"].isNotNull() & (pair["gain"] >= 0) & F.coalesce(pair["gain"] <= F.col("universe_voxel_count"), F.lit(True))


def least_gain(n: int) -> Column:
    """The gain that a pair of a row's list needs to be among the first ``n`` of its uid.

    A pair with a smaller gain than ``n`` others of its list stays behind those others, whatever the other lists
    hold. Ties of the n-th stay, and so does a whole list in which an id stands twice.
    """
    once = F.size(F.array_distinct("pairs.id")) == F.size("pairs")
    gains = F.sort_array(F.transform("pairs", lambda p: F.when(is_valid(p), p["gain"])), asc=False)
    return F.coalesce(F.when(once, F.get(gains, n - 1)), F.lit(0))


def candidate_items(steps: DataFrame, n: int | None = None) -> DataFrame:
    """Items (run_id, start_view_id, step_id, candidate_view_id) of each uid with their largest valid gain.

    The lists are shuffled as they are, by step; after exploding them, the grouping by item needs no further
    shuffle. With ``n`` only items are kept that can be among the first ``n`` of their uid.
    """
    step = ["uid", "run_id", "start_view_id", "step_id"]
    rows = steps.select(
        clean_key("uid").alias("uid"),
        *step[1:],
        "universe_voxel_count",
        F.arrays_zip(F.col("candidate_view_ids").alias("id"), F.col("candidate_marginal_gains").alias("gain")).alias("pairs"),
    ).where("uid is not null")
    rows = rows.withColumn("least", F.lit(0) if n is None else least_gain(n))
    pairs = rows.repartition(*step).select(*step, "universe_voxel_count", "least", F.explode("pairs").alias("p"))
    valid = pairs.where(is_valid(F.col("p")) & (F.col("p.gain") >= F.col("least")))
    return valid.groupBy(*step, F.col("p.id").alias("candidate_view_id")).agg(F.max("p.gain").alias("gain"))


def top_candidates(steps: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` candidate views of each object with the largest marginal gains."""
    items = candidate_items(steps, n)
    order = [F.desc("gain"), *(F.asc(c) for c in ("run_id", "start_view_id", "step_id", "candidate_view_id"))]
    return positions(items, ["uid"], order, n)
