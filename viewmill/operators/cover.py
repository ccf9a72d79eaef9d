"""Coverage relations (group, view, voxel): gains, unions and greedy covers for all groups at once."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewmill.session import scratch_path, written

SMALL_GROUP = 1_000_000


def marginal_gain(coverage: DataFrame, covered: DataFrame, group: list[str], view: str, voxel: str) -> DataFrame:
    """Voxels that each view would add to ``covered`` (group, voxel); views that add none keep a 0."""
    new = coverage.join(covered, [*group, voxel], "left_anti").groupBy(*group, view).agg(F.count_distinct(voxel).alias("gain"))
    return coverage.select(*group, view).distinct().join(new, [*group, view], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))


def seen_by_at_least(coverage: DataFrame, group: list[str], view: str, voxel: str, k: int) -> DataFrame:
    """The coverage of voxels that at least ``k`` views see."""
    often = coverage.groupBy(*group, voxel).agg(F.count_distinct(view).alias("_k")).where(F.col("_k") >= k)
    return coverage.join(often.drop("_k"), [*group, voxel], "left_semi")


def coverage_ratio(coverage: DataFrame, selection: DataFrame, group: list[str], view: str, voxel: str) -> DataFrame:
    """Covered share of each group's voxels by the selected views: group, n_covered, n_voxels, ratio."""
    universe = coverage.groupBy(*group).agg(F.count_distinct(voxel).alias("n_voxels"))
    hit = coverage.join(selection, [*group, view], "left_semi").groupBy(*group).agg(F.count_distinct(voxel).alias("n_covered"))
    out = universe.join(hit, group, "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0)))
    return out.withColumn("ratio", F.round(F.col("n_covered") / F.col("n_voxels"), 6))


def needed_voxels(coverage: DataFrame, covered: DataFrame, candidates: DataFrame, group: list[str], view: str, voxel: str) -> DataFrame:
    """Distinct voxels not yet covered that a candidate view sees: group, voxel."""
    open_ = coverage.join(covered, [*group, voxel], "left_anti")
    return open_.join(candidates, [*group, view], "left_semi").select(*group, voxel).distinct()


def greedy_order(views: np.ndarray, voxels: np.ndarray, start: Any = None, budget: int | None = None) -> list[tuple[Any, int]]:
    """Views of one group in greedy order with their gains, from ``start`` on if one is given; ties go to the smaller view."""
    ids, view = np.unique(views, return_inverse=True)
    _, voxel = np.unique(voxels, return_inverse=True)
    out: list[tuple[Any, int]] = []
    while len(view) and (budget is None or len(out) < budget):
        gains = np.bincount(view, minlength=len(ids))
        best = int(np.searchsorted(ids, start)) if start is not None and not out else int(gains.argmax())
        out.append((ids[best].item(), int(gains[best])))
        gone = np.zeros(int(voxel.max()) + 1, bool)
        gone[voxel[view == best]] = True
        left = ~gone[voxel]
        view, voxel = view[left], voxel[left]
    return out


def greedy_cover(
    coverage: DataFrame,
    group: list[str],
    view: str,
    voxel: str,
    start: DataFrame | None = None,
    budget: int | None = None,
    small: int = SMALL_GROUP,
    max_rounds: int = 1000,
) -> DataFrame:
    """Greedy set cover of every group: group, step, view, gain, n_covered; ties go to the smaller view.

    Groups of at most ``small`` rows are covered one by one inside tasks, after one shuffle. The larger ones are
    covered by rounds over all of them: each round picks one view for every unfinished group in one job and keeps
    only the rows of voxels that are still open, so rounds get cheaper; the open rows are written to the shared
    folder, which cuts the lineage. ``start`` (group, view) fixes the first view of the groups it names; ``budget``
    ends every group after so many views. Raises if ``max_rounds`` rounds leave a group uncovered.
    """
    rows = written(coverage.select(*group, view, voxel).distinct(), "cover")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    first = sizes if start is None else sizes.join(start.select(*group, F.col(view).alias("_start")).dropDuplicates(group), group, "left")
    first = first if start is not None else first.withColumn("_start", F.lit(None))
    first = written(first.withColumn("_start", F.col("_start").cast(rows.schema[view].dataType)), "cover-sizes")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{g} {types[g]}" for g in group), f"step int, {view} {types[view]}, gain long, n_covered long"])

    def cover(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        start = rows["_start"].iloc[0]
        picks = greedy_order(rows[view].to_numpy(), rows[voxel].to_numpy(), None if pd.isna(start) else start, budget)
        total = np.cumsum([gain for _, gain in picks])
        return pd.DataFrame([(*key, step, v, gain, n) for step, ((v, gain), n) in enumerate(zip(picks, total, strict=True))], columns=[*group, "step", view, "gain", "n_covered"])

    out = rows.join(first.where(F.col("_size") <= small), group).groupBy(*group).applyInPandas(cover, schema)
    if (large := first.where(F.col("_size") > small)).isEmpty():
        return out
    return out.unionByName(_cover_by_rounds(rows.join(large.select(*group), group, "left_semi"), large.select(*group, "_start"), group, view, voxel, budget, max_rounds))


def _cover_by_rounds(coverage: DataFrame, start: DataFrame, group: list[str], view: str, voxel: str, budget: int | None, max_rounds: int) -> DataFrame:
    """The rounds of ``greedy_cover``; picks are appended to one folder."""
    spark = coverage.sparkSession
    open_, path = written(coverage, "cover-open"), scratch_path(spark, "cover-picks")
    for step in range(min(budget or max_rounds, max_rounds)):
        gains = open_.groupBy(*group, view).agg(F.count(F.lit(1)).alias("gain"))
        rank = F.struct(F.col("gain"), -F.col(view))
        if step == 0:
            gains = gains.join(start, group, "left")
            rank = F.struct(F.coalesce(F.col(view) == F.col("_start"), F.lit(False)).alias("first"), F.col("gain"), -F.col(view))
        best = gains.groupBy(*group).agg(F.max_by(F.struct(view, "gain"), rank).alias("_b"))
        chosen = best.select(*group, F.lit(step).alias("step"), F.col(f"_b.{view}").alias(view), F.col("_b.gain").alias("gain"))
        chosen.write.parquet(f"{path}/step={step}")
        chosen = spark.read.schema(chosen.schema).parquet(f"{path}/step={step}").select(*group, view)
        gone = open_.join(chosen, [*group, view], "left_semi").select(*group, voxel)
        open_ = written(open_.join(gone, [*group, voxel], "left_anti"), "cover-open")
        if open_.isEmpty():
            break
    else:
        if budget is None:
            raise RuntimeError(f"groups are still uncovered after {max_rounds} rounds")
    picks = spark.read.schema(", ".join(f"{c} {t}" for c, t in [*((g, coverage.schema[g].dataType.simpleString()) for g in group), ("step", "int"), (view, coverage.schema[view].dataType.simpleString()), ("gain", "long")])).parquet(path)
    run = Window.partitionBy(*group).orderBy("step")
    return picks.withColumn("n_covered", F.sum("gain").over(run)).select(*group, "step", view, "gain", "n_covered")


def greedy_rollouts(coverage: DataFrame, group: list[str], view: str, voxel: str, work: int = 20_000_000) -> DataFrame:
    """Greedy cover of every group from every one of its views: group, start, step, view, gain, n_covered.

    A group's starts are spread over tasks of about ``work`` rows times starts, each of which holds the group's rows.
    """
    rows = written(coverage.select(*group, view, voxel).distinct(), "rollout-rows")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(view).alias("_k"))
    parts = F.greatest(F.lit(1), F.least(F.col("_k"), F.ceil(F.col("_n") * F.col("_k") / work))).cast("int")
    spread = rows.join(sizes.select(*group, parts.alias("_parts")), group).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{g} {types[g]}" for g in group), f"start {types[view]}, step int, {view} {types[view]}, gain long, n_covered long"])

    def roll(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        views, voxels, out = rows[view].to_numpy(), rows[voxel].to_numpy(), []
        for start in np.unique(views)[int(key[-1]) :: int(rows["_parts"].iloc[0])]:
            covered = 0
            for step, (v, gain) in enumerate(greedy_order(views, voxels, start)):
                covered += gain
                out.append((*key[:-1], start.item(), step, v, gain, covered))
        return pd.DataFrame(out, columns=[*group, "start", "step", view, "gain", "n_covered"])

    return spread.groupBy(*group, "_part").applyInPandas(roll, schema)


def utility(gain: Column, cost: Column, group: list[str], gamma: float) -> Column:
    """(1 - gamma) * gain / total gain - gamma * cost / total cost within a group; a total of nothing counts as 1."""
    w = Window.partitionBy(*group)
    total = lambda c: F.when(F.abs(F.sum(c).over(w)) <= 1e-12, 1.0).otherwise(F.sum(c).over(w))
    return (1 - gamma) * gain / total(gain) - gamma * cost / total(cost)


def argmax_within(df: DataFrame, group: list[str], score: str, tie: str, tolerance: float = 1e-12) -> DataFrame:
    """The row of each group with the smallest ``tie`` among those within ``tolerance`` of the best score."""
    best = F.max(score).over(Window.partitionBy(*group))
    near = df.withColumn("_best", best).where(F.col(score) >= F.col("_best") - tolerance).drop("_best")
    row = F.struct(*(c for c in df.columns if c not in group))
    return near.groupBy(*group).agg(F.min_by(row, F.col(tie)).alias("_r")).select(*group, "_r.*")


def threshold_then_cheapest(df: DataFrame, group: list[str], gain: str, cost: str, tie: str, tau: float) -> DataFrame:
    """Of the rows with at least ``tau`` of the group's best gain the cheapest, then the largest gain, then ``tie``."""
    best = F.max(gain).over(Window.partitionBy(*group))
    good = df.withColumn("_best", best).where(F.col(gain) + 1e-9 >= tau * F.col("_best")).drop("_best")
    row = F.struct(*(c for c in df.columns if c not in group))
    return good.groupBy(*group).agg(F.min_by(row, F.struct(F.col(cost), -F.col(gain), F.col(tie))).alias("_r")).select(*group, "_r.*")
