"""Ordered-sequence operators: running maxima and gains, stabilisation, checkpoints, splits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewmill.operators.positions import positions
from viewmill.session import broadcast_if_small


def monotone_gain(points: DataFrame, key: list[str], n: str, y: str) -> DataFrame:
    """Adds ``y_mono`` (running maximum by ``n``) and ``gain`` to the next point (null at the last)."""
    w = Window.partitionBy(*key).orderBy(n)
    running = points.withColumn("y_mono", F.max(y).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return running.withColumn("gain", F.lead("y_mono").over(w) - F.col("y_mono"))


def stabilised_at(steps: DataFrame, key: list[str], order: str, size: str, tau: float = 0.01, patience: int = 3) -> DataFrame:
    """For each key the first ``order`` at which growth stayed below ``tau`` for ``patience`` steps in a row; null if never.

    Growth is (size - previous) / max(previous, 1); the first step has none. A run of small growth is an
    island between the steps that grew, so its length is a running count within the island.
    """
    w = Window.partitionBy(*key).orderBy(order)
    previous = F.lag(size).over(w)
    small = F.coalesce(((F.col(size) - previous) / F.greatest(previous, F.lit(1)) < tau).cast("int"), F.lit(0))
    islands = steps.withColumn("_small", small).withColumn("_island", F.sum(1 - F.col("_small")).over(w))
    run = F.sum("_small").over(Window.partitionBy(*key, "_island").orderBy(order))
    return islands.withColumn("_run", run).groupBy(*key).agg(
        F.min(F.when(F.col("_run") >= patience, F.col(order))).alias("stable_at"),
        F.max("_run").alias("longest_run"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def checkpoints(steps: DataFrame, key: list[str], order: str, budgets: list[int], value: str) -> DataFrame:
    """Value at the rows whose position (from 0) is a budget, else the last one known: key, budget, value, reached."""
    position = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    ranked = steps.withColumn("_at", position)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col("_at")))
    agg = ranked.groupBy(*key).agg(
        last.alias("_terminal"), F.max("_at").alias("_end"), *(F.max(F.when(F.col("_at") == b, F.col(value))).alias(f"_v{b}") for b in budgets)
    )
    rows = F.array(
        *(
            F.struct(F.lit(b).alias("budget"), F.coalesce(f"_v{b}", "_terminal").alias("value"), (F.col("_end") >= b).alias("reached"))
            for b in budgets
        )
    )
    return agg.select(*key, F.inline(rows))


def first_seen(events: DataFrame, key: list[str], item: str, order: str) -> DataFrame:
    """First step at which each item was seen, and per step how many items were new and known: key, order, n_new, n_known."""
    first = events.groupBy(*key, item).agg(F.min(order).alias(order))
    new = first.groupBy(*key, order).agg(F.count(F.lit(1)).alias("n_new"))
    return new.withColumn("n_known", F.sum("n_new").over(Window.partitionBy(*key).orderBy(order)))


def hash_order(*cols: str, seed: int = 42) -> Column:
    """A reproducible random order: the hash of seed and key, as hexadecimal text."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)), 256)


def hamilton_quotas(counts: DataFrame, n: str, target: int, tie: Column) -> DataFrame:
    """Largest-remainder quotas that sum to ``target``: adds ``quota``. Ties of the fraction go to ``tie``'s order."""
    total = F.sum(n).over(Window.partitionBy())
    exact = F.col(n) * F.lit(float(target)) / total
    base = counts.withColumn("_exact", exact).withColumn("_base", F.floor(F.col("_exact") + 1e-9))
    rest = F.lit(target) - F.sum("_base").over(Window.partitionBy())
    turn = F.row_number().over(Window.orderBy(F.round(F.col("_exact") - F.col("_base"), 9).desc(), tie))
    return base.withColumn("quota", F.col("_base") + (turn <= rest).cast("long")).drop("_exact", "_base")


def water_level(counts: DataFrame, n: str, target: int) -> DataFrame:
    """Balanced quotas: as equal as availability lets them be, summing to ``target`` where that many exist.

    Sorted by availability, the categories below the level give all they have; the level is what the
    others share. One remainder unit each goes to the largest categories first.
    """
    w = Window.orderBy(n, *[c for c in counts.columns if c != n])
    full = counts.withColumns(
        {
            "_i": F.row_number().over(w),
            "_before": F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_all": F.count(F.lit(1)).over(Window.partitionBy()),
        }
    )
    share = (F.lit(target) - F.col("_before")) / (F.col("_all") - F.col("_i") + 1)
    marked = full.withColumn("_open", F.col(n) > share)
    level = F.min(F.when(F.col("_open"), F.struct("_i", F.floor(F.greatest(share, F.lit(0.0))).alias("lvl"), "_before"))).over(Window.partitionBy())
    out = marked.withColumn("_level", level)
    rest = F.lit(target) - F.col("_level._before") - F.col("_level.lvl") * (F.col("_all") - F.col("_level._i") + 1)
    from_top = F.col("_all") - F.col("_i") + 1
    capped = F.col("_level.lvl") + (from_top <= rest).cast("long")
    quota = F.when(F.col("_level").isNull() | (F.col("_i") < F.col("_level._i")), F.col(n)).otherwise(F.least(F.col(n), capped))
    return out.withColumn("quota", quota.cast("long")).select(*counts.columns, "quota")


def take_quota(rows: DataFrame, group: list[str], quotas: DataFrame, order: list[Column]) -> DataFrame:
    """The first ``quota`` rows of each group in ``order``. Groups are cut into slices by input partition first,
    so that no more than the quota of each slice reaches the group's own window."""
    joined = rows.join(broadcast_if_small(quotas.select(*group, "quota")), group)
    in_slice = F.row_number().over(Window.partitionBy(*group, "_slice").orderBy(*order))
    sliced = joined.withColumn("_slice", F.spark_partition_id() % 64)
    few = sliced.withColumn("_r", in_slice).where("_r <= quota").drop("_r", "_slice")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return few.withColumn("_r", rank).where("_r <= quota").drop("_r", "quota")


def tiled_to(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Each group's rows repeated in order until it has ``size`` rows, exactly; larger groups are cut. Adds place.

    Places are numbered across partitions, so no group is gathered into one task; row ``place`` of n stands
    ceil((size - place + 1) / n) times.
    """
    placed = positions(df, group, [F.asc(c) for c in order], size, "place")
    n = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    times = F.ceil((F.lit(size) - F.col("place") + 1) / F.col("_n")).cast("int")
    return placed.join(n, group).withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_n", "_copy")
