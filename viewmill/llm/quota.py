"""A sample that follows target shares of categories, with floors, caps and a shortfall report (problem 5).

Categories are counted, integer quotas are allocated by largest remainder between a floor and what is
available, and of each category the objects with the smallest random keys are drawn. The keys are a
seeded hash of the object, so a draw can be repeated and a smaller quota gives a subset.

Allocation (``quotas``): each line gets ``scale * share * target_n`` held between
lower = min(min_count, available) and upper = available. The scale for which a request sums to
target_n is read off the running totals of the points where a line leaves its floor or meets its cap;
fractions are rounded down and the rest goes to the largest fractions (ties: category names).
If the floors alone exceed target_n all lines get their floor; if the caps fall short, their cap.

Defined results
* a line cannot be met if its category has fewer objects than max(min_count, round(share * target_n));
* category names compare without case and outer white space, hyphens and blanks as underscores; null,
  empty and unlisted categories are in no line;
* an object redelivered in one category counts once; delivered under two categories it counts in both;
* a null or negative share, floor or size counts as 0; an empty source leaves every line at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewmill.llm.topn import positions
from viewmill.session import broadcast_if_small, clean_key, written

CATEGORY = ["shape_key", "fill_key"]
KEY_BINS = 1 << 16


def category_key(name: str) -> Column:
    trimmed = F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))
    key = F.regexp_replace(trimmed, r"[\s-]", "_")
    return F.when(key != "", key)


def categorised(annotations: DataFrame) -> DataFrame:
    """Distinct objects of each category: shape_key, fill_key, uid."""
    rows = annotations.select(category_key("shape_type").alias("shape_key"), category_key("fill_bucket").alias("fill_key"), clean_key("uid").alias("uid"))
    return rows.where("shape_key is not null and fill_key is not null and uid is not null").distinct()


def strata(objects: DataFrame, target_mix: DataFrame) -> DataFrame:
    """Every line of target_mix with its need and the number of objects there are."""
    at_least_0 = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    lines = target_mix.select(
        "request_id",
        "shape_type",
        "fill_bucket",
        category_key("shape_type").alias("shape_key"),
        category_key("fill_bucket").alias("fill_key"),
        at_least_0(F.col("target_share")).alias("share"),
        at_least_0(F.col("min_count")).cast("long").alias("min_count"),
        at_least_0(F.col("target_n")).cast("long").alias("target_n"),
    )
    counts = objects.groupBy(*CATEGORY).agg(F.count(F.lit(1)).alias("available"))
    wanted = F.greatest(F.col("min_count"), F.round(F.col("share") * F.col("target_n")).cast("long"))
    return lines.join(counts, CATEGORY, "left").withColumns({"available": F.coalesce("available", F.lit(0)), "wanted": wanted})


def quotas(lines: DataFrame) -> DataFrame:
    """Adds ``quota`` to the lines of ``strata``."""
    ideal = F.col("share") * F.col("target_n")
    bounded = lines.withColumns(
        {"ideal": ideal, "lower": F.least("min_count", "available").cast("double"), "upper": F.col("available").cast("double")}
    )
    # S(scale) = constant + scale * slope between two neighbouring points
    leaves = F.struct((F.col("lower") / F.col("ideal")).alias("scale"), (-F.col("lower")).alias("constant"), F.col("ideal").alias("slope"))
    meets = F.struct((F.col("upper") / F.col("ideal")).alias("scale"), F.col("upper").alias("constant"), (-F.col("ideal")).alias("slope"))
    points = bounded.where("ideal > 0").select("request_id", F.inline(F.array(leaves, meets)))
    floors = bounded.groupBy("request_id").agg(F.sum("lower").alias("floors"), F.sum("upper").alias("caps"), F.max("target_n").alias("size"))
    run = Window.partitionBy("request_id").orderBy("scale", "slope").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("request_id").orderBy("scale", "slope")
    curve = (
        points.join(floors, "request_id")
        .withColumns({"c": F.col("floors") + F.sum("constant").over(run), "s": F.sum("slope").over(run), "until": F.lead("scale").over(ahead)})
        .withColumn("at", (F.col("size") - F.col("c")) / F.when(F.col("s") > 1e-9, F.col("s")))
        .where("at >= scale - 1e-9 and (until is null or at <= until + 1e-9)")
        .groupBy("request_id")
        .agg(F.min("at").alias("scale"))
    )
    request = Window.partitionBy("request_id")
    full = F.sum("upper").over(request) <= F.col("target_n")
    over = F.sum("lower").over(request) >= F.col("target_n")
    exact = (
        F.when(full, F.col("upper"))
        .when(over, F.col("lower"))
        .otherwise(F.greatest("lower", F.least("upper", F.coalesce("scale", F.lit(0.0)) * F.col("ideal"))))
    )
    base = F.floor(F.col("exact") + 1e-9)
    spread = bounded.join(curve, "request_id", "left").withColumn("exact", exact).withColumn("base", base)
    rest = F.greatest(F.col("target_n") - F.sum("base").over(request), F.lit(0))
    can_grow = (F.col("base") < F.col("upper")) & (F.col("ideal") > 0)
    turn = F.row_number().over(
        Window.partitionBy("request_id").orderBy(can_grow.desc(), F.round(F.col("exact") - F.col("base"), 9).desc(), *CATEGORY, "shape_type", "fill_bucket")
    )
    quota = F.col("base") + (can_grow & (turn <= F.col("rest"))).cast("long")
    return spread.withColumn("rest", rest).withColumn("quota", quota).select(*lines.columns, "quota")


def random_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("uid"))


def draw(objects: DataFrame, allotted: DataFrame, seed: int = 42) -> DataFrame:
    """The sampled objects: the columns of their line but for the category keys, uid, draw_rank.

    A histogram of the leading key bits bounds, for each category, the keys that the largest quota can
    reach; only those rows are sorted, and ``positions`` numbers them across partitions, so a category
    with a third of all objects is no task of its own.
    """
    keyed = objects.withColumn("key", random_key(seed)).withColumn("bin", F.shiftright("key", 48))
    largest = allotted.groupBy(*CATEGORY).agg(F.max("quota").alias("most"))
    bins = keyed.groupBy(*CATEGORY, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*CATEGORY).orderBy("bin")) - F.col("n")
    needed = bins.withColumn("before", before).join(largest, CATEGORY).where("before < most")
    reach = written(needed.groupBy(*CATEGORY).agg(F.max("bin").alias("last_bin")), "quota-reach")
    near = keyed.join(broadcast_if_small(reach), CATEGORY).where("bin <= last_bin").select(*CATEGORY, "key", "uid")
    ranked = positions(near, CATEGORY, [F.asc("key"), F.asc("uid")], None, "draw_rank")
    lines = written(allotted, "quota-lines")
    return ranked.join(broadcast_if_small(lines), CATEGORY).where("draw_rank <= quota").select(*lines.columns, "uid", "draw_rank").drop(*CATEGORY)


def report(objects: DataFrame, lines: DataFrame, seed: int = 42) -> DataFrame:
    """The lines with their quota, how many were drawn for it, and the shortfall against what the line needs.

    Of each category the smallest keys are drawn up to the larger of quota and need; the quota's sample are the
    first of them, and a line falls short by as many as are missing from its need.
    """
    allotted = written(quotas(lines).withColumnRenamed("quota", "allotted"), "quota-allotted")
    drawn = draw(objects, allotted.withColumn("quota", F.greatest("allotted", "wanted")), seed)
    line = ["request_id", "shape_type", "fill_bucket"]
    counts = drawn.groupBy(*line).agg(F.count_if(F.col("draw_rank") <= F.col("allotted")).alias("n_drawn"), F.count_if(F.col("draw_rank") <= F.col("wanted")).alias("n_met"))
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in line]
    met, n_drawn = F.coalesce("c.n_met", F.lit(0)), F.coalesce("c.n_drawn", F.lit(0)).alias("n_drawn")
    both = allotted.alias("l").join(counts.alias("c"), on, "left")
    return both.select("l.*", n_drawn, (F.col("wanted") - met).alias("shortfall")).withColumnRenamed("allotted", "quota")
