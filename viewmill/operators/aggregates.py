"""Aggregations: robust statistics, summaries, histograms over fixed domains, conditional statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewmill.session import broadcast_if_small, written


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys stand once, those of the left side."""
    on = [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys]
    rest = [F.col(f"_r.{c}") for c in right.columns if c not in keys]
    joined = left.alias("_l").join(right.alias("_r"), on, how) if keys else left.alias("_l").crossJoin(right.alias("_r"))
    return joined.select("_l.*", *rest)


def exact_percentiles(df: DataFrame, group: list[str], column: str, probs: list[float], accuracy: int = 10_000) -> DataFrame:
    """Exact percentiles (linear interpolation) without gathering a group: group columns, prob, n, x.

    A mergeable sketch brackets each percentile to a few ten-thousandths of the ranks; one more pass
    counts what lies below the bracket and orders only what lies inside. Where a bracket turns out not to
    hold its rank, a further pass takes all values of the group. Nulls and NaN are left out; a null group
    is a group; a group without values gives no row.
    """
    values = df.select(*group, F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    slack = 2.0 / accuracy
    edges = [(max(0.0, p - slack), min(1.0, p + slack)) for p in probs]
    sketch = F.percentile_approx("x", [e for pair in edges for e in pair], accuracy)
    ends = values.groupBy(*group).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), sketch.alias("q"))
    brackets = F.array(
        *(
            F.struct(
                F.lit(p).alias("prob"),
                (F.col("least") if a == 0 else F.get("q", 2 * i)).alias("lo"),
                (F.col("most") if b == 1 else F.get("q", 2 * i + 1)).alias("hi"),
            )
            for i, (p, (a, b)) in enumerate(zip(probs, edges, strict=True))
        )
    )
    targets = written(ends.select(*group, "n", F.inline(brackets)), "brackets")
    found = written(_in_brackets(values, targets, group), "percentiles")
    missed = found.where("a is null or b is null")
    if not missed.isEmpty():
        everything = missed.select(*group, "n", "prob", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
        found = found.where("a is not null and b is not null").unionByName(_in_brackets(values, everything, group))
    x = F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))
    return found.select(*group, "prob", "n", x.alias("x"))


def _in_brackets(values: DataFrame, targets: DataFrame, group: list[str]) -> DataFrame:
    """The values ``a`` and ``b`` at the ranks below and above each target, null where its bracket doesn't hold them."""
    pairs = null_safe(values, broadcast_if_small(targets), group)
    # -1: below the bracket, 0: inside, 1: above; outside only the nearest value can be asked for
    side = F.when(F.col("x") < F.col("lo"), -1).when(F.col("x") > F.col("hi"), 1).otherwise(0)
    counts = (
        pairs.withColumn("side", side)
        .groupBy(*group, "prob", "n", "side", F.when(F.col("side") == 0, F.col("x")).alias("v"))
        .agg(F.count(F.lit(1)).alias("k"), F.when(F.col("side") < 0, F.max("x")).otherwise(F.min("x")).alias("x"))
    )
    upto = F.sum("k").over(Window.partitionBy(*group, "prob").orderBy("side", "v"))
    ranked = counts.withColumns({"upto": upto, "at": (F.col("n") - 1) * F.col("prob")})

    def value_at(r: Column) -> Column:
        first, last = F.col("upto") - F.col("k"), F.col("upto") - 1
        nearest = (F.col("side") == 0) | ((F.col("side") < 0) & (r == last)) | ((F.col("side") > 0) & (r == first))
        return F.max(F.when((first <= r) & (r <= last) & nearest, F.col("x")))

    return ranked.groupBy(*group, "prob").agg(
        F.max("n").alias("n"), F.max("at").alias("at"), value_at(F.floor("at")).alias("a"), value_at(F.ceil("at")).alias("b")
    )


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """One row for each value: kept columns, measure, x."""
    entries = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(*keep, F.inline(entries))


def robust_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: count, median, median absolute deviation and tertile cuts of each column."""
    values = written(long_form(df, columns), "measures")
    thirds = [1.0 / 3, 0.5, 2.0 / 3]
    first = written(exact_percentiles(values, ["measure"], "x", thirds), "medians")
    medians = first.where("prob = 0.5").select("measure", F.col("x").alias("med"))
    apart = values.join(F.broadcast(medians), "measure").select("measure", F.abs(F.col("x") - F.col("med")).alias("x"))
    mads = exact_percentiles(apart, ["measure"], "x", [0.5]).select("measure", F.lit("mad").alias("what"), "x")
    names = F.when(F.col("prob") == 0.5, "med").when(F.col("prob") < 0.5, "q1").otherwise("q2")
    cells = first.select("measure", names.alias("what"), "x").unionByName(mads)
    cells = cells.unionByName(first.where("prob = 0.5").select("measure", F.lit("n").alias("what"), F.col("n").cast("double").alias("x")))
    pick = lambda what, c: F.max(F.when((F.col("what") == what) & (F.col("measure") == c), F.col("x"))).alias(f"{what}_{c}")
    return cells.agg(*(pick(what, c) for c in columns for what in ("med", "mad", "q1", "q2", "n")))


def five_numbers(values: DataFrame, group: list[str]) -> DataFrame:
    """Count, mean, minimum, quartiles (linear interpolation) and maximum of column x for each group.

    A null group is a group; one without values keeps its row, with a count of 0 and nulls.
    """
    usable = values.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    plain = usable.groupBy(*group).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    quartiles = exact_percentiles(usable, group, "x", [0.25, 0.5, 0.75]).groupBy(*group).agg(
        *(F.max(F.when(F.col("prob") == p, F.col("x"))).alias(name) for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)))
    )
    return null_safe(plain, quartiles, group, "left")


def sample_std(c: str) -> Column:
    """Sample standard deviation: 0 for one value, null for none."""
    return F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))


def distinct_with_null(c: str) -> Column:
    """Number of distinct values, null being one."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def unpivot_bins(df: DataFrame, bins: dict[str, Column], values: list[str]) -> DataFrame:
    """Statistics of each value given the bin of each binned column: long form (binned, bin, value, n, mean, min, max)."""
    entries = F.array(*(F.struct(F.lit(k).alias("binned"), b.cast("long").alias("bin")) for k, b in bins.items()))
    numbers = F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("x")) for v in values))
    long = df.select(F.explode(entries).alias("b"), numbers.alias("vs")).select("b.*", F.inline("vs"))
    return (
        long.where("bin is not null and x is not null and binned != value")
        .groupBy("binned", "bin", "value")
        .agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))
    )


def filled_histogram(counts: DataFrame, domain: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Counts for every key of ``domain``, 0 where there is none."""
    return domain.join(counts, keys, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def five_numbers_by_sets(values: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """``five_numbers`` for every subset of ``columns``; a column outside the subset is null, ``grouping`` names those in it."""
    subsets = [[c for i, c in enumerate(columns) if mask >> i & 1] for mask in range(1 << len(columns))]
    keys = F.array(*(F.struct(F.lit(",".join(s)).alias("grouping"), *(F.col(c).alias(c) if c in s else F.lit(None).cast("string").alias(c) for c in columns)) for s in subsets))
    rows = values.select(*keep, "x", F.inline(keys))
    return five_numbers(rows, ["grouping", *columns, *keep])
