"""Records that stand in an evaluation and in a training split, exactly or almost (problem 3).

An exact prefix-filter join on rare shingles. A record is a set of shingles (pieces of its uid, or
grid cells of its measurements). If two records must share ``t`` of ``k`` shingles, they share one of
the ``k - t + 1`` rarest, counted over both sides, so only those are indexed; the pairs that meet in
one are held against the position bound (can the rest still reach ``t``?) and then verified in full. Within
a prefix of k - t + 1 places the bound holds everywhere; it excludes pairs where a longer prefix is indexed.
Equal records of a side are joined once, as a class, and expanded to member pairs at the end.

Defined results
* the uid is the first run of 32 hex digits after leaving out hyphens, braces and blanks, in lower
  case; a uid without such a run (or null) matches nothing by uid;
* a measurement that is null or NaN is missing; a record with one missing matches nothing by measurement;
* "0.1 % apart" means a difference of at most 0.1 % of the larger absolute value; 0 matches only 0;
* a member listed twice gives its pairs once; members of neither kind of split are left out;
* an empty side gives no pairs; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewmill.operators.salted import salted_join
from viewmill.session import written

HOT_ROWS = 1_000_000

TRAIN = ("main_raw_train", "main_balanced_train")
EVAL = ("main_analysis_test", "hidden_test", "demo_hidden_test", "demo_long_tail")
EQUAL = ("observation_saturation_view_num", "selected_view_count")
CLOSE = ("self_occlusion_attribute", "gt_surface_voxel_count", "area", "volume")


def uid_digits(uid: Column) -> Column:
    plain = F.regexp_replace(F.lower(uid), r"[-{}\s]", "")
    digits = F.regexp_extract(plain, r"(?<![0-9a-f])([0-9a-f]{32})(?![0-9a-f])", 1)
    return F.when(digits != "", digits)


def with_rarity(shingles: DataFrame, counts: DataFrame, prefix: int | None) -> DataFrame:
    """The ``prefix`` rarest shingles of each record with their place among all, rarest first (all if None).

    ``shingles``: record (a struct), shingle. ``counts``: shingle, freq.
    """
    ranked = (
        shingles.join(counts, "shingle", "left")
        .groupBy("record")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "shingle"))).alias("s"))
    )
    kept = F.slice("s", 1, prefix) if prefix else F.col("s")
    each = ranked.select("record", F.size("s").alias("size"), F.posexplode(kept).alias("place", "s"))
    return each.select("record", "size", "place", F.col("s.shingle").alias("shingle"))


def shingle_join(index: DataFrame, probe: DataFrame, need: Column, keep: Column, at_most: int | None = None, hot: int = HOT_ROWS) -> DataFrame:
    """Pairs of records that meet in an indexed shingle, can reach the overlap ``need`` and pass ``keep``.

    Both sides have record, size, place, shingle; ``keep`` compares ``e`` with ``t``. From the places at which
    they meet two records can still share at most the smaller number of shingles left. A shingle with more
    than ``hot`` probing records is salted; ``at_most`` bounds the probing rows where that is known.
    """
    left = index.select("shingle", F.col("record").alias("e"), F.col("size").alias("es"), F.col("place").alias("ep"))
    right = probe.select("shingle", F.col("record").alias("t"), F.col("size").alias("ts"), F.col("place").alias("tp"))
    reach = F.least(F.col("es") - F.col("ep"), F.col("ts") - F.col("tp")) >= need
    return salted_join(right, left, "shingle", hot, at_most).where(reach & keep).select("e", "t").distinct()


def uid_pairs(evals: DataFrame, trains: DataFrame, pieces: int = 5, differ: int = 2, n_trains: int | None = None) -> DataFrame:
    """Pairs of distinct digits that differ in at most ``differ`` positions: columns e, t.

    A differing position spoils one of the ``pieces`` pieces, so ``pieces - differ`` are shared.
    """
    cuts = [round(32 * i / pieces) for i in range(pieces + 1)]

    def shingles(df: DataFrame) -> DataFrame:
        piece = lambda i: F.conv(F.substring("digits", cuts[i] + 1, cuts[i + 1] - cuts[i]), 16, 10).cast("long")
        each = F.array(*(piece(i) * pieces + i for i in range(pieces)))
        words = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring("digits", i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
        distinct = df.select("digits").where("digits is not null").distinct()
        return distinct.select(F.struct("digits", words.alias("w")).alias("record"), F.explode(each).alias("shingle"))

    left, right = shingles(evals), shingles(trains)
    counts = left.select("shingle").unionByName(right.select("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("freq"))

    def distance(a: Column, b: Column) -> Column:
        total = F.lit(0)
        for i in range(4):
            x = F.get(a, i).bitwiseXOR(F.get(b, i))
            any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
            total = total + F.bit_count(any_bit.bitwiseAND(F.lit(0x11111111).cast("long")))
        return total

    prefix = differ + 1
    near = distance(F.col("e.w"), F.col("t.w")) <= differ
    found = shingle_join(
        with_rarity(left, counts, prefix), with_rarity(right, counts, prefix), F.lit(pieces - differ), near, None if n_trains is None else prefix * n_trains
    )
    return found.select(F.col("e.digits").alias("e"), F.col("t.digits").alias("t"))


def measure_pairs(evals: DataFrame, trains: DataFrame, tolerance: float = 0.001, cell: float = 0.01, n_trains: int | None = None) -> DataFrame:
    """Pairs of distinct measurement tuples that agree: columns e, t (structs of the six values).

    The four close measurements lie on a logarithmic grid of ``cell``. A record's two shingles are the
    equal ones with two cells each. A training record takes every cell within the tolerance, so an
    evaluation record that agrees has both of its shingles there: its rarer one is the prefix.
    """
    widen = -math.log1p(-tolerance) * 1.01

    def shingles(df: DataFrame, reach: float) -> DataFrame:
        known = F.lit(True)
        for c in (*EQUAL, *CLOSE):
            known &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        record = F.struct(*EQUAL, *(F.col(c).cast("double").alias(c) for c in CLOSE))
        distinct = df.where(known).select(record.alias("record")).distinct()

        def cells(name: str) -> Column:
            x = F.col(f"record.{name}")
            log = F.ln(F.abs(x))
            at = lambda d: F.floor((log + d) / cell).cast("string")
            sign = F.when(x < 0, "-").otherwise("+")
            spots = F.array_distinct(F.array(F.concat(sign, at(-reach)), F.concat(sign, at(reach))))
            return F.when(x == 0, F.array(F.lit("0"))).otherwise(spots)

        def both(tag: str, first: str, second: str) -> Column:
            head = F.concat_ws("|", F.lit(tag), *(F.col(f"record.{c}").cast("string") for c in EQUAL))
            return F.flatten(F.transform(cells(first), lambda a: F.transform(cells(second), lambda b: F.xxhash64(F.concat_ws("|", head, a, b)))))

        tokens = F.concat(both("1", CLOSE[0], CLOSE[1]), both("2", CLOSE[2], CLOSE[3]))
        return distinct.select("record", F.explode(F.array_distinct(tokens)).alias("shingle"))

    left, right = shingles(evals, 0.0), shingles(trains, widen)
    counts = right.groupBy("shingle").agg(F.count(F.lit(1)).alias("freq"))
    agree = F.lit(True)
    for c in EQUAL:
        agree &= F.col(f"e.{c}") == F.col(f"t.{c}")
    for c in CLOSE:
        a, b = F.col(f"e.{c}"), F.col(f"t.{c}")
        agree &= F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * tolerance
    probe = right.select("record", F.lit(1).alias("size"), F.lit(0).alias("place"), "shingle")
    most = None if n_trains is None else 8 * n_trains  # two shingles of at most two cells by two
    return shingle_join(with_rarity(left, counts, 1), probe, F.lit(1), agree, most)


def cross_split_pairs(members: DataFrame) -> DataFrame:
    """All pairs (eval_member, train_member) of the same or nearly the same object."""
    rows = written(
        members.where(F.col("split_name").isin(*TRAIN, *EVAL)).select(
            "member_id", F.col("split_name").isin(*TRAIN).alias("is_train"), uid_digits(F.col("uid")).alias("digits"), *EQUAL, *CLOSE
        ),
        "members",
    )
    evals, trains, n_trains = rows.where("not is_train"), rows.where("is_train"), rows.count()
    by_uid = (
        uid_pairs(evals, trains, n_trains=n_trains)
        .join(evals.select("member_id", F.col("digits").alias("e")).withColumnRenamed("member_id", "eval_member"), "e")
        .join(trains.select("member_id", F.col("digits").alias("t")).withColumnRenamed("member_id", "train_member"), "t")
    )

    def six(df: DataFrame, member: str, side: str) -> DataFrame:
        return df.select(F.col("member_id").alias(member), *(F.col(c).cast("double" if c in CLOSE else "int").alias(f"{side}_{c}") for c in (*EQUAL, *CLOSE)))

    found = measure_pairs(evals, trains, n_trains=n_trains).select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "et" for c in (*EQUAL, *CLOSE)))
    by_measure = found.join(six(evals, "eval_member", "e"), [f"e_{c}" for c in (*EQUAL, *CLOSE)]).join(
        six(trains, "train_member", "t"), [f"t_{c}" for c in (*EQUAL, *CLOSE)]
    )
    both = by_uid.select("eval_member", "train_member").unionByName(by_measure.select("eval_member", "train_member"))
    return both.distinct()
