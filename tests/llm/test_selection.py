"""Top-n, percentiles, overlap and quotas against brute force, with skew, ties, nulls and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from viewmill.llm import overlap, percentiles, quota, topn


def test_positions_of_a_group_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 50}" if i % 7 else None, rng.randint(0, 40), i, "x") for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, score int, id long, _part string").repartition(7)
    df = df.drop("_part").withColumn("extra", F.array(F.lit(1)))
    expected = {}
    for g, s, i, _ in sorted(rows, key=lambda r: (-r[1], r[2])):
        expected.setdefault(g, []).append(i)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        for n in (1, 10, 5000, None):
            got = {}
            for r in topn.positions(df, ["g"], [F.desc("score"), F.asc("id")], n).collect():
                got.setdefault(r.g, {})[r.item_rank] = r.id
            assert got == {g: dict(enumerate(ids[:n], 1)) for g, ids in expected.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert topn.positions(df.limit(0), ["g"], [F.desc("score")], 3).count() == 0


def test_candidate_items_dirt(spark):
    rows = [
        (1, " A ", 0, 0, 10, [1, 2, None, 4, 5], [3, 11, 2, -1]),
        (1, "a", 0, 0, 10, [1, 2], [7, None]),
        (1, None, 0, 0, 10, [1], [7]),
        (2, "a", 0, 0, None, [9], [99]),
        (2, "b", 0, 0, 5, None, [1]),
        (2, "b", 0, 0, 5, [], []),
        (2, " ", 0, 0, 5, [1], [1]),
    ]
    schema = "run_id long, uid string, start_view_id int, step_id int, universe_voxel_count int, candidate_view_ids array<int>, candidate_marginal_gains array<int>"
    got = [(r.uid, r.item_rank, r.run_id, r.candidate_view_id, r.gain) for r in topn.top_candidates(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == [("a", 1, 2, 9, 99), ("a", 2, 1, 1, 7)]


def test_percentiles_equal_sorted_values(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else str(i % 4), i % 5, rng.choice([rng.gauss(0, 1e3), rng.uniform(-1e-9, 1e-9), 0.0, -0.0, 7.5])) for i in range(4000)]
    dirty = [("hot", 0, None), ("hot", 0, float("nan")), ("none", 0, None), ("inf", 1, float("-inf")), ("inf", 1, float("inf")), (None, 1, 4.0)]
    df = spark.createDataFrame(rows + dirty, "g string, day int, value double")
    pcts = spark.createDataFrame([(p,) for p in (0, 1, 50, 99, 100)], "pct int")
    got = {(r.g, r.pct): r for r in percentiles.percentiles(df, ["g"], ["day"], pcts).collect()}
    values = {}
    for g, _, v in rows + dirty:
        if v is not None and v == v:
            values.setdefault(g, []).append(v + 0.0)
    assert {k[0] for k in got} == set(values)
    for (g, p), r in got.items():
        s = sorted(values[g])
        assert r.low == r.high == s[max(1, math.ceil(p * len(s) / 100)) - 1] and r.n == len(s)
    for passes in (1, 2, 3):
        for r in percentiles.percentiles(df, ["g"], ["day"], pcts, passes).where("g = 'hot'").collect():
            exact = got[r.g, r.pct].low
            assert r.low <= exact <= r.high
            assert abs(r.high - r.low) <= 2.0 ** (-4 - 16 * (passes - 1)) * max(abs(r.low), abs(r.high), 1e-300) * 1.01
    assert percentiles.percentiles(df.limit(0), ["g"], ["day"], pcts).count() == 0


def hexes(rng, n):
    return ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(n)]


def test_overlap_equals_brute_force(spark):
    rng = random.Random(3)
    base = hexes(rng, 60)
    hot = base[0]
    rows = []
    for i in range(900):
        h = hot if i % 3 == 0 else rng.choice(base)
        for at in rng.sample(range(32), rng.choice([0, 0, 1, 2, 3])):
            h = h[:at] + rng.choice("0123456789abcdef") + h[at + 1 :]
        h = rng.choice([h, h.upper(), f"{{{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}}}", f"./pcd/{h}.pcd", f"uid:{h}", f" {h}\n", None, h[:31]])
        scale = rng.choice([1, 1, 1.0005, 0.9994, 1.002])
        m = rng.randint(1, 40)
        six = [0.01 * m * scale, 5 * m, m % 7, 1000 * m, -0.5 * m if m % 5 == 0 else 0.0 if m % 4 == 0 else 2.0 * m * scale, 3.0 * m]
        if rng.random() < 0.15:
            six[rng.randrange(6)] = None
        if rng.random() < 0.05:
            six[0] = float("nan")
        rows.append((i, rng.choice([*overlap.TRAIN, *overlap.EVAL, "other", None]), h, *six, "clash"))
    schema = "member_id long, split_name string, uid string, self_occlusion_attribute double, observation_saturation_view_num int, selected_view_count int, gt_surface_voxel_count int, area double, volume double, digits string"
    df = spark.createDataFrame([*rows, rows[0]], schema)

    def digits(u):
        import re

        found = re.search("[0-9a-f]{32}", re.sub(r"[-{}\s]", "", (u or "").lower()))
        return found and found.group()

    def same(a, b):
        x, y = digits(a[2]), digits(b[2])
        if x and y and sum(p != q for p, q in zip(x, y, strict=True)) <= 2:
            return True
        if any(v is None or v != v for v in (*a[3:9], *b[3:9])):
            return False
        return a[4:6] == b[4:6] and all(abs(p - q) <= 0.001 * max(abs(p), abs(q)) for p, q in ((a[k], b[k]) for k in (3, 6, 7, 8)))

    expected = {(e[0], t[0]) for e in rows if e[1] in overlap.EVAL for t in rows if t[1] in overlap.TRAIN and same(e, t)}
    got = [tuple(r) for r in overlap.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 1000
    assert overlap.cross_split_pairs(df.where("split_name = 'hidden_test'")).count() == 0


def lines_of(spark, rows):
    mix = spark.createDataFrame(rows, "request_id long, shape_type string, fill_bucket string, target_share double, min_count int, target_n int")
    counts = {("a", "x"): 100, ("b", "x"): 7, ("c", "x"): 50, ("d_e", "x"): 3}
    objects = [(f" U{s}{i} " if i % 2 else f"u{s}{i}", s.upper().replace("_", "-") + ("\t" if i % 3 else ""), f) for (s, f), n in counts.items() for i in range(n)]
    objects += [objects[0], (None, "a", "x"), ("u1", None, "x"), ("u2", "a", ""), ("", "a", "x"), ("u3", "unlisted", "x")]
    annotations = spark.createDataFrame([(u, s, f, "k") for u, s, f in objects], "uid string, shape_type string, fill_bucket string, shape_key string")
    distinct = quota.categorised(annotations)
    return distinct, quota.strata(distinct, mix)


def test_quotas_and_draw(spark):
    rows = [
        (1, "a", "x", 0.5, 0, 60), (1, "b", "x", 0.2, 0, 60), (1, "c", "x", 0.3, 0, 60), (1, "D E", "X ", 0.0, 5, 60),
        (2, "a", "x", 0.9, 0, 10), (2, "c", "x", 0.1, 4, 10),
        (3, "a", "x", 0.5, 0, 1000), (3, "c", "x", 0.5, 0, 1000),
        (4, "a", "x", 0.5, 80, 60), (4, "c", "x", 0.5, 20, 60),
        (5, "a", "x", None, None, 5), (5, "zz", "x", 1.0, 0, 5),
        (6, "a", "x", 1 / 3, 0, 100), (6, "c", "x", 1 / 3, 0, 100), (6, "b", "x", 1 / 3, 0, 100),
    ]
    objects, lines = lines_of(spark, rows)
    allotted = quota.quotas(lines)
    q = {(r.request_id, r.shape_key): r.quota for r in allotted.collect()}
    assert [q[1, k] for k in ("a", "b", "c", "d_e")] == [31, 7, 19, 3]
    assert [q[2, k] for k in ("a", "c")] == [6, 4]
    assert [q[3, k] for k in ("a", "c")] == [100, 50]
    assert [q[4, k] for k in ("a", "c")] == [80, 20]
    assert q[5, "zz"] == 0 and q[6, "a"] + q[6, "b"] + q[6, "c"] == 100 and q[6, "b"] == 7
    drawn = quota.draw(objects, allotted).collect()
    counts = {}
    for r in drawn:
        counts[r.request_id, r.shape_type] = counts.get((r.request_id, r.shape_type), 0) + 1
    expected = {(r.request_id, r.shape_type): r.quota for r in allotted.collect() if r.quota}
    assert counts == expected and len(drawn) == len({(r.request_id, r.uid) for r in drawn})
    assert {(r.request_id, r.uid) for r in quota.draw(objects, allotted).collect()} == {(r.request_id, r.uid) for r in drawn}
    short = {(r.request_id, r.shape_key) for r in lines.where("available < wanted").collect()}
    assert short == {(1, "b"), (1, "d_e"), (3, "a"), (3, "c"), (5, "zz"), (6, "b")}


def test_quota_with_empty_sides(spark):
    objects, lines = lines_of(spark, [(1, "a", "x", 1.0, 0, 5)])
    assert quota.draw(objects.limit(0), quota.quotas(quota.strata(objects.limit(0), lines.select("request_id", "shape_type", "fill_bucket", F.lit(1.0).alias("target_share"), "min_count", "target_n")))).count() == 0
    assert quota.draw(objects, quota.quotas(lines.limit(0))).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_smaller_quota_is_a_subset(spark, seed):
    objects, few = lines_of(spark, [(1, "a", "x", 1.0, 0, 5)])
    _, many = lines_of(spark, [(1, "a", "x", 1.0, 0, 50)])
    ids = lambda lines: {r.uid for r in quota.draw(objects, quota.quotas(lines), seed).collect()}
    assert len(ids(few)) == 5 and ids(few) < ids(many)


def test_a_day_is_added_without_the_values_of_the_old_ones(spark):
    from viewmill.llm import percentiles as p

    rng = random.Random(4)
    rows = [(g, d, rng.lognormvariate(0, 3) * rng.choice((1, 1, -1))) for g in ("a", None) for d in range(4) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, day int, value double")
    pcts = spark.createDataFrame([(1,), (50,), (99,)], "pct int")
    kept = p.value_parts(df.where("day < 3"), ["g"], ["day"]).cache()
    assert kept.count() > 0
    new = p.value_parts(df.where("day = 3"), ["g"], ["day"])  # reads the new day only
    got = {(r.g, r.pct): r for r in p.percentiles_of_parts(p.merged_parts([kept, new], ["g"], ["day"]), ["g"], pcts).collect()}
    exact = {(r.g, r.pct): r for r in p.percentiles(df, ["g"], ["day"], pcts).collect()}
    assert set(got) == set(exact) and len(got) == 6
    for key, r in got.items():
        assert r.n == exact[key].n == 1200 and r.low <= exact[key].low <= r.high and r.high - r.low <= abs(r.high) * 2.0**-19
    twice = {(r.g, r.pct): r.n for r in p.percentiles_of_parts(p.merged_parts([kept, kept, new], ["g"], ["day"]), ["g"], pcts).collect()}
    assert set(twice.values()) == {2100}


def test_cut_lists_give_the_same_items(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        k = rng.randint(0, 12)
        ids = [rng.choice([*range(9), None]) for _ in range(k)] if i % 3 else rng.sample(range(20), k)
        gains = [rng.choice([-1, 0, 1, 2, 3, 50, None]) for _ in range(k + rng.randint(-1, 1) if k else 0)]
        rows.append((rng.choice(["a", " A", "b", None]), rng.randint(0, 5), 0, rng.randint(0, 3), rng.choice([3, 100, None]), ids, gains))
    df = spark.createDataFrame(rows, "uid string, run_id long, start_view_id int, step_id int, universe_voxel_count int, candidate_view_ids array<int>, candidate_marginal_gains array<int>")
    items = {}
    for uid, run, start, step, size, ids, gains in rows:
        for c, g in zip(ids, gains, strict=False):
            if uid and c is not None and g is not None and g >= 0 and (size is None or g <= size):
                key = (uid.strip().lower(), run, start, step, c)
                items[key] = max(g, items.get(key, 0))
    for n in (1, 3, 10):
        want = []
        for uid in ("a", "b"):
            of = sorted((-g, *k[1:]) for k, g in items.items() if k[0] == uid)[:n]
            want += [(uid, i + 1, *x[1:]) for i, x in enumerate(of)]
        got = [(r.uid, r.item_rank, r.run_id, r.start_view_id, r.step_id, r.candidate_view_id) for r in topn.top_candidates(df, n).collect()]
        assert sorted(got) == want
