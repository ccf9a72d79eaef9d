"""Core operators against small independent loops and hand-made edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewmill.functions import scalar
from viewmill.operators import aggregates, cover, filters, geometry, joins, path, windows


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<int>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("r")).first().r


def test_bins_and_rounding(spark):
    cases = [0.0, 0.25, 0.45, 0.5, 0.65, 1.0]
    got = [one(spark, scalar.float_bin(F.col("a"), 0.05), a=a) for a in cases]
    assert got == [round((a // 0.05) * 0.05, 2) for a in cases]
    assert [one(spark, scalar.int_bin(F.col("a"), 8), a=float(b)) for b in (-7, -8, 0, 7, 8)] == [-8, -8, 0, 0, 8]
    assert [one(spark, scalar.half_even(F.col("a")), a=x) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert [one(spark, scalar.threshold_key(F.col("a")), a=x) for x in (0.01, 0.5, 1.0, 0.025)] == ["0.01", "0.5", "1", "0.025"]
    assert one(spark, scalar.file_safe(F.col("a")), a=0.25) == "0p25"


def test_missing_values(spark):
    assert one(spark, scalar.number(F.col("a")), a=float("nan")) is None
    assert [one(spark, scalar.error_word(F.col("e")), e=e) for e in (" None ", "nan", "", "Timeout")] == [None, None, None, "timeout"]
    assert one(spark, scalar.safe_number(F.col("t"), -1.0), t="x") == -1 and one(spark, scalar.safe_number(F.col("t")), t="2.5") == 2.5
    null = F.lit(None).cast("double")
    assert one(spark, filters.below_or_missing(null, 3), a=0.0) is True and one(spark, filters.above(null, 3), a=0.0) is False
    assert one(spark, scalar.robust_z(F.col("a"), F.lit(1.0), F.lit(0.0)), a=5.0) == 0


def test_normal_functions(spark):
    from statistics import NormalDist

    for p in (1e-4, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-4):
        assert abs(one(spark, scalar.inverse_normal(F.col("p")), p=p) - NormalDist().inv_cdf(p)) < 1e-6
    for z in (-4.0, -1.0, 0.0, 0.5, 3.0):
        assert abs(one(spark, scalar.normal_cdf(F.col("z")), z=z) - NormalDist().cdf(z)) < 1e-6
    assert abs(one(spark, scalar.bisect(F.lit(0.0), F.lit(10.0), lambda x: x * x >= F.col("a")), a=2.0) - math.sqrt(2)) < 1e-9


def test_exact_percentiles(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1), 1.0, -2.0])) for g in "ab" for _ in range(1 if g == "b" else 3001)] + [("a", None), ("a", float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    for accuracy in (50, 10_000):
        got = {(r.g, r.prob): r.x for r in aggregates.exact_percentiles(df, ["g"], "x", probs, accuracy).collect()}
        for g in "ab":
            values = [x for k, x in rows if k == g and x is not None and x == x]
            for p in probs:
                assert abs(got[g, p] - np.quantile(values, p)) < 1e-12
        assert not any(g == "c" for g, _ in got)
    assert aggregates.exact_percentiles(df.limit(0), ["g"], "x", probs).count() == 0


def test_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0000001, 5.0), (3.0, 9.0)], "a double, b double")
    rule = {"logic": "or", "rules": [{"field": "b", "op": ">", "value": 8}, {"logic": "and", "rules": [{"field": "a", "op": "==", "value": 1}, {"field": "b", "op": "<=", "value": 2}]}]}
    assert df.where(filters.compile_rule(rule)).count() == 2
    assert df.where(filters.compile_rule({"rules": [{"field": "a", "op": "!=", "value": 1}]})).count() == 1
    for bad in ({"rules": []}, {"logic": "xor", "rules": [{"field": "a", "op": ">", "value": 1}]}, {"rules": [{"field": "a", "op": "~", "value": 1}]}):
        with pytest.raises(ValueError):
            filters.compile_rule(bad)
    ids = one(spark, filters.canonical_ids(F.col("i"), F.array(F.lit(3)), 10), i=[5, 3, -1, 5, 10, 2])
    assert ids == [2, 5]


def test_joins(spark):
    left = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, v int, w int")
    right = spark.createDataFrame([("a", 9, None), ("a", None, 5)], "k string, v int, q int")
    assert sorted(tuple(r) for r in joins.override_join(left, right, ["k"]).collect()) == [("a", 1, 1, 5), ("a", 9, 1, None)]
    audit = {(r.k, r.status) for r in joins.audit_join(left, right.dropDuplicates(["k"]).select("k", F.lit(None).cast("int").alias("q")), ["k"], ["q"]).collect()}
    assert audit == {("a", "missing_q"), ("b", "missing_row")}
    merged = joins.keyed_merge([left, left.withColumn("v", F.lit(7))], ["k"], [F.col("v")])
    assert sorted(tuple(r) for r in merged.select("k", "v", "n_rows").collect()) == [("a", 1, 2), ("b", 2, 2)]


def test_tolerance_edges(spark):
    left = spark.createDataFrame([(1, 0.5), (2, 1.26), (3, 9.0)], "a long, x double")
    right = spark.createDataFrame([(7, 0.25), (8, 0.75), (9, 1.0)], "b long, x double")
    got = {r.a: r.match_b for r in joins.tolerance_first(left, right, "x", 0.25, "a", "b").collect()}
    assert got == {1: 7, 2: None, 3: None}


def test_nearest_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(300, 5)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, v array<float>").repartition(5)
    for metric in ("dot", "near", "far"):
        for block in (7, 2048):
            got = {}
            for r in joins.nearest(df.where("id % 20 = 0"), df, "id", "v", 3, metric, block).collect():
                got.setdefault(r.query_id, {})[r.rank] = r.id
            x = vectors.astype("float64")
            for q in range(0, 300, 20):
                s = x @ x[q] if metric == "dot" else (-1 if metric == "near" else 1) * ((x - x[q]) ** 2).sum(1)
                assert [got[q][i] for i in (1, 2, 3)] == sorted(range(300), key=lambda i: (-s[i], i))[:3]


def stable(sizes, tau, patience):
    run, previous = 0, None
    for t, n in enumerate(sizes):
        run = run + 1 if previous is not None and (n - previous) / max(previous, 1) < tau else 0
        if run >= patience:
            return t
        previous = n
    return None


def test_stabilisation_equals_loop(spark):
    rng = random.Random(6)
    runs = {k: list(itertools.accumulate(rng.choice([0, 0, 1, 5, 40]) for _ in range(rng.randint(1, 15)))) for k in range(80)}
    runs[98], runs[99] = [100, 101, 102, 103], [0, 0, 0, 0]
    df = spark.createDataFrame([(k, t, n) for k, v in runs.items() for t, n in enumerate(v)], "k int, t int, n int")
    got = {r.k: r.stable_at for r in windows.stabilised_at(df, ["k"], "t", "n", 0.01, 3).collect()}
    assert got == {k: stable(v, 0.01, 3) for k, v in runs.items()}


def test_quotas_sum(spark):
    rng = random.Random(7)
    for target in (1, 10, 57, 10_000):
        counts = [(f"c{i}", rng.randint(1, 60)) for i in range(9)]
        df = spark.createDataFrame(counts, "c string, n long")
        hamilton = {r.c: r.quota for r in windows.hamilton_quotas(df, "n", target, F.col("c")).collect()}
        total = sum(n for _, n in counts)
        assert sum(hamilton.values()) == target and all(abs(hamilton[c] - n * target / total) < 1 for c, n in counts)
        water = {r.c: r.quota for r in windows.water_level(df, "n", target).collect()}
        assert sum(water.values()) == min(target, total) and all(0 <= water[c] <= n for c, n in counts)
        level = max(water.values())
        assert all(water[c] >= min(n, level - 1) for c, n in counts)


def test_greedy_cover(spark):
    rng = random.Random(8)
    cov = {(g, v): {rng.randint(0, 20) for _ in range(rng.randint(0, 9))} for g in range(4) for v in range(7)}
    df = spark.createDataFrame([(g, v, x) for (g, v), s in cov.items() for x in s], "g int, v int, x int")
    got = {}
    for r in cover.greedy_cover(df, ["g"], "v", "x").collect():
        got.setdefault(r.g, {})[r.step] = (r.v, r.gain, r.n_covered)
    for g in range(4):
        open_, steps, covered = set().union(*(s for (k, _), s in cov.items() if k == g)), [], 0
        while open_:
            v = max(range(7), key=lambda v: (len(cov[g, v] & open_), -v))
            covered += len(cov[g, v] & open_)
            steps.append((v, len(cov[g, v] & open_), covered))
            open_ -= cov[g, v]
        assert [got[g][i] for i in range(len(steps))] == steps
    assert cover.greedy_cover(df.limit(0), ["g"], "v", "x").count() == 0


def test_argmax_rules(spark):
    df = spark.createDataFrame([(1, 5, 1.0, 3.0), (1, 2, 1.0 - 1e-13, 9.0), (1, 1, 0.95, 1.0), (1, 0, 0.5, 0.0)], "g int, id int, s double, cost double")
    assert cover.argmax_within(df, ["g"], "s", "id").first().id == 2
    assert cover.threshold_then_cheapest(df, ["g"], "s", "cost", "id", 0.9).first().id == 1


def test_shortest_path_equals_permutations(spark):
    rng = random.Random(9)
    groups = {g: [[rng.random() for _ in range(3)] for _ in range(n)] for g, n in enumerate((1, 2, 5, 6))}
    df = spark.createDataFrame([(g, i, *p) for g, ps in groups.items() for i, p in enumerate(ps)], "g int, idx int, x double, y double, z double")
    got = {r.g: r for r in path.shortest_open_path(df, ["g"], 6).collect()}
    for g, ps in groups.items():
        best = min(sum(math.dist(ps[a], ps[b]) for a, b in itertools.pairwise((0, *o))) for o in itertools.permutations(range(1, len(ps))))
        assert abs(got[g].cost - best) < 1e-6 and sorted(got[g].route) == list(range(len(ps))) and got[g].route[0] == 0
    with pytest.raises(Exception, match="more than 5"):
        path.shortest_open_path(df, ["g"], 5).collect()


def test_farthest_points_equal_loop(spark):
    rng = random.Random(10)
    pts = [[rng.random() for _ in range(3)] for _ in range(25)]
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts)], "g int, id int, x double, y double, z double")
    got = [r.id for r in path.farthest_points(df, ["g"], "id", 5).orderBy("place").collect()]
    chosen = [0]
    while len(chosen) < 5:
        chosen.append(max(range(25), key=lambda i: (min(math.dist(pts[i], pts[c]) for c in chosen), -i)))
    assert got == chosen


def test_strict_distance_and_cells(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 0.99, 0.0, 0.0)], "g int, id int, x double, y double, z double")
    b = spark.createDataFrame([(1, 0.5, 0.0, 0.0)], "g int, x double, y double, z double")
    assert [r.id for r in geometry.covered_points(a, b, ["g"], "id", 0.5).collect()] == [2]
    near = geometry.covered_points(a, b, ["g"], "id", 0.51)
    assert near.count() == 2


def test_safe_distance(spark):
    d = lambda p, q: one(spark, geometry.safe_distance([F.lit(float(x)) for x in p], [F.lit(float(x)) for x in q], 1.0), a=0.0)
    assert abs(d((2, 0, 0), (2, 0, 0))) < 1e-9
    assert abs(d((2, 0, 0), (2, 1, 0)) - 1) < 1e-9
    r = math.sqrt(3)
    assert abs(d((2, 0, 0), (-2, 0, 0)) - (2 * r + math.pi - 2 * math.acos(0.5))) < 1e-9


def test_rotation_and_box(spark):
    df = spark.createDataFrame([(3.0, 0.0, 0.0), (0.0, 3.0, 0.0), (1.0, 2.0, -2.0)], "ex double, ey double, ez double")
    for r in geometry.with_rotation(df, ["ex", "ey", "ez"], F.lit(0.3)).collect():
        m = np.array([r[f"r{i}"] for i in range(9)]).reshape(3, 3)
        eye = np.array([r.ex, r.ey, r.ez])
        assert np.allclose(m @ m.T, np.eye(3)) and np.allclose(m @ -eye, [0, 0, np.linalg.norm(eye)])
    hit = lambda o, v: one(spark, geometry.hits_box([F.lit(float(x)) for x in o], [F.lit(float(x)) for x in v], -1.0, 1.0), a=0.0)
    assert hit((-3, 0, 0), (1, 0, 0)) and not hit((-3, 0, 0), (-1, 0, 0)) and not hit((-3, 2, 0), (1, 0, 0)) and hit((0, 0, 0), (0, 1, 0))


def test_representatives_equal_loop(spark):
    rng = random.Random(11)
    pts = np.array([[rng.random() + 3 * (i % 3), rng.random(), rng.random()] for i in range(40)])
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(pts)], "g int, id int, x double, y double, z double")
    got = sorted((r.cluster, r.id, r["size"]) for r in path.representatives(df, ["g"], "id", 3, 4).collect())
    chosen = [0]
    while len(chosen) < 3:
        chosen.append(max(range(40), key=lambda i: (min(round(math.dist(pts[i], pts[c]), 9) for c in chosen), -i)))
    centres = pts[chosen]
    for _ in range(4):
        near = np.array([[round(math.dist(p, c), 9) for c in centres] for p in pts]).argmin(1)
        centres = np.array([pts[near == j].mean(0).round(9) for j in range(3)])
    d = np.array([[round(math.dist(p, c), 9) for c in centres] for p in pts])
    near = d.argmin(1)
    expected = [(j, min((d[i, j], i) for i in np.flatnonzero(near == j))[1], int((near == j).sum())) for j in range(3)]
    assert got == expected


def test_empty_sides_of_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert joins.nearest(df.limit(0), df, "id", "v").count() == 0 and joins.nearest(df, df.limit(0), "id", "v").count() == 0
