"""Edge cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from viewmill import session
from viewmill.operators import aggregates, cover, geometry


def test_null_groups_keep_their_percentiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), ("c", None), ("c", float("nan"))], "g string, x double")
    got = {r.g: r for r in aggregates.five_numbers(df, ["g"]).collect()}
    assert set(got) == {"a", None, "c"} and got[None].median == 6.0 and got["a"].p25 == 1.5
    assert got["c"].n == 0 and got["c"].median is None and got["c"]["mean"] is None


def test_missed_brackets_are_widened(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"))
    got = {r.prob: r.x for r in aggregates.exact_percentiles(df, ["g"], "x", [0.25, 0.5, 0.9], accuracy=10).collect()}
    assert got == {0.25: 249.75, 0.5: 499.5, 0.9: pytest.approx(899.1)}


def test_small_and_large_groups_are_covered_alike(spark):
    rows = [(g, v, x) for g in range(4) for v in range(6) for x in range(30) if (x * (v + 3) + g * 7) % 5 < 2 or x == v]
    df = spark.createDataFrame(rows, "g int, v int, x int")
    start = spark.createDataFrame([(0, 3), (2, 5)], "g int, v int")
    for budget in (None, 2):
        inside = sorted(map(tuple, cover.greedy_cover(df, ["g"], "v", "x", start, budget).collect()))
        rounds = sorted(map(tuple, cover.greedy_cover(df, ["g"], "v", "x", start, budget, small=0).collect()))
        assert inside == rounds and [r[2] for r in inside if r[1] == 0] == [3, inside[[r[0] for r in inside].index(1)][2], 5, [r for r in inside if r[0] == 3][0][2]]
    with pytest.raises(RuntimeError):
        cover.greedy_cover(df, ["g"], "v", "x", small=0, max_rounds=1)
    every = cover.greedy_rollouts(df, ["g"], "v", "x", work=50).collect()
    assert {(r.g, r.start) for r in every} == {(g, v) for g, v, _ in rows}
    assert all(r.v == r.start for r in every if r.step == 0)


def test_voxels_do_not_collide(spark):
    df = spark.createDataFrame([(8, 0, 0), (7, 16, 0), (-1048576, 1048575, -1), (-1048576, 1048574, 1048575)], "vx long, vy long, vz long")
    assert df.select(geometry.packed_voxel("vx", "vy", "vz").alias("v")).distinct().count() == 4
    with pytest.raises(Exception, match="21 bits"):
        spark.createDataFrame([(1 << 20, 0, 0)], "vx long, vy long, vz long").select(geometry.packed_voxel("vx", "vy", "vz")).collect()


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0.5, 0, 0), (-2, 0, 0), 2.5), ((1, 0, 0), (-1, 0, 0), 2.0), ((2, 0, 0), (-2, 0, 0), 2 * math.sqrt(3) + math.pi - 2 * math.acos(0.5)), ((2, 2, 0), (2, -2, 0), 4.0)],
)
def test_distance_around_the_sphere(spark, a, b, want):
    p, q = ([F.lit(float(x)) for x in v] for v in (a, b))
    assert spark.range(1).select(geometry.safe_distance(p, q, 1.0)).first()[0] == pytest.approx(want)


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "x"})  # noqa: N815

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())


def test_entry_survives_a_missing_package(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def fail(name, *args, **named):
        if name.startswith("viewmill.llm"):
            raise ImportError(name)
        return real(name, *args, **named)

    for name in [n for n in sys.modules if n.startswith("viewmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", fail)
    assert "p4_found" in entry.queries() and "p1_found" not in entry.queries() and "p1_found" not in entry.oracle_sql()
