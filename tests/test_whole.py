"""Queries that give the whole result: nothing capped, sharded away or left out."""

import inspect
import itertools
import math
import random
from collections import Counter

from viewmill.operators import path, windows
from viewmill.plans import planning, registry, relational, sequences
from viewmill.session import table

D = "/root/testdata/sf0.001"


def test_every_member_has_a_place(spark):
    got = registry.queries()["review_order"](spark, D).collect()
    assert len(got) == table(spark, D, "split_members").count()
    sizes = Counter((r.split_name, r.p) for r in got)
    assert max(sizes.values()) > 20
    for key, n in sizes.items():
        assert sorted(r.place for r in got if (r.split_name, r.p) == key) == list(range(1, n + 1))


def test_every_object_has_its_jobs_and_one_shard(spark):
    got = registry.queries()["job_matrix"](spark, D).collect()
    uids = sorted(r.uid for r in relational.objects(spark, D).select("uid").collect())
    assert sorted((r.uid, r.shard) for r in got) == sorted((u, i % 4) for i, u in enumerate(uids) for _ in range(9))
    assert len({r.job_id for r in got}) == len(got)


def test_every_run_has_all_views_of_the_ring(spark):
    got = registry.queries()["fallback_order"](spark, D).collect()
    runs = {(r.run_id, r.start_view_id) for r in sequences.replay(spark, D).collect()}
    views = {run: {r.view_id for r in got if (r.run_id, r.start_view_id) == run} for run in runs}
    assert runs and {(r.run_id, r.start_view_id) for r in got} == runs and all(v >= set(range(128)) for v in views.values())


def test_open_paths_take_all_nodes(spark):
    rng = random.Random(3)
    groups = {g: [tuple(rng.random() for _ in range(3)) for _ in range(n)] for g, n in enumerate((1, 4, 5, 12))}
    df = spark.createDataFrame([(g, i, *p) for g, ps in groups.items() for i, p in enumerate(ps)], "g int, idx int, x double, y double, z double")
    got = {r.g: r for r in path.open_paths(df, ["g"], 4).collect()}
    assert {g: (r.n_nodes, r.method) for g, r in got.items()} == {0: (1, "exact"), 1: (4, "exact"), 2: (5, "heuristic"), 3: (12, "heuristic")}
    for g, ps in groups.items():
        route = got[g].route
        assert route[0] == 0 and sorted(route) == list(range(len(ps)))
        assert abs(got[g].cost - sum(math.dist(ps[a], ps[b]) for a, b in itertools.pairwise(route))) < 1e-6


def test_open_path_of_a_run_with_many_views(spark, monkeypatch):
    steps = spark.createDataFrame([("r", 0, i, 10 * i) for i in range(11)], "run_id string, start_view_id int, step_id int, oracle_nbv_view_id int")
    monkeypatch.setattr(planning, "run_steps", lambda *_: steps)
    assert [(r.n_nodes, r.method) for r in planning.open_path(spark, D).collect()] == [(11, "heuristic")]


def test_view_clusters_run_all_rounds(spark, monkeypatch):
    seen = []
    signature = inspect.signature(path.representatives)

    def spy(*args, **named):
        call = signature.bind(*args, **named)
        call.apply_defaults()
        seen.append(call.arguments["rounds"])
        return args[0]

    monkeypatch.setattr(planning, "representatives", spy)
    planning.view_clusters(spark, D)
    assert seen == [15]


def test_points_are_tiled_to_2048(spark):
    got = registry.queries()["tiled_points"](spark, D).collect()
    assert got and all(r.n_rows == 2048 and r.first_rows == math.ceil(2048 / r.n_points) for r in got)


def test_tiling_repeats_in_order_and_cuts(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 1), ("b", 3), ("c", 7)) for i in range(n)], "g string, i int")
    got = windows.tiled_to(df, ["g"], ["i"], 5).groupBy("g").agg({"i": "collect_list"}).collect()
    assert {r.g: sorted(r[1]) for r in got} == {"a": [0] * 5, "b": [0, 0, 1, 1, 2], "c": [0, 1, 2, 3, 4]}
