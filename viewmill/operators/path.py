"""Iterative selection over points of many groups at once: shortest open paths, farthest points."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewmill.session import written

XYZ = ("x", "y", "z")
MAX_NODES = 9


def distance(a: str, b: str) -> Column:
    return F.sqrt(reduce(lambda s, c: s + c, ((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in XYZ)))


def exact_path(points: list[tuple[float, ...]]) -> tuple[float, list[int]]:
    """Shortest way from point 0 through all points, by dynamic programming over subsets; ties go to the smaller route."""
    n = len(points)
    d = [[math.dist(p, q) for q in points] for p in points]
    states: dict[tuple[int, int], tuple[float, list[int]]] = {(1, 0): (0.0, [0])}
    for _ in range(n - 1):
        longer: dict[tuple[int, int], tuple[float, list[int]]] = {}
        for (seen, last), (cost, route) in states.items():
            for j in range(1, n):
                if not seen >> j & 1:
                    option = (round(cost + d[last][j], 9), [*route, j])
                    key = (seen | 1 << j, j)
                    if key not in longer or option < longer[key]:
                        longer[key] = option
        states = longer
    return min(states.values())


def _paths(nodes: DataFrame, group: list[str], solve: Callable[[list[tuple[float, ...]]], tuple[float, list[int]]]) -> DataFrame:
    """group, n_nodes, cost, route by ``solve``: all groups in one shuffle, a group's nodes in one task."""
    types = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        cost, route = solve(list(rows[list(XYZ)].itertuples(index=False, name=None)))
        return pd.DataFrame([[*key, len(rows), cost, [int(rows.idx.iloc[i]) for i in route]]], columns=[*group, "n_nodes", "cost", "route"])

    schema = ", ".join([*(f"{g} {types[g]}" for g in group), f"n_nodes long, cost double, route array<{types['idx']}>"])
    return nodes.groupBy(*group).applyInPandas(run, schema)


def shortest_open_path(nodes: DataFrame, group: list[str], max_nodes: int = MAX_NODES) -> DataFrame:
    """Shortest way from node 0 through all nodes of each group: group, n_nodes, cost, route (array of idx).

    ``nodes``: group, idx (0, 1, ...), x, y, z. Exact; the states double with each node, so groups of more than
    ``max_nodes`` are refused with an error.
    """
    sizes = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n_nodes"))
    fits = F.when(F.col("n_nodes") <= max_nodes, F.col("idx")).otherwise(F.raise_error(F.lit(f"more than {max_nodes} nodes in a group")))
    return _paths(nodes.join(sizes, group).select(*group, fits.cast(nodes.schema["idx"].dataType).alias("idx"), *XYZ), group, exact_path)


def improved_path(points: list[tuple[float, ...]]) -> tuple[float, list[int]]:
    """Short way from point 0 through all points: nearest neighbours, then 2-opt and insertions until none helps."""
    d = [[math.dist(p, q) for q in points] for p in points]
    route, rest = [0], set(range(1, len(points)))
    while rest:
        route.append(min(rest, key=lambda j: (d[route[-1]][j], j)))
        rest.remove(route[-1])
    length = lambda r: sum(d[a][b] for a, b in zip(r, r[1:], strict=False))
    cost, better = length(route), True
    while better:
        better = False
        for i in range(1, len(route)):
            for j in range(1, len(route)):
                without = route[:i] + route[i + 1 :]
                options = [without[:j] + [route[i]] + without[j:]]
                if j > i:
                    options.append(route[:i] + route[i : j + 1][::-1] + route[j + 1 :])
                for option in options:
                    if (c := length(option)) < cost - 1e-9:
                        route, cost, better = option, c, True
    return cost, route


def open_paths(nodes: DataFrame, group: list[str], max_nodes: int = MAX_NODES) -> DataFrame:
    """``shortest_open_path`` for groups of up to ``max_nodes`` nodes, ``improved_path`` over all nodes above: adds method, exact or heuristic."""
    nodes = written(nodes.select(*group, "idx", *XYZ), "open-path-nodes")
    sizes = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    small = nodes.join(sizes.where(F.col("n") <= max_nodes), group, "left_semi")
    large = nodes.join(sizes.where(F.col("n") > max_nodes), group, "left_semi")
    exact = _paths(small, group, exact_path).withColumn("method", F.lit("exact"))
    return exact.unionByName(_paths(large, group, improved_path).withColumn("method", F.lit("heuristic")))


def farthest_points(points: DataFrame, group: list[str], id_col: str, k: int) -> DataFrame:
    """Greedy max-min selection of ``k`` points of each group, from the smallest id on: group, id, place, gap.

    One job for each round over all groups; a point carries its distance to the nearest chosen one.
    """
    pool = points.select(*group, id_col, *XYZ).withColumn("gap", F.lit(float("inf")))
    chosen = None
    for place in range(k):
        pool = written(pool, "farthest-pool")
        row = F.struct(id_col, *XYZ, "gap")
        best = pool.where("gap > 0").groupBy(*group).agg(F.max_by(row, F.struct(F.col("gap"), -F.col(id_col))).alias("r"))
        pick = written(best.select(*group, "r.*", F.lit(place).alias("place")), "farthest-pick")
        chosen = pick if chosen is None else chosen.unionByName(pick)
        there = pick.select(*group, *(F.col(c).alias(f"b{c}") for c in XYZ))
        named = pool.join(there, group).withColumnsRenamed({c: f"a{c}" for c in XYZ})
        nearer = named.withColumn("gap", F.least("gap", F.round(distance("a", "b"), 9)))
        pool = nearer.select(*group, id_col, *(F.col(f"a{c}").alias(c) for c in XYZ), "gap")
    return chosen.select(*group, id_col, "place", F.when(F.col("place") > 0, F.col("gap")).alias("gap"))


def representatives(points: DataFrame, group: list[str], id_col: str, k: int, rounds: int = 15) -> DataFrame:
    """The ``k`` medoids of each group after ``rounds`` of Lloyd's iteration: group, cluster, id, size.

    Starts from the farthest points. Every round is one join of points and centres by group and two
    aggregations, for all groups in one job; only the centres (``k`` a group) are written between rounds.
    """
    rows = written(points.select(*group, id_col, *XYZ), "cluster-points")
    first = farthest_points(rows, group, id_col, k).select(*group, id_col, F.col("place").alias("cluster"))
    centres = rows.join(first, [*group, id_col]).select(*group, "cluster", *(F.col(c).alias(f"b{c}") for c in XYZ))
    named = rows.withColumnsRenamed({c: f"a{c}" for c in XYZ})

    def assigned(centres: DataFrame) -> DataFrame:
        near = F.struct(F.round(distance("a", "b"), 9).alias("d"), F.col("cluster"))
        return named.join(centres, group).groupBy(*group, id_col).agg(
            F.min(near).alias("n"), *(F.first(f"a{c}").alias(f"a{c}") for c in XYZ)
        )

    for _ in range(rounds):
        centres = written(centres, "cluster-centres")
        means = assigned(centres).groupBy(*group, F.col("n.cluster").alias("cluster"))
        centres = means.agg(*(F.round(F.avg(f"a{c}"), 9).alias(f"b{c}") for c in XYZ))
    final = assigned(written(centres, "cluster-centres"))
    return final.groupBy(*group, F.col("n.cluster").alias("cluster")).agg(
        F.min_by(id_col, F.struct("n.d", id_col)).alias(id_col), F.count(F.lit(1)).alias("size")
    )
