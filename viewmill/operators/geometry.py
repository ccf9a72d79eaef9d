"""Point sets and poses: voxel fusion, threshold coverage, neighbour counts, projections, path costs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFSETS = list(itertools.product((-1, 0, 1), repeat=3))


def packed_voxel(vx: str, vy: str, vz: str) -> Column:
    """Three cell numbers as one long, 21 bits each; raises for cells beyond 2^20."""
    half = 1 << 20
    inside = F.lit(True)
    for v in (vx, vy, vz):
        inside &= F.col(v).between(-half, half - 1)
    packed = ((F.col(vx) + half) * (1 << 42)) + ((F.col(vy) + half) * (1 << 21)) + F.col(vz) + half
    return F.when(inside, packed).otherwise(F.raise_error(F.lit("a cell number does not fit 21 bits")))


def voxel_keys(df: DataFrame, size: float, origin: float = 0.0) -> DataFrame:
    """Adds the integer cell vx, vy, vz of x, y, z."""
    return df.withColumns({f"v{a}": F.floor((F.col(a) - origin) / size).cast("long") for a in "xyz"})


def fuse(points: DataFrame, key: list[str], size: float) -> DataFrame:
    """One mean point for each occupied cell, with the number of points."""
    cells = voxel_keys(points, size).groupBy(*key, "vx", "vy", "vz")
    return cells.agg(*(F.avg(a).alias(a) for a in "xyz"), F.count(F.lit(1)).alias("n_points"))


def occupied(points: DataFrame, key: list[str], size: float) -> DataFrame:
    return voxel_keys(points, size).groupBy(*key).agg(F.count_distinct("vx", "vy", "vz").alias("n_cells"))


def around(df: DataFrame) -> DataFrame:
    """Each row once for its own cell and each of the 26 around it."""
    cells = F.array(*(F.struct(*((F.col(f"v{a}") + d).alias(f"v{a}") for a, d in zip("xyz", o, strict=True))) for o in OFFSETS))
    return df.withColumn("_c", F.explode(cells)).withColumns({f"v{a}": F.col(f"_c.v{a}") for a in "xyz"}).drop("_c")


def covered_points(targets: DataFrame, seen: DataFrame, key: list[str], id_col: str, t: float) -> DataFrame:
    """Target ids with a seen point closer than ``t`` (strictly), by cells of that size: an equi-join, no cross product."""
    a = around(voxel_keys(targets.select(*key, id_col, "x", "y", "z"), t))
    b = voxel_keys(seen.select(*key, *(F.col(c).alias(f"s{c}") for c in "xyz"), "x", "y", "z"), t).drop("x", "y", "z")
    d2 = sum((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in "xyz")
    near = a.join(b, [*key, "vx", "vy", "vz"]).where(d2 < t * t)
    return near.select(*key, id_col).distinct()


def frontier_level(cells: DataFrame, key: list[str]) -> DataFrame:
    """Occupied neighbours of each occupied cell among 26, and its level: 0 none, 1 some, 2 all around."""
    offsets = [o for o in OFFSETS if o != (0, 0, 0)]
    moved = F.array(*(F.struct(*((F.col(f"v{a}") + d).alias(f"v{a}") for a, d in zip("xyz", o, strict=True))) for o in offsets))
    out = cells.select(*key, "vx", "vy", "vz", F.explode(moved).alias("c"))
    asked = out.select(*key, *(F.col(f"v{a}").alias(f"o{a}") for a in "xyz"), *(F.col(f"c.v{a}").alias(f"v{a}") for a in "xyz"))
    hits = asked.join(cells.select(*key, "vx", "vy", "vz").withColumn("_hit", F.lit(1)), [*key, "vx", "vy", "vz"], "left")
    n = hits.groupBy(*key, "ox", "oy", "oz").agg(F.count("_hit").alias("n_neighbours"))
    named = n.select(*key, *(F.col(f"o{a}").alias(f"v{a}") for a in "xyz"), "n_neighbours")
    return named.withColumn("level", F.when(F.col("n_neighbours") == 0, 0).when(F.col("n_neighbours") == 26, 2).otherwise(1))


def sphere_pose(i: Column, n: int, radius: float) -> dict[str, Column]:
    """x, y, z of the i-th of ``n`` points spread evenly over a sphere."""
    y = 1 - 2 * (i + 0.5) / n
    r = F.sqrt(1 - y * y)
    angle = i * (math.pi * (3 - math.sqrt(5)))
    return {"x": F.lit(radius) * r * F.cos(angle), "y": F.lit(radius) * y, "z": F.lit(radius) * r * F.sin(angle)}


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum(x * y for x, y in zip(a, b, strict=True))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def safe_distance(a: list[Column], b: list[Column], radius: float) -> Column:
    """Length of the shortest way from a to b that doesn't enter a sphere around the origin.

    The straight segment where it misses the sphere or an end lies in it; else two tangents and the arc between their feet.
    """
    ra, rb = (F.sqrt(dot(p, p)) for p in (a, b))
    straight = F.sqrt(sum((y - x) * (y - x) for x, y in zip(a, b, strict=True)))
    ab = [y - x for x, y in zip(a, b, strict=True)]
    t = clamp(-dot(a, ab) / F.greatest(dot(ab, ab), F.lit(1e-18)), 0.0, 1.0)
    foot = [x + t * d for x, d in zip(a, ab, strict=True)]
    misses = (F.sqrt(dot(foot, foot)) >= radius - 1e-9) | (F.least(ra, rb) <= radius + 1e-9)
    oa, ob = F.greatest(ra, F.lit(radius)), F.greatest(rb, F.lit(radius))
    angle = F.acos(clamp(dot(a, b) / F.greatest(ra * rb, F.lit(1e-18)), -1.0, 1.0))
    tangents = F.sqrt(oa * oa - radius * radius) + F.sqrt(ob * ob - radius * radius)
    arc = F.greatest(angle - F.acos(clamp(radius / oa, -1.0, 1.0)) - F.acos(clamp(radius / ob, -1.0, 1.0)), F.lit(0.0))
    return F.when(misses, straight).otherwise(F.greatest(straight, tangents + radius * arc))


def with_rotation(df: DataFrame, eye: list[str], roll: Column) -> DataFrame:
    """Adds r0..r8: the row-major world-to-camera rotation that looks from ``eye`` at the origin.

    The up axis changes near the poles. Built in steps, so that each vector is computed once.
    """
    length = F.sqrt(sum(F.col(e) * F.col(e) for e in eye))
    df = df.withColumns({f"_f{i}": -F.col(e) / length for i, e in enumerate(eye)})
    polar = F.abs("_f1") > 0.999
    up = [F.lit(0.0), F.when(polar, 0.0).otherwise(1.0), F.when(polar, 1.0).otherwise(0.0)]

    def cross(p: list[Column], q: list[Column]) -> list[Column]:
        return [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]

    vector = lambda name: [F.col(f"{name}{i}") for i in range(3)]
    df = df.withColumns({f"_w{i}": c for i, c in enumerate(cross(vector("_f"), up))})
    size = F.sqrt(dot(vector("_w"), vector("_w")))
    df = df.withColumns({f"_s{i}": c / size for i, c in enumerate(vector("_w"))})
    df = df.withColumns({f"_t{i}": c for i, c in enumerate(cross(vector("_s"), vector("_f")))})
    cos, sin = F.cos(roll), F.sin(roll)
    right = [cos * a + sin * b for a, b in zip(vector("_s"), vector("_t"), strict=True)]
    down = [sin * a - cos * b for a, b in zip(vector("_s"), vector("_t"), strict=True)]
    df = df.withColumns({f"r{i}": c for i, c in enumerate([*right, *down, *vector("_f")])})
    return df.drop(*(f"_{name}{i}" for name in "fwst" for i in range(3)))


def rotate(point: list[Column], axis: list[Column], angle: Column) -> list[Column]:
    """The point turned around a unit axis through the origin (Rodrigues)."""
    c, s = F.cos(angle), F.sin(angle)
    along = dot(point, axis) * (1 - c)
    turned = [axis[1] * point[2] - axis[2] * point[1], axis[2] * point[0] - axis[0] * point[2], axis[0] * point[1] - axis[1] * point[0]]
    return [p * c + t * s + a * along for p, t, a in zip(point, turned, axis, strict=True)]


def project(point: list[Column], eye: list[Column], rotation: list[Column], width: int, focal: float) -> tuple[Column, Column, Column]:
    """Pixel column, row and depth; null where the point is behind the camera or outside the image."""
    d = [p - e for p, e in zip(point, eye, strict=True)]
    x, y, z = (dot(rotation[3 * i : 3 * i + 3], d) for i in range(3))
    u, v = (F.floor(focal * c / z + width / 2) for c in (x, y))
    ok = (z > 1e-9) & u.between(0, width - 1) & v.between(0, width - 1)
    return F.when(ok, u), F.when(ok, v), F.when(ok, z)


def hits_box(origin: list[Column], direction: list[Column], lo: float, hi: float) -> Column:
    """Does the ray meet the axis-aligned cube [lo, hi]^3 at a distance of at least 0?"""
    near, far = F.lit(-math.inf), F.lit(math.inf)
    outside = F.lit(False)
    for o, d in zip(origin, direction, strict=True):
        flat = F.abs(d) < 1e-12
        t1, t2 = (lo - o) / F.when(~flat, d), (hi - o) / F.when(~flat, d)
        near = F.when(flat, near).otherwise(F.greatest(near, F.least(t1, t2)))
        far = F.when(flat, far).otherwise(F.least(far, F.greatest(t1, t2)))
        outside = outside | (flat & ((o < lo) | (o > hi)))
    return ~outside & (near <= far) & (far >= 0)


def set_distance(a: Column, b: Column) -> Column:
    """Mean squared distance from the points of array ``a`` to their nearest of array ``b``; null if either is empty."""

    def d2(p: Column, q: Column) -> Column:
        return sum((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz")

    nearest = F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: d2(p, q))))
    total = F.aggregate(nearest, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), total / F.size(a))


def voxel_centre(size: float, origin: float = 0.0) -> dict[str, Column]:
    """The middle cx, cy, cz of the cell vx, vy, vz."""
    return {f"c{a}": (F.col(f"v{a}") + 0.5) * size + origin for a in "xyz"}


def back_projected(pixels: DataFrame, focal: float, centre: float, limit: float) -> DataFrame:
    """Points x, y, z of pixels u, v with a depth: rays through pixel middles; no, infinite or non-positive depths and points beyond ``limit`` are left out."""
    d = F.col("depth")
    points = pixels.where(d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf")))
    points = points.withColumns({"x": (F.col("u") + 0.5 - centre) / focal * d, "y": (F.col("v") + 0.5 - centre) / focal * d, "z": d})
    return points.where((F.abs("x") <= limit) & (F.abs("y") <= limit) & (F.abs("z") <= limit))


def finite_inside(low: float, high: float) -> Column:
    """Are x, y and z numbers within the box?"""
    return sum((F.coalesce((~F.isnan(F.col(a)) & F.col(a).between(low, high)).cast("int"), F.lit(0)) for a in "xyz"), F.lit(0)) == 3


def dense_grid(cells: DataFrame, key: list[str], value: str, default: float) -> DataFrame:
    """Every cell of each key's bounding box, with ``default`` where there is none; the box's cells are made in tasks."""
    spans = cells.groupBy(*key).agg(*(f(f"v{a}").alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    grid = spans
    for a in "xyz":
        grid = grid.withColumn(f"v{a}", F.explode(F.sequence(f"lo{a}", f"hi{a}")))
    grid = grid.select(*key, "vx", "vy", "vz")
    return grid.join(cells.select(*key, "vx", "vy", "vz", value), [*key, "vx", "vy", "vz"], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def frontier_weights(cells: DataFrame, frontier: DataFrame, key: list[str], alpha: float, reach: int) -> DataFrame:
    """exp(-alpha^2 d^2) for the distance in cells to the nearest frontier cell; 0 beyond ``reach`` cells along any axis.

    Frontier cells are put into every cell they reach, so the join is an equi-join.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = frontier.select(*key, *(F.col(f"v{a}").alias(f"f{a}") for a in "xyz"))
    for a in "xyz":
        near = near.withColumn(f"d{a}", F.explode(steps)).withColumn(f"v{a}", F.col(f"f{a}") + F.col(f"d{a}"))
    d2 = sum((F.col(f"d{a}") * F.col(f"d{a}") for a in "xyz"), F.lit(0))
    best = near.groupBy(*key, "vx", "vy", "vz").agg(F.min(d2).alias("d2"))
    return cells.join(best, [*key, "vx", "vy", "vz"], "left").withColumn("weight", F.coalesce(F.exp(-alpha * alpha * F.col("d2")), F.lit(0.0)))
