"""Filters that keep their reasons, rule compilation and id-list clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewmill.functions.scalar import error_word, number, ratio

OPS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}


def geometry_columns(annotations: DataFrame) -> DataFrame:
    """Shape measures of each annotation; a measure without a usable base is null."""
    ext = F.sort_array(F.transform("bbox_extent", number), asc=False)
    e1, e2, e3 = (F.get(ext, i) for i in range(3))
    vol, hull, area = (number(F.col(c)) for c in ("volume", "convex_hull_volume", "area"))
    return annotations.withColumns(
        {
            "elongation": ratio(e1, e2),
            "planarity": ratio(e2, e3),
            "fill_ratio": ratio(vol, e1 * e2 * e3),
            "hull_ratio": ratio(vol, hull),
            "compactness": ratio(F.pow(F.greatest(vol, F.lit(0.0)), F.lit(2.0 / 3)), area),
            "log_faces": F.log1p(F.greatest(F.col("face_count"), F.lit(0)).cast("double")),
            "error_word": error_word(F.col("error")),
        }
    )


def box_measures(annotations: DataFrame) -> DataFrame:
    """Measures against the bounding box: extents in descending order, ratios of area and volume, log area ratio, signed Euler norm."""
    sides = F.sort_array(F.transform("bbox_extent", number), asc=False)
    df = annotations.withColumns({f"e{i + 1}": F.get(sides, i) for i in range(3)})
    area, volume = F.when(number(F.col("area")) >= 0, number(F.col("area"))), F.abs(number(F.col("volume")))
    surface = 2 * (F.col("e1") * F.col("e2") + F.col("e1") * F.col("e3") + F.col("e2") * F.col("e3"))
    df = df.withColumns({"bbox_area_ratio": ratio(area, surface), "bbox_volume_ratio": ratio(volume, F.col("e1") * F.col("e2") * F.col("e3"))})
    faces = F.log1p(F.greatest(F.col("face_count"), F.lit(0)).cast("double"))
    return df.withColumns({"log_bbox_area_ratio": F.log1p("bbox_area_ratio"), "euler_signed_norm": ratio(F.col("euler_number").cast("double"), faces)})


def below_or_missing(c: Column, least: float) -> Column:
    """A minimum check that a missing value fails."""
    return c.isNull() | (c < least)


def above(c: Column, most: float) -> Column:
    """A maximum check that a missing value passes."""
    return c.isNotNull() & (c > most)


def compile_rule(rule: dict, atol: float = 1e-6) -> Column:
    """A condition from ``{"logic": and|or, "rules": [{"field", "op", "value"}]}``; equality is within ``atol``."""
    logic = rule.get("logic", "and")
    if logic not in ("and", "or") or not rule.get("rules"):
        raise ValueError(f"a rule needs logic and/or and at least one part: {rule}")

    def part(r: dict) -> Column:
        if "rules" in r:
            return compile_rule(r, atol)
        column, op, value = F.col(r["field"]), r["op"], float(r["value"])
        if op in ("==", "!="):
            near = F.abs(column - value) <= atol
            return near if op == "==" else ~near
        if op not in OPS:
            raise ValueError(f"unknown operator {op!r}")
        return OPS[op](column, value)

    return reduce(lambda a, b: a & b if logic == "and" else a | b, map(part, rule["rules"]))


def canonical_ids(ids: Column, drop: Column | None = None, size: int | None = None) -> Column:
    """Sorted distinct ids in [0, size) that are not in ``drop``; null for a null list."""
    kept = F.filter(ids, lambda x: x.isNotNull() & (x >= 0) & (x < size if size is not None else F.lit(True)))
    if drop is not None:
        kept = F.array_except(kept, F.coalesce(drop, F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(kept))


def keep_columns(df: DataFrame, wanted: list[str], rename: dict[str, str] | None = None) -> DataFrame:
    """The wanted columns that exist, in that order, some under new names."""
    new = rename or {}
    return df.select(*(F.col(c).alias(new.get(c, c)) for c in wanted if c in df.columns))


def retry_reason(
    error: Column, load_ok: Column, all_failed: bool = False, not_loaded: bool = False, exact: list[str] = (), contains: list[str] = (), pattern: str | None = None
) -> Column:
    """Why a row is to be tried again, by the first rule that holds; null if none does. ``error`` is null where there was none."""
    rules: list[tuple[str, Column]] = []
    if all_failed:
        rules.append(("all_failed", error.isNotNull()))
    if not_loaded:
        rules.append(("not_loaded", ~F.coalesce(load_ok, F.lit(False))))
    rules += [(f"error={e}", error == e) for e in exact]
    rules += [(f"contains={t}", F.contains(error, F.lit(t))) for t in contains]
    if pattern is not None:
        rules.append((f"matches={pattern}", error.rlike(pattern)))
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out
