"""Scalar column builders: missing values, bins, labels, robust scores, curve fits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_WORDS = ("", "none", "null", "nan")


def number(c: Column) -> Column:
    """A double in which NaN and infinities are null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | F.abs(d).isin(float("inf")), None).otherwise(d)


def safe_number(text: Column, default: float | None = None) -> Column:
    return F.coalesce(number(text.try_cast("double")), F.lit(default))


def label(c: Column) -> Column:
    """A category name without case and outer white space, with underscores; empty and unknown are null."""
    key = F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"[\s-]", "_")
    return F.when(~key.isin("", "unknown", "null", "none"), key)


def error_word(c: Column) -> Column:
    """An error message, where the several words for "no error" are null."""
    word = F.lower(F.trim(c))
    return F.when(~word.isin(*NULL_WORDS), word)


def ratio(num: Column, den: Column, eps: float = 1e-12) -> Column:
    return F.when(den > eps, num / den)


def float_bin(x: Column, width: float, digits: int = 2) -> Column:
    """Lower edge of the bin, by the remainder (floor of the quotient is off by one at some edges)."""
    w = F.lit(width)
    return F.round(F.round((x - x % w) / w) * w, digits)


def int_bin(x: Column, width: int) -> Column:
    """Lower edge of the bin, also right below zero."""
    return (F.floor(x / width) * width).cast("int")


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def robust_z(x: Column, med: Column, mad: Column) -> Column:
    """0 where the spread is nothing; null stays null."""
    return F.when(mad.isNull() | (mad < 1e-12), F.lit(0.0) * x).otherwise((x - med) / (F.lit(1.4826) * mad + 1e-12))


def tertile(x: Column, q1: Column, q2: Column, n: Column) -> Column:
    return F.when((n < 3) | x.isNull(), "unknown").when(x <= q1, "low").when(x <= q2, "mid").otherwise("high")


def shape_class(elongation: Column, planarity: Column, cut: float = 1.8) -> Column:
    long_, flat = elongation >= cut, planarity >= cut
    return (
        F.when(elongation.isNull() | planarity.isNull(), "unknown")
        .when(long_ & flat, "bladed")
        .when(long_, "elongated")
        .when(flat, "flat_or_sheet_like")
        .otherwise("compact")
    )


def level(x: Column, cuts: list[tuple[float, str]], above: str) -> Column:
    """Name of the first cut that ``x`` doesn't exceed."""
    out = F.when(x.isNull(), None)
    for cut, name in cuts:
        out = out.when(x <= cut, name)
    return out.otherwise(above)


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """Array of the names of all rules whose condition is true (null conditions are not)."""
    return F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules)))


def first_reason(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = F.when(rules[0][1], rules[0][0])
    for name, cond in rules[1:]:
        out = out.when(cond, name)
    return out.otherwise(otherwise)


def binary_entropy(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return -q * F.ln(q) - (1 - q) * F.ln(1 - q)


def occupancy_class(p: Column, lo: float = 0.45, hi: float = 0.65) -> Column:
    return F.when(p <= lo, "free").when(p >= hi, "occupied").otherwise("unknown")


def ramp(x: Column, lo: float, hi: float) -> Column:
    """0 below ``lo``, 1 above ``hi``, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def threshold_key(x: Column) -> Column:
    """0.010 as "0.01": at most three digits, no trailing zeros."""
    return F.rtrim(F.rtrim(F.format_string("%.3f", x), F.lit("0")), F.lit("."))


def file_safe(x: Column) -> Column:
    return F.replace(threshold_key(x), F.lit("."), F.lit("p"))


# The published coefficients of the rational approximation of the normal quantile.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
# The published coefficients of the approximation of the normal distribution function.
NORMAL_CDF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution by a rational approximation (relative error 1.2e-9)."""
    a, b, c, d = QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D

    def poly(x: Column, k: tuple[float, ...]) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    def tail(q: Column) -> Column:
        return poly(q, c) / (poly(q, d) * q + 1)

    mid = p - 0.5
    r = mid * mid
    return (
        F.when(p < 0.02425, tail(F.sqrt(-2 * F.ln(p))))
        .when(p > 1 - 0.02425, -tail(F.sqrt(-2 * F.ln(1 - p))))
        .otherwise(poly(r, a) * mid / (poly(r, b) * r + 1))
    )


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function (absolute error below 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for v in reversed(NORMAL_CDF):
        poly = (poly + v) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def lognormal_cdf(n: Column, mu: Column, sigma: Column) -> Column:
    return F.when(n > 0, normal_cdf((F.ln(n) - mu) / sigma)).otherwise(0.0)


def bisect(lo: Column, hi: Column, holds, steps: int = 60) -> Column:
    """Smallest x in [lo, hi] at which ``holds`` (false, then true) is true, by a fold over ``steps`` halvings."""
    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.array((s["lo"] + s["hi"]) / 2)  # bound once, so that ``holds`` is evaluated once
        below = lambda m: F.struct(s["lo"].alias("lo"), m.alias("hi"))
        above = lambda m: F.struct(m.alias("lo"), s["hi"].alias("hi"))
        return F.get(F.transform(mid, lambda m: F.when(holds(m), below(m)).otherwise(above(m))), 0)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["hi"])


def overlap_quality(x: Column) -> Column:
    """1 for an overlap between 0.4 and 0.5, falling by parabolas to 0 at 0 and 1."""
    return F.when(x <= 0.4, -6.25 * x * x + 5.0 * x).when(x < 0.5, 1.0).otherwise(F.greatest(F.lit(0.0), -4.0 * x * x + 4.0 * x))
