"""Curve fits on saturation records: lognormal parameters by regression, saturation points by bisection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viewmill.functions.scalar import NORMAL_CDF, QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D, bisect, inverse_normal, lognormal_cdf, number
from viewmill.plans.sequences import curve_points
from viewmill.session import table


def lognormal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mu and sigma of each curve: ln n regressed on the normal quantile of the normalised running maximum."""
    w = Window.partitionBy("row_id").orderBy("n")
    mono = curve_points(spark, sf_dir).withColumn("m", F.max("y").over(w))
    top = F.max("m").over(Window.partitionBy("row_id"))
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("m") / F.col("top")))
    points = mono.withColumn("top", top).where("top > 0").withColumn("z", inverse_normal(p))
    fit = points.groupBy("row_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.regr_slope(F.ln("n"), "z").alias("sigma"), F.regr_intercept(F.ln("n"), "z").alias("mu"), F.var_pop("z").alias("v")
    )
    ok = fit.where("v * n_points > 1e-12 and sigma is not null")
    return ok.select("row_id", "n_points", F.round("mu", 5).alias("mu"), F.round(F.greatest("sigma", F.lit(1e-6)), 5).alias("sigma"))


def saturation_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest number of views after which ten more add at most 1 % of a fitted curve, by bisection."""
    rows = table(spark, sf_dir, "saturation").select("row_id", number(F.col("fit_mu")).alias("mu"), number(F.col("fit_sigma")).alias("sigma"))
    ok = rows.where("mu is not null and sigma > 0")
    growth = lambda n: lognormal_cdf(n + 10, F.col("mu"), F.col("sigma")) - lognormal_cdf(n, F.col("mu"), F.col("sigma"))
    mode = F.exp(F.col("mu"))
    point = bisect(mode, F.lit(1e6), lambda n: growth(n) <= 0.01, 40)
    return ok.select("row_id", F.round(point, 2).alias("n_star"), F.round(growth(point), 4).alias("growth"))


QUERIES = {"lognormal_fit": lognormal_fit, "saturation_point": saturation_point}

def _poly(x: str, k: tuple[float, ...]) -> str:
    out = f"({k[0]!r}::DOUBLE)"
    for v in k[1:]:
        out = f"({out} * {x} + ({v!r}::DOUBLE))"
    return out


def _tail(q: str) -> str:
    return f"({_poly(q, QUANTILE_C)} / ({_poly(q, QUANTILE_D)} * {q} + 1))"


def _cdf(n: str) -> str:
    """SQL for the lognormal distribution function at ``n`` views."""
    z = f"((ln({n}) - mu) / sigma)"
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for v in reversed(NORMAL_CDF):
        poly = f"(({poly} + {v!r}::DOUBLE) * {t})"
    upper = f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END)"


SQL = {
    "saturation_point": f"""WITH RECURSIVE s AS (SELECT row_id, fit_mu AS mu, fit_sigma AS sigma FROM saturation WHERE isfinite(fit_mu) AND isfinite(fit_sigma) AND fit_sigma > 0),
h AS (SELECT row_id, mu, sigma, 0 AS k, exp(mu) AS lo, 1e6::DOUBLE AS hi, (exp(mu) + 1e6::DOUBLE) / 2 AS mid FROM s
UNION ALL SELECT row_id, mu, sigma, k + 1, lo, hi, (lo + hi) / 2 FROM (
  SELECT row_id, mu, sigma, k, CASE WHEN ok THEN lo ELSE mid END AS lo, CASE WHEN ok THEN mid ELSE hi END AS hi FROM (
    SELECT *, {_cdf('(mid + 10)')} - {_cdf('mid')} <= 0.01::DOUBLE AS ok FROM h WHERE k < 40)))
SELECT row_id, round(hi, 2) AS n_star, round({_cdf('(hi + 10)')} - {_cdf('hi')}, 4) AS growth FROM h WHERE k = 40""",
    "lognormal_fit": f"""WITH c0 AS (SELECT row_id, unnest(curve_raw) AS p FROM saturation),
c AS (SELECT row_id, p.n AS n, max(p.y) AS y FROM c0 WHERE p.n IS NOT NULL AND isfinite(p.y) AND p.y >= 0 GROUP BY ALL),
m AS (SELECT *, max(y) OVER (PARTITION BY row_id ORDER BY n) AS m, max(y) OVER (PARTITION BY row_id) AS top FROM c),
p AS (SELECT row_id, n, greatest(1e-4::DOUBLE, least(1 - 1e-4::DOUBLE, m / top)) AS p FROM m WHERE top > 0),
q AS (SELECT *, sqrt(-2 * ln(p)) AS ql, sqrt(-2 * ln(1 - p)) AS qh, p - 0.5 AS d, (p - 0.5) * (p - 0.5) AS r FROM p),
z AS (SELECT row_id, n, CASE WHEN p < 0.02425 THEN {_tail('ql')} WHEN p > 1 - 0.02425 THEN -{_tail('qh')} ELSE {_poly('r', QUANTILE_A)} * d / ({_poly('r', QUANTILE_B)} * r + 1) END AS z FROM q),
f AS (SELECT row_id, count(*) AS n_points, regr_slope(ln(n), z) AS sigma, regr_intercept(ln(n), z) AS mu, var_pop(z) AS v FROM z GROUP BY 1)
SELECT row_id, n_points, round(mu, 5) AS mu, round(greatest(sigma, 1e-6), 5) AS sigma FROM f WHERE v * n_points > 1e-12 AND sigma IS NOT NULL""",
}
