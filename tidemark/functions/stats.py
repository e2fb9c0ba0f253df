"""Test statistics, p-values and thresholds as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import round_half_up

STATISTIC_CAP = 99.0


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF by the rational erf approximation 7.1.26 of Abramowitz and Stegun."""
    # fixed values: coefficients of the published approximation
    p, a1, a2, a3, a4, a5 = 0.3275911, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = ((((F.lit(a5) * t + F.lit(a4)) * t + F.lit(a3)) * t + F.lit(a2)) * t + F.lit(a1)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


def p_two_sided(z: Column) -> Column:
    """Two-sided p-value; an unknown statistic gives 1."""
    return F.coalesce(F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z))), F.lit(1.0))


def p_below(z: Column) -> Column:
    """One-sided p-value for "below"; an unknown statistic gives 1."""
    return F.coalesce(normal_cdf(z), F.lit(1.0))


def rate_z(before: Column, before_days: Column, after: Column, after_days: Column, overdispersion: float = 2.0) -> Column:
    """z of a change in a per-day count rate, widened for over-dispersion."""
    variance = before / (before_days * before_days) + after / (after_days * after_days)
    error = F.sqrt(variance) * F.lit(math.sqrt(overdispersion))
    return F.when(error == 0, F.lit(0.0)).otherwise((after / after_days - before / before_days) / error)


def below_expected_z(clicks: Column, impressions: Column, rate: Column, overdispersion: float = 2.0) -> Column:
    """z of clicks against a binomial expectation; NULL when the rate is outside (0, 1)."""
    expected = impressions * rate
    variance = expected * (F.lit(1.0) - rate) * F.lit(overdispersion)
    return F.try_divide(clicks - expected, F.sqrt(F.greatest(variance, F.lit(0.0))))


def capped(z: Column) -> Column:
    """Statistic limited to plus or minus 99."""
    return F.greatest(F.lit(-STATISTIC_CAP), F.least(F.lit(STATISTIC_CAP), z))


def welch(mean1: Column, var1: Column, n1: Column, mean2: Column, var2: Column, n2: Column) -> Column:
    """Welch t of the second mean against the first; no spread at all gives 0 or the cap."""
    error = F.sqrt(F.coalesce(var1, F.lit(0.0)) / n1 + F.coalesce(var2, F.lit(0.0)) / n2)
    shift = mean2 - mean1
    return F.when(error == 0, F.signum(shift) * F.lit(STATISTIC_CAP)).otherwise(capped(shift / error))


def two_proportion_z(num1: Column, den1: Column, num2: Column, den2: Column, overdispersion: Column) -> Column:
    """Pooled two-proportion z divided by the root of the over-dispersion."""
    pooled = (num1 + num2) / (den1 + den2)
    error = F.sqrt(pooled * (F.lit(1.0) - pooled) * (F.lit(1.0) / den1 + F.lit(1.0) / den2))
    z = (num2 / den2 - num1 / den1) / error / F.sqrt(F.greatest(F.lit(1.0), overdispersion))
    return F.when(error == 0, F.lit(0.0)).otherwise(capped(z))


def poisson_rate_z(before: Column, before_days: Column, after: Column, after_days: Column, overdispersion: Column) -> Column:
    """Per-day count rate z divided by the root of the over-dispersion."""
    error = F.sqrt(before / (before_days * before_days) + after / (after_days * after_days))
    z = (after / after_days - before / before_days) / error / F.sqrt(F.greatest(F.lit(1.0), overdispersion))
    return F.when(error == 0, F.lit(0.0)).otherwise(capped(z))


def parse_threshold(text: Column) -> Column:
    """STRUCT<operator, value> from text like ``>= 1.8 percent``, NULL if it is none."""
    pattern = r"^(>=|<=|>|<|==|=)\s*(-?\d+(?:\.\d+)?)(?:\s+.*)?$"
    trimmed = F.trim(text)
    return F.when(
        trimmed.rlike(pattern),
        F.struct(
            F.regexp_extract(trimmed, pattern, 1).alias("operator"),
            F.regexp_extract(trimmed, pattern, 2).try_cast("double").alias("value"),
        ),
    )


def meets_threshold(actual: Column, threshold: Column) -> Column:
    """Whether a value meets a parsed threshold; unknown on either side is false."""
    op, bound = threshold["operator"], threshold["value"]
    met = (
        F.when(op == ">", actual > bound)
        .when(op == ">=", actual >= bound)
        .when(op == "<", actual < bound)
        .when(op == "<=", actual <= bound)
        .otherwise(actual == bound)
    )
    return F.coalesce(met, F.lit(False))


def pct_change(before: Column, after: Column, digits: int = 2) -> Column:
    """Change in percent of the absolute before value; NULL when that is zero."""
    return F.when(before != 0, round_half_up((after - before) / F.abs(before) * 100, digits))


def curve_struct(curve: dict) -> Column:
    """A position to rate curve as one STRUCT<xs, ys> column of sorted knots."""
    knots = sorted((float(x), float(y)) for x, y in curve.items())
    return F.struct(
        F.array(*[F.lit(x) for x, _ in knots]).alias("xs"),
        F.array(*[F.lit(y) for _, y in knots]).alias("ys"),
    )


def interpolate(x: Column, curve: Column) -> Column:
    """Piecewise linear value on a STRUCT<xs, ys> curve, flat outside its knots."""

    def value(bound: Column) -> Column:
        position, xs, ys = bound["x"], bound["curve"]["xs"], bound["curve"]["ys"]
        below = F.size(F.filter(xs, lambda knot: knot < position))
        left = F.greatest(below, F.lit(1))
        x1, x2 = F.try_element_at(xs, left), F.try_element_at(xs, below + 1)
        y1, y2 = F.try_element_at(ys, left), F.try_element_at(ys, below + 1)
        inside = y1 + (position - x1) / (x2 - x1) * (y2 - y1)
        flat = F.when(below == 0, F.try_element_at(ys, F.lit(1))).when(below >= F.size(xs), F.try_element_at(ys, F.lit(-1)))
        return F.when(position.isNotNull(), flat.otherwise(inside))

    # bound once, so that a curve from a subquery is referred to once
    bound = F.array(F.struct(x.cast("double").alias("x"), curve.alias("curve")))
    return F.element_at(F.transform(bound, value), 1)
