"""Aggregate and scalar expressions shared by the operators."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: str | Column) -> Column:
    """The value as a double, with NaN taken for missing: the one rule for NaN in all statistics."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(value), value)


def pearson(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation that is NULL, not an error, for constant input; NaN counts as missing."""
    a, b = known(a), known(b)
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)


def entropy_from_counts(count: str | Column) -> Column:
    """Shannon entropy in nats of a table of value counts: ln N - sum(c ln c) / N."""
    c = F.col(count) if isinstance(count, str) else count
    total = F.sum(c)
    raw = F.ln(total) - F.try_divide(F.sum(c * F.ln(c)), total)
    return F.coalesce(F.greatest(raw, F.lit(0.0)), F.lit(0.0))


def harmonic_score(*measures: Column) -> Column:
    """Harmonic mean of measures that may be zero."""
    epsilon = F.lit(1e-10)
    parts = sum((F.lit(1.0) / (m + epsilon) for m in measures), F.lit(0.0))
    return F.lit(float(len(measures))) / parts


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def student_t_cdf(x: float, nu: float) -> float:
    """Student-t distribution function by Simpson's rule on the angle substitution.

    With t = sqrt(nu) tan(u) the density becomes proportional to cos(u)**(nu - 1), which
    is smooth and bounded.
    """
    upper, steps = math.atan(x / math.sqrt(nu)), 2000
    h = upper / steps
    total = 1.0 + math.cos(upper) ** (nu - 1)
    for i in range(1, steps):
        total += (4 if i % 2 else 2) * math.cos(i * h) ** (nu - 1)
    scale = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    return 0.5 + scale * total * h / 3


def student_t_quantile(p: float, nu: float) -> float:
    """Inverse of the distribution function by bisection."""
    low, high = -1.0, 1.0
    while student_t_cdf(low, nu) > p:
        low *= 2
    while student_t_cdf(high, nu) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        if student_t_cdf(middle, nu) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def kolmogorov_tail(statistic: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample KS statistic.

    The alternating series is used from 0.3 on; below it the tail is 1 to double precision
    of any practical use.
    """
    x = statistic * F.sqrt(n1 * n2 / (n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    return F.when(x < 0.3, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))
