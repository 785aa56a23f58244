"""Column builders for statistics Spark does not ship in the wanted flavour."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Acklam's rational approximation of the
# inverse normal distribution function (relative error below 1.15e-9).
ICDF_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239]
ICDF_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572]
ICDF_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783]
ICDF_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416]
ICDF_LOW = 0.02425


def horner(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_icdf(p: Column) -> Column:
    q = p - F.lit(0.5)
    r = q * q
    centre = horner(ICDF_A, r) * q / (horner(ICDF_B, r) * r + F.lit(1.0))
    tail_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    tail_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))

    def tail(t: Column) -> Column:
        return horner(ICDF_C, t) / (horner(ICDF_D, t) * t + F.lit(1.0))

    return F.when(p < ICDF_LOW, tail(tail_lo)).when(p > 1 - ICDF_LOW, -tail(tail_hi)).otherwise(centre)


def skew_sample_std(col: str | Column) -> Column:
    """mean(((x-m)/s)^3) with the sample deviation s; 0 for a constant column."""
    n = F.count(col).cast("double")
    factor = F.pow((n - 1.0) / n, F.lit(1.5))
    return F.when(F.coalesce(F.stddev_samp(col), F.lit(0.0)) < 1e-8, F.lit(0.0)).otherwise(F.skewness(col) * factor)


def kurt_sample_std(col: str | Column) -> Column:
    """mean(((x-m)/s)^4) - 3 with the sample deviation s; -3 for a constant column."""
    n = F.count(col).cast("double")
    factor = F.pow((n - 1.0) / n, F.lit(2.0))
    return F.when(F.coalesce(F.stddev_samp(col), F.lit(0.0)) < 1e-8, F.lit(-3.0)).otherwise(
        (F.kurtosis(col) + 3.0) * factor - 3.0
    )


def kolmogorov_pvalue(stat: Column, n1: Column, n2: Column, terms: int = 40) -> Column:
    """Asymptotic two-sample p-value: the theta series for small arguments, the
    alternating series for the rest."""
    lam = F.sqrt(n1 * n2 / (n1 + n2)) * stat
    alternating = reduce(
        lambda a, b: a + b,
        [F.lit(2.0 * (-1.0) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam) for k in range(1, terms + 1)],
    )
    theta = reduce(
        lambda a, b: a + b,
        [F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8.0) / (lam * lam)) for k in range(1, 12)],
    )
    small = F.lit(1.0) - F.lit(math.sqrt(2.0 * math.pi)) / lam * theta
    p = F.when(lam <= 0, F.lit(1.0)).when(lam < 1.0, small).otherwise(alternating)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def binary_cross_entropy_logit(z: Column, t: Column) -> Column:
    """max(z,0) - z*t + ln(1+exp(-|z|))."""
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and hand it to `body` (a lambda inside
    another lambda would be evaluated again for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(arr: Column) -> Column:
    def scaled(top: Column) -> Column:
        return let(
            F.transform(arr, lambda v: F.exp(v - top)),
            lambda exps: let(array_sum(exps), lambda whole: F.transform(exps, lambda e: e / whole)),
        )

    return let(F.array_max(arr), scaled)
