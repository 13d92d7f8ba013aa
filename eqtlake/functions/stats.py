"""Test statistics as column expressions, evaluated in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun, 7.1.26.
ERF_P = 0.3275911
ERF_A1 = 0.254829592
ERF_A2 = -0.284496736
ERF_A3 = 1.421413741
ERF_A4 = -1.453152027
ERF_A5 = 1.061405429


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function by the polynomial above, whose
    absolute error is below 1.5e-7."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    series = F.lit(ERF_A5)
    for a in (ERF_A4, ERF_A3, ERF_A2, ERF_A1):
        series = series * t + F.lit(a)
    erf = F.lit(1.0) - series * t * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def z_score(beta: Column, se: Column) -> Column:
    """|beta / se| in doubles; the caller keeps se away from 0."""
    return F.abs(beta.cast("double") / se.cast("double"))


def p_value(beta: Column, se: Column) -> Column:
    """Two-sided p-value; 1 where se is not positive or either is not finite."""
    b, s = beta.cast("double"), se.cast("double")
    unusable = (s <= 0) | ~finite(b) | ~finite(s)
    tail = F.lit(2.0) * (F.lit(1.0) - normal_cdf(z_score(b, s)))
    return F.when(unusable, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))
