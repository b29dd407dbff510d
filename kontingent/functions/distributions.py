"""Tails of distributions as column expressions, for statistics of whole tables of models.

``special`` has the same functions for single numbers in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From so many degrees of freedom on the cube root of chi-squared is taken as normal.
LARGE_DF = 100
#: Steps of the error function's continued fraction, and terms of its series.
FRACTION, SERIES = 60, 60


def _sum(first: Column, n: Column, ratio) -> Column:
    """first + first r(1) + first r(1) r(2) + ...: n terms; 0 for none."""
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda acc, k: F.struct((acc["term"] * ratio(k)).alias("term"), (acc["total"] + acc["term"]).alias("total")), lambda acc: acc["total"])


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0: a series below 2, a continued fraction above."""
    y = z * z
    # erf(z) = 2 z e^-y / sqrt(pi) (1 + y / 1.5 + y^2 / (1.5 2.5) + ...)
    near = 1 - z * F.exp(-y) * (2 / math.sqrt(math.pi)) * _sum(F.lit(1.0), F.lit(SERIES), lambda k: y / (k + 0.5))
    far = F.exp(-y) / math.sqrt(math.pi) / (z + F.aggregate(F.sequence(F.lit(FRACTION), F.lit(1)), F.lit(0.0), lambda acc, k: (k / 2.0) / (z + acc)))
    return F.when(z < 2, near).otherwise(far)


def normal_sf(z: Column) -> Column:
    """P(Z > z)."""
    upper = erfc(F.abs(z) / math.sqrt(2.0)) / 2
    return F.when(z >= 0, upper).otherwise(1 - upper)


def chi2_sf(x: Column, df: Column) -> Column:
    """P(X > x) for whole degrees of freedom: a finite sum below ``LARGE_DF``, else by the normal tail of the cube root.

    1 where x or df is not positive.
    """
    y, m = x / 2, F.floor(df / 2).cast("int")
    even = _sum(F.exp(-y), m, lambda k: y / k)
    odd = erfc(F.sqrt(y)) + _sum(F.exp(-y) * F.sqrt(y) * (2 / math.sqrt(math.pi)), m, lambda k: y / (k + 0.5))
    d = df.cast("double")
    spread = 2 / (d * 9)
    large = normal_sf((F.pow(x / d, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    return (F.when((x <= 0) | (df <= 0), F.lit(1.0)).when(df >= LARGE_DF, large)
            .otherwise(F.least(F.lit(1.0), F.when(df % 2 == 0, even).otherwise(odd))))
