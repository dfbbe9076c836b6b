"""Reproducible random draws as column expressions.

The stream is counter-based: a draw is a function of a text (seed, group, cell,
replicate), so it does not depend on partitions, retries or the order of rows, and any
engine with MD5 draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Acklam's rational approximation of the normal quantile (relative error 1.2e-9).
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
TAIL = 0.02425
SMALL_MEAN, MOST = 16, 64  # means up to 16 are inverted exactly; such a draw over 64 has a chance of 1e-18


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the text of ``parts`` (NULLs are left out), 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(u: Column, q: Column, r: Column) -> Column:
    """The quantile of the standard normal distribution; ``q`` is u - 0.5, ``r`` its square."""
    def tail(p: Column) -> Column:
        x = F.sqrt(F.lit(-2.0) * F.log(p))
        return polynomial(ACKLAM_C, x) / polynomial(ACKLAM_D, x)

    middle = polynomial(ACKLAM_A, r) * q / polynomial(ACKLAM_B, r)
    return F.when(u < TAIL, tail(u)).when(u > 1 - TAIL, -tail(F.lit(1.0) - u)).otherwise(middle)


def poisson_cdf(mean: int) -> list[float]:
    """P(X <= k) for k = 0 .. MOST."""
    p = total = math.exp(-mean)
    out = [total]
    for k in range(1, MOST + 1):
        p *= mean / k
        total += p
        out.append(total)
    return out


def with_poisson(df: DataFrame, draws: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``df`` with, for every ``name -> (mean, u)``, the quantile ``u`` of a Poisson
    distribution with a whole mean: inverted exactly up to ``SMALL_MEAN``, beyond it the
    normal quantile with Cornish and Fisher's correction for skewness and kurtosis,
    rounded. Steps are columns, or every use of a number would draw it again."""
    c = F.col
    df = df.select("*", *(x for n, (mean, u) in draws.items() for x in (mean.cast("double").alias(f"_m_{n}"), u.alias(f"_u_{n}"))))
    df = df.select("*", *((c(f"_u_{n}") - F.lit(0.5)).alias(f"_q_{n}") for n in draws))
    df = df.select("*", *((c(f"_q_{n}") * c(f"_q_{n}")).alias(f"_r_{n}") for n in draws))
    df = df.select("*", *(normal_quantile(c(f"_u_{n}"), c(f"_q_{n}"), c(f"_r_{n}")).alias(f"_z_{n}") for n in draws))
    tables = F.array(*(F.array(*map(F.lit, poisson_cdf(m))) for m in range(SMALL_MEAN + 1)))

    def count(n: str) -> Column:
        mean, u, z, root = c(f"_m_{n}"), c(f"_u_{n}"), c(f"_z_{n}"), F.sqrt(f"_m_{n}")
        exact = F.size(F.filter(F.get(tables, mean.cast("int")), lambda x: x < u)).cast("double")
        bent = mean + root * z + (z * z - F.lit(1.0)) / F.lit(6.0) + (z - z * z * z) / (F.lit(72.0) * root)
        return F.when(mean <= SMALL_MEAN, exact).otherwise(F.greatest(F.floor(bent + F.lit(0.5)).cast("double"), F.lit(0.0)))

    return df.select("*", *(count(n).alias(n) for n in draws)).drop(*(f"_{x}_{n}" for n in draws for x in "muqrz"))
