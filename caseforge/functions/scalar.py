"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fisher_z(r: Column) -> Column:
    return 0.5 * F.log((1 + r) / (1 - r))


def fisher_inverse(z: Column) -> Column:
    return (F.exp(2 * z) - 1) / (F.exp(2 * z) + 1)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def t_of_r(r: Column, n: int) -> Column:
    return r * math.sqrt(n - 2) / F.sqrt(1 - r * r)


def two_sided_t_p(t: Column, n: int) -> Column:
    """Two-sided p of Student's t with n degrees of freedom, by the finite sums for whole n (terms grow with n; 10,000 at most)."""
    if not 1 <= n <= 10_000:
        raise ValueError("degrees of freedom must be 1 to 10,000")
    angle = F.atan(F.abs(t) / math.sqrt(n))
    c2 = 1 / (1 + t * t / n)  # squared cosine of the angle
    odd = n % 2
    steps = F.sequence(F.lit(1), F.lit(max(1, (n - 1) // 2 if odd else n // 2 - 1)))
    many = (n - 3) // 2 if odd else n // 2 - 1

    def term(state: Column, k: Column) -> Column:
        factor = (2.0 * k / (2.0 * k + 1)) if odd else ((2.0 * k - 1) / (2.0 * k))
        value = state["term"] * factor * c2
        return F.struct(value.alias("term"), (state["sum"] + value).alias("sum"))

    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(steps, first, term)["sum"] if many >= 1 else F.lit(1.0)
    if many >= 1 and odd:
        total = F.aggregate(F.sequence(F.lit(1), F.lit(many)), first, term)["sum"]
    inside = (2 / math.pi) * (angle + (F.sin(angle) * F.cos(angle) * total if n > 1 else 0)) if odd else F.sin(angle) * total
    return F.greatest(F.lit(0.0), 1 - inside)


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, by Chebyshev fit; relative error under 1.2e-7."""
    t = 1 / (1 + 0.5 * x)
    # fixed values: the coefficients of the fit, lowest power first
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = poly * t + k
    return t * F.exp(-x * x + poly)


def normal_cdf(x: Column) -> Column:
    upper = 0.5 * erfc(F.abs(x) / math.sqrt(2))
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def two_sided_normal_p(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def log_spaced(a: float, b: float, n: int) -> list[float]:
    """n points spaced geometrically, rescaled to run from a to b."""
    raw = [math.exp(k / max(n - 1, 1)) for k in range(n)]
    return [a + (b - a) * (x - raw[0]) / ((raw[-1] - raw[0]) or 1) for x in raw]


def correlation(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; null where either side is constant (Spark's own corr divides by zero there)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)
