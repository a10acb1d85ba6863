"""Tail probabilities as columns."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fraction: enough for a million degrees of freedom.
STEPS = 500
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1/2."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + 7.5
    return 0.5 * log(2 * pi) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by a bounded fold."""
    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        s1 = F.struct((1 / safe(1 + even * s["d"])).alias("d"), safe(1 + even / s["c"]).alias("c"))
        d, c = 1 / safe(1 + odd * s1["d"]), safe(1 + odd / s1["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * s1["d"] * s1["c"] * d * c).alias("h"))

    d = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, m: step(s, m.cast("double")), lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), for a and b of at least 1/2."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = x < (a + 1) / (a + b + 2)
    inside = F.when(low, front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided tail probability of Student's t; null without degrees of freedom."""
    n = freedom.cast("double")
    p = incomplete_beta(n / 2, F.lit(0.5), n / (n + t * t))
    return F.when(n > 0, F.when(t == 0, 1.0).otherwise(p))
