"""Normal and Student t terms: tails as columns, quantiles as numbers that parameters need."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_tail(z: Column) -> Column:
    """P(Z > z).

    Near 0 one half less the series of z**(2k+1) / (1 3 5 ... (2k+1)); further out the continued fraction of Mills' ratio,
    from its 100th level up.
    """
    a = F.abs(z)
    density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    first = F.struct(a.alias("term"), a.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * a * a / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), first, add, lambda s: s["sum"])
    mills = F.aggregate(F.sequence(F.lit(100), F.lit(1), F.lit(-1)), a, lambda f, k: a + k / f)
    tail = F.when(a < 2.5, 0.5 - density * series).otherwise(density / mills)
    return F.when(z < 0, 1 - tail).otherwise(tail)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) with ``df`` degrees of freedom."""
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Value that T stays below with probability ``p`` (0.5 <= p < 1)."""
    if p <= 0.5:
        return 0.0
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) / 2.0 > 1.0 - p:
        lo, hi = hi, hi * 2.0
    while hi - lo > 1e-13 * hi:
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        if t_two_sided(mid, df) / 2.0 > 1.0 - p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


#: From so many degrees of freedom on, t is turned into a normal deviate; the difference is below 1e-13.
MANY = 60


def slope_p_value(r2: Column, n: Column) -> Column:
    """Two-sided p-value of a least-squares slope, from r squared and the row count; NULL for under three rows.

    t has n - 2 degrees of freedom, and r squared is the squared sine of its angle: for few degrees the tail is a finite sum
    of powers of the cosine, for many Hill's expansion gives the normal deviate with the same tail.
    """
    df = (n - 2).cast("int")
    sine, cosine = F.sqrt(r2), F.sqrt(1 - r2)
    odd = df % 2 == 1

    def add(s: Column, k: Column) -> Column:
        factor = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = s["term"] * factor * (1 - r2)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    last = F.floor((df - F.when(odd, 3).otherwise(2)) / 2).cast("int")
    terms = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(terms, one, add, lambda s: s["sum"])
    inside = (F.when(df == 1, 2 / math.pi * F.atan2(sine, cosine))
              .when(odd, 2 / math.pi * (F.atan2(sine, cosine) + sine * cosine * total)).otherwise(sine * total))

    a = df - 0.5
    b = 48 * a * a
    y = -a * F.log1p(-r2)
    deviate = (((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b) + y + 3.0) / b + 1.0) * F.sqrt(y)
    few = F.greatest(F.lit(0.0), 1 - inside)
    return F.when(r2.isNotNull() & (df >= 1), F.when(r2 >= 1, 0.0).when(df < MANY, few).otherwise(2 * normal_tail(deviate)))
