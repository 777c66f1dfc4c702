"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cumulative Poisson(1) probabilities of 0, 1, 2 ... draws.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def r6(x: Column | str) -> Column:
    """Rounded to six digits, the precision that results are compared at."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that is a hash of the keys, equal on any partitioning and in plain SQL."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def poisson_draws(u: Column) -> Column:
    """How often a unit is drawn in a bootstrap replicate: Poisson(1) by inversion of a uniform hash."""
    return total([(u >= p).cast("int") for p in POISSON])


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def odds_ratio(b: Column, limit: float = 30.0) -> Column:
    return F.exp(F.greatest(F.least(b, F.lit(limit)), F.lit(-limit)))


def helmert(p: int) -> list[list[float]]:
    """Orthonormal basis of log-ratio coordinates, (p - 1) x p: part i + 1 against the mean of those before it."""
    rows = []
    for i in range(1, p):
        rows.append([1 / math.sqrt(i * (i + 1))] * i + [-i / math.sqrt(i * (i + 1))] + [0.0] * (p - i - 1))
    return rows


def combine(weights, columns) -> Column:
    """A linear combination, without the terms of weight zero."""
    return total([F.lit(w) * c for w, c in zip(weights, columns, strict=True) if w])


def erfc_p(z: Column) -> Column:
    """Two-sided normal tail of ``abs(z)`` by a rational approximation (relative error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    terms = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda acc, c: acc * t + c, reversed(terms), F.lit(0.0))
    return t * F.exp(-x * x - 1.26551223 + t * poly)
