"""Statistical column expressions.

Student t tail probability: the two-sided p-value is the regularised incomplete beta function
I_x(nu / 2, 1 / 2) at x = nu / (nu + t^2). It is evaluated by its continued fraction with a fixed number of steps
(the modified Lentz recurrence as a SQL fold), on the side of the symmetry I_x(a, b) = 1 - I_1-x(b, a) where it
converges fast, so the cost does not depend on nu. Log gamma is the Lanczos sum. All of it is a JVM expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Lanczos coefficients for g = 7, nine terms.
LANCZOS_G = 7.0
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
STEPS = 120  # pairs of the continued fraction: 1e-12 for degrees of freedom up to tens of thousands
TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z > 0.5."""
    y = z - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + k)
    base = y + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.ln(base) - base + F.ln(total)


def _nonzero(c: Column) -> Column:
    return F.when(F.abs(c) < TINY, F.lit(TINY)).otherwise(c)


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, for x below (a + 1) / (a + b + 2)."""
    def step(c, d, term):
        return 1 / _nonzero(1 + term * d), _nonzero(1 + term / c)

    def pair(s, k):
        """The even and the odd step of index k, one after the other, each in a struct of its own."""
        m = k.cast("double")
        even = m * (s["b"] - m) * s["x"] / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m))
        d, c = step(s["c"], s["d"], even)
        half = F.struct(s["x"].alias("x"), s["a"].alias("a"), s["b"].alias("b"), c.alias("c"), d.alias("d"),
                        (s["h"] * c * d).alias("h"))

        def odd(u):
            term = -(u["a"] + m) * (u["a"] + u["b"] + m) * u["x"] / ((u["a"] + 2 * m) * (u["a"] + 2 * m + 1))
            e, f = step(u["c"], u["d"], term)
            return F.struct(u["x"].alias("x"), u["a"].alias("a"), u["b"].alias("b"), f.alias("c"), e.alias("d"),
                            (u["h"] * f * e).alias("h"))
        return F.get(F.transform(F.array(half), odd), F.lit(0))  # binds the struct once

    first = 1 / _nonzero(1 - (a + b) * x / (a + 1))
    start = F.struct(x.alias("x"), a.alias("a"), b.alias("b"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, pair, lambda s: s["h"])


def incomplete_beta(x: Column, y: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for y = 1 - x (given apart, so that neither loses digits), a and b at least 0.5."""
    low = x <= (a + 1) / (a + b + 2)
    p, q = F.when(low, x).otherwise(y), F.when(low, y).otherwise(x)
    c, d = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a)
    # Gamma(z) at z = 0.5 by the step from 1.5.
    def lg(z):
        return log_gamma(z + 1) - F.ln(z)
    front = F.exp(lg(c + d) - lg(c) - lg(d) + c * F.ln(p) + d * F.ln(q)) / c
    side = F.when(p <= 0, F.lit(0.0)).otherwise(front * _fraction(p, c, d))
    return F.when(low, side).otherwise(1 - side)


def t_two_sided_p(t: Column, nu: Column) -> Column:
    """P(|T| > |t|) for Student t with ``nu`` >= 1 degrees of freedom; null for a null or NaN t."""
    n = nu.cast("double")
    t2 = t * t
    p = incomplete_beta(n / (n + t2), t2 / (n + t2), n / 2, F.lit(0.5))
    return (F.when(t.isNull() | F.isnan(t), F.lit(None).cast("double"))
            .when(F.abs(t) == float("inf"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), p)))
