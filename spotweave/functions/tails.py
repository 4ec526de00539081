"""Upper tails of the F and the studentised range distribution, as column expressions.

They are meant for result rows (one per metric or per pair of methods), where
quadrature sums over literal arrays of nodes cost little. No Python runs in the
tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, functions as F

#: Terms of Stirling's series for log gamma, by odd powers of 1 / x.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
# fixed values: rational approximation of the normal distribution function (Hart 1968, no. 5666), highest power first
_UPPER = (
    3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
    220.206867912376,
)
_LOWER = (
    8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
)
#: Quadrature nodes over the deviation and over the normal deviates, and the range of the latter.
OUTER, INNER, REACH = 96, 64, 8.5
_TINY = 1e-300


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""

    def series(y: Column) -> Column:
        s = y + 8
        out = (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi)
        for i, c in enumerate(_STIRLING):
            out = out + c / F.pow(s, F.lit(2.0 * i + 1))
        product = y
        for i in range(1, 8):
            product = product * (y + i)
        return out - F.log(product)

    return _let(x, series)


def normal_cdf(z: Column) -> Column:
    """Distribution function of a standard normal deviate."""

    def horner(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    x = F.abs(z)
    below = F.when(x < 7.07, F.exp(-0.5 * x * x) * horner(_UPPER, x) / horner(_LOWER, x)).otherwise(0.0)
    return F.when(z > 0, 1 - below).otherwise(below)


def _guard(x: Column) -> Column:
    return F.when(F.abs(x) > _TINY, x).otherwise(_TINY)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function (Lentz's method); its length follows from ``a`` and ``b``."""
    first = 1 / _guard(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("h"), F.lit(1.0).alias("c"), first.alias("d"))
    # the terms needed grow with the root of the larger parameter
    steps = (F.lit(120) + 8 * F.sqrt(F.greatest(a, b))).cast("int") * 2

    def step(state: Column, i: Column) -> Column:
        m = F.floor((i + 1) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        num = F.when(i % 2 == 1, even).otherwise(odd)
        d = 1 / _guard(1 + num * state["d"])
        c = _guard(1 + num / state["c"])
        return _let(F.struct(c.alias("c"), d.alias("d")), lambda s: F.struct((state["h"] * s["c"] * s["d"]).alias("h"), s["c"].alias("c"), s["d"].alias("d")))

    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["h"])


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for 0 <= x <= 1 and positive ``a`` and ``b``."""

    def body(r: Column) -> Column:
        # the fraction converges on one side of the mean; the other side is its mirror image
        front = F.exp(lgamma(r["a"] + r["b"]) - lgamma(r["a"]) - lgamma(r["b"]) + r["a"] * F.log(r["x"]) + r["b"] * F.log1p(-r["x"]))
        part = front * _fraction(r["a"], r["b"], r["x"]) / r["a"]
        return F.when(r["swap"], 1 - part).otherwise(part)

    swap = x >= (a + 1) / (a + b + 2)
    args = F.struct(
        F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"),
        F.when(swap, 1 - x).otherwise(x).alias("x"), swap.alias("swap"),
    )
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(_let(args, body))


def _finite(*values: Column) -> Column:
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf)
    return ok


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f) with ``df1`` and ``df2`` degrees of freedom; NULL without a finite f or positive degrees."""
    f, df1, df2 = (c.cast("double") for c in (f, df1, df2))
    known = _finite(f, df1, df2) & (df1 > 0) & (df2 > 0)
    return F.when(known & (f <= 0), 1.0).when(known, beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))


def range_tail(q: Column, k: Column, df: Column) -> Column:
    """P(studentised range of ``k`` means with ``df`` error degrees > q); NULL where it isn't defined."""
    q, k, df = (c.cast("double") for c in (q, k, df))
    known = _finite(q, k, df) & (k >= 2) & (df > 0)
    nodes = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("w")) for a, b in zip(*np.polynomial.legendre.leggauss(OUTER))])
    x, w = np.polynomial.legendre.leggauss(INNER)
    z = REACH * x
    phi = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * w * REACH
    below = [0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]
    deviates = F.array(
        *[F.struct(F.lit(float(a)).alias("z"), F.lit(float(b)).alias("phi"), F.lit(c).alias("cdf")) for a, b, c in zip(z, phi, below)]
    )

    def body(r: Column) -> Column:
        def within(width: Column) -> Column:
            """P(range of k normal deviates < width)."""
            gap = lambda d: F.greatest(d["cdf"] - normal_cdf(d["z"] - width), F.lit(0.0))
            return r["k"] * F.aggregate(deviates, F.lit(0.0), lambda acc, d: acc + d["phi"] * F.pow(gap(d), r["k"] - 1))

        # s = sqrt(chi2 / df) lies within a few 1 / sqrt(2 df) of 1; its density is scaled by its own sum
        half = 9 / F.sqrt(2 * r["df"])

        def add(acc: Column, node: Column) -> Column:
            low = F.greatest(1 - half, F.lit(1e-8))
            s = 0.5 * (1 + half - low) * node["x"] + 0.5 * (1 + half + low)
            return _let(
                s,
                lambda v: _let(
                    node["w"] * F.exp((r["df"] - 1) * F.log(v) - 0.5 * r["df"] * (v - 1) * (v + 1)),
                    lambda p: F.struct((acc["top"] + p * within(r["q"] * v)).alias("top"), (acc["all"] + p).alias("all")),
                ),
            )

        zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("all"))
        return F.aggregate(nodes, zero, add, lambda s: F.least(F.greatest(1 - s["top"] / s["all"], F.lit(0.0)), F.lit(1.0)))

    return F.when(known & (q <= 0), 1.0).when(known, _let(F.struct(q.alias("q"), k.alias("k"), df.alias("df")), body))
