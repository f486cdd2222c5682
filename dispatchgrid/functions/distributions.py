"""Distribution functions as Column expressions: regularised incomplete gamma and beta by continued fractions and series, folded
inside the JVM, and quantiles by bisection on them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """For x > 0: Stirling's series eight further on, and back by the product that lies between."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    between = F.log(x)
    for k in range(1, 8):
        between = between + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - between


def _steps(size: Column, least: int) -> Column:
    """1, 2, ... for as many steps as a fold about `size` needs: its terms fall off after some roots of it."""
    return F.sequence(F.lit(1), (least + 8 * F.ceil(F.sqrt(size))).cast("int"))


def _away(v: Column) -> Column:
    return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)


def gamma_q(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for a > 0 and x >= 0."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    # Below a + 1: the series of P. Above: the continued fraction of Q.
    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    lower = front * F.aggregate(_steps(a, 40), start, add)["sum"]
    b0 = x + 1 - a
    begin = F.struct((1 / _away(b0)).alias("d"), F.lit(1 / _TINY).alias("c"), (1 / _away(b0)).alias("h"))

    def fraction(s: Column, n: Column) -> Column:
        an, b = -n * (n - a), b0 + 2 * n
        d = 1 / _away(an * s["d"] + b)
        c = _away(b + an / s["c"])
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    upper = front * F.aggregate(_steps(x, 40), begin, fraction)["h"]
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - lower).otherwise(upper)


def beta_i(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b > 0."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))

    def tail(x: Column, a: Column, b: Column) -> Column:
        d0 = 1 / _away(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def step(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d = 1 / _away(1 + even * s["d"])
            c = _away(1 + even / s["c"])
            h = s["h"] * d * c
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d2 = 1 / _away(1 + odd * d)
            c2 = _away(1 + odd / c)
            return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"))

        return F.aggregate(_steps(F.greatest(a, b), 60), start, step)["h"] / a

    value = F.when(x < (a + 1) / (a + b + 2), front * tail(x, a, b)).otherwise(1 - front * tail(1 - x, b, a))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(value)


def t_two_sided(t: Column, df: Column) -> Column:
    """The chance of a t statistic as far from 0 or farther."""
    df = df.cast("double")
    return beta_i(df / (df + t * t), df / 2, F.lit(0.5))


def poisson_cdf(k: Column, mean: Column) -> Column:
    return F.when(k < 0, F.lit(0.0)).otherwise(gamma_q(k + 1.0, mean))


def poisson_quantile(mean: Column, u: Column) -> Column:
    """The least k whose probability of k or fewer reaches u < 1, for any mean: bisection between bounds that hold 1 - 1e-16."""
    low = F.greatest(F.lit(-1.0), F.floor(mean - 9 * F.sqrt(mean) - 1).cast("double"))
    high = F.ceil(mean + 9 * F.sqrt(mean) + 40).cast("double")
    start = F.struct(low.alias("lo"), high.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("double")
        reached = poisson_cdf(mid, mean) >= u
        return F.struct(F.when(reached, s["lo"]).otherwise(mid).alias("lo"), F.when(reached, mid).otherwise(s["hi"]).alias("hi"))

    rounds = F.ceil(F.log2(high - low) + 1).cast("int")
    return F.when(mean <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), rounds), start, halve)["hi"].cast("int"))
