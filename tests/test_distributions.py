"""Distribution functions against sums, integrals and known values."""

import math

import pytest
from pyspark.sql import functions as F

from dispatchgrid.functions import distributions as D


def test_log_gamma(spark):
    xs = [1e-6, 0.3, 1.0, 1.5, 2.0, 10.0, 171.5, 1e4, 1e7]
    got = [r["v"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(D.log_gamma(F.col("x")).alias("v")).collect()]
    assert all(abs(a - math.lgamma(x)) < 1e-11 * max(1, abs(a)) for a, x in zip(got, xs, strict=True))


@pytest.mark.parametrize("mean", [0.0, 0.01, 3.0, 59.5, 700.0, 30000.0])
def test_poisson(spark, mean):
    us = [1e-6, 0.025, 0.3, 0.5, 0.9, 0.975, 0.999999]
    got = [r["k"] for r in spark.createDataFrame([(u,) for u in us], "u double").select(D.poisson_quantile(F.lit(mean), F.col("u")).alias("k")).collect()]

    def cdf(k):
        return math.fsum(math.exp(-mean + i * math.log(mean) - math.lgamma(i + 1)) for i in range(k + 1)) if mean else 1.0

    for u, k in zip(us, got, strict=True):
        assert cdf(k) >= u - 1e-12 and (k == 0 or cdf(k - 1) < u + 1e-12)


def test_t_table(spark):
    """Two-sided chances of 5 and 1 in 100 from printed tables."""
    table = [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (1.984, 100, 0.05), (2.626, 100, 0.01), (1.960, 100000, 0.05), (0.0, 7, 1.0)]
    rows = spark.createDataFrame([(t, df) for t, df, _ in table], "t double, df long").select(D.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(abs(r["p"] - p) < 6e-5 for r, (_, _, p) in zip(rows, table, strict=True))


def test_beta_is_a_binomial_tail(spark):
    for n, k, x in ((10, 3, 0.2), (50, 25, 0.5), (200, 150, 0.8), (7, 7, 0.99)):
        got = spark.range(1).select(D.beta_i(F.lit(x), F.lit(float(k)), F.lit(float(n - k + 1))).alias("v")).first()["v"]
        assert abs(got - math.fsum(math.comb(n, i) * x**i * (1 - x) ** (n - i) for i in range(k, n + 1))) < 1e-12
