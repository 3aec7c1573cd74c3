"""Special functions against plain numerical integration and library values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.functions import special as P


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def integral(f, a, b, n=200_001):
    x = np.linspace(a, b, n)
    y = f(x)
    h = (b - a) / (n - 1)
    return float(h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


@pytest.mark.parametrize("a,x", [(0.5, 0.1), (3.0, 2.0), (3.0, 9.0), (250.0, 240.0), (250.0, 300.0), (4000.0, 4100.0)])
def test_gamma_integrals(spark, a, x):
    want = integral(lambda t: 2 * np.maximum(t, 1e-150) * np.exp(2 * (a - 1) * np.log(np.maximum(t, 1e-150)) - t * t - math.lgamma(a)), 0, math.sqrt(x))
    assert abs(value(spark, P.gammainc_p(*lit(a, x))) - want) < 1e-8
    assert abs(value(spark, P.gammainc_q(*lit(a, x))) - (1 - want)) < 1e-8
    assert math.isclose(value(spark, P.lgamma(*lit(a))), math.lgamma(a), rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("a,b,x", [(2.0, 3.0, 0.4), (1.0, 1.0, 0.3), (40.0, 60.0, 0.45), (900.0, 1100.0, 0.46), (7.5, 2.5, 0.9)])
def test_beta_integral_and_quantile(spark, a, b, x):
    dens = lambda t: np.exp((a - 1) * np.log(np.maximum(t, 1e-300)) + (b - 1) * np.log(np.maximum(1 - t, 1e-300)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    want = integral(dens, 0, x)
    assert abs(value(spark, P.betainc(*lit(a, b, x))) - want) < 1e-7
    assert abs(value(spark, P.beta_ppf(*lit(want, a, b))) - x) < 1e-6


def test_normal_and_t(spark):
    for z in (-6.0, -1.5, 0.0, 0.7, 3.0):
        assert math.isclose(value(spark, P.norm_cdf(*lit(z))), 0.5 * math.erfc(-z / math.sqrt(2)), rel_tol=1e-10)
    assert abs(value(spark, P.norm_ppf(*lit(0.975))) - 1.959963984540054) < 1e-9
    assert abs(value(spark, P.t_two_sided_p(*lit(2.228138852, 10))) - 0.05) < 1e-8
    assert abs(value(spark, P.t_sf(*lit(-1.0, 1))) - 0.75) < 1e-10
    assert abs(value(spark, P.chi2_sf(F.lit(3.841458820694124), 1)) - 0.05) < 1e-10
    assert abs(value(spark, P.chi2_ppf(*lit(0.95, 24))) - 36.4150285) < 1e-6


def test_counts(spark):
    for mu in (0.3, 4.0, 170.0):
        pmf = [math.exp(k * math.log(mu) - mu - math.lgamma(k + 1)) for k in range(600)]
        cdf = np.cumsum(pmf)
        for p in (0.00135, 0.5, 0.99865):
            assert value(spark, P.poisson_ppf(*lit(p, mu))) == int(np.argmax(cdf >= p))
        assert abs(value(spark, P.poisson_cdf(*lit(3, mu))) - cdf[3]) < 1e-10 and abs(value(spark, P.poisson_pmf(*lit(3, mu))) - pmf[3]) < 1e-12
    r, q = 12.5, 0.3
    nb = np.cumsum([math.exp(math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(q) + k * math.log(1 - q)) for k in range(400)])
    assert abs(value(spark, P.nbinom_cdf(*lit(30, r, q))) - nb[30]) < 1e-9
    assert value(spark, P.nbinom_ppf(*lit(0.99, r, q))) == int(np.argmax(nb >= 0.99))


def test_arms_and_passages(spark):
    assert abs(value(spark, P.prob_b_beats_a(*lit(5, 5, 5, 5))) - 0.5) < 1e-9
    rng = np.random.default_rng(1)
    a, b = rng.beta(30, 70, 1_000_000), rng.beta(40, 60, 1_000_000)
    assert abs(value(spark, P.prob_b_beats_a(*lit(30, 70, 40, 60))) - (b > a).mean()) < 2e-3
    la, lb = P.expected_losses(*lit(30, 70, 40, 60))
    assert abs(value(spark, la) - np.maximum(b - a, 0).mean()) < 5e-4 and abs(value(spark, lb) - np.maximum(a - b, 0).mean()) < 5e-4
    assert abs(value(spark, P.ks_p_value(*lit(0.1358, 200, 200))) - 0.050) < 1e-3  # the published critical value 1.358 / sqrt(100)
    assert value(spark, P.ks_p_value(*lit(0.0, 5, 5))) == 1.0
    assert abs(value(spark, P.first_passage(*lit(0, 1, 1, 1))) - 2 * 0.5 * math.erfc(1 / math.sqrt(2))) < 1e-9
    assert value(spark, P.laplace_cdf(*lit(0, 2))) == 0.5 and value(spark, P.kl_bernoulli(*lit(0.3, 0.3))) == 0.0
