"""Special functions as column expressions, evaluated in the JVM: gamma and beta integrals, tails of distributions and their quantiles.

Series and continued fractions are folds over a sequence whose length follows from the arguments, so they hold for large parameters, too.  Quantiles bisect.
They are meant for tables of groups, periods and arms; a quantile costs some ten thousand steps a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients of the gamma function for g = 7 (fixed values).
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _fold(steps: Column, start: Column, f) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), steps.cast("int"))), start, f)


def _down(steps: Column, f) -> Column:
    """A continued fraction from its last level to the first: r = f(r, k) for k = steps .. 1, from 0."""
    return F.aggregate(F.sequence(F.greatest(F.lit(1), steps.cast("int")), F.lit(1), F.lit(-1)), F.lit(0.0), f)


def lgamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0."""
    def at(x: Column) -> Column:
        a = F.lit(_LANCZOS[0]) + sum((c / (x + (i - 1)) for i, c in enumerate(_LANCZOS[1:], 1)), F.lit(0.0))
        return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(a)

    return _let(x.cast("double"), at)


def lbeta(a: Column, b: Column) -> Column:
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def gammainc_p(a: Column, x: Column) -> Column:
    """The regularised lower incomplete gamma integral: a series below a + 1, a continued fraction above."""
    def at(v: Column) -> Column:
        a, x = v.a, v.x
        steps = 60 + 12 * F.sqrt(F.greatest(a, x))
        series = _fold(steps, F.struct((1 / a).alias("t"), (1 / a).alias("s")), lambda s, n: F.struct((s.t * x / (a + n)).alias("t"), (s.s + s.t * x / (a + n)).alias("s"))).s
        rest = _down(steps, lambda r, k: k * (k - a) / (x + 2 * k + 1 - a - r))
        front = F.exp(a * F.log(x) - x - lgamma(a))
        return F.when(x <= 0, 0.0).when(x < a + 1, F.least(F.lit(1.0), front * series)).otherwise(F.greatest(F.lit(0.0), 1 - front / (x + 1 - a - rest)))

    return _let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), at)


def gammainc_q(a: Column, x: Column) -> Column:
    """The upper integral; far out its continued fraction is used as it is, so small tails keep their digits."""
    def at(v: Column) -> Column:
        a, x = v.a, v.x
        rest = _down(60 + 12 * F.sqrt(F.greatest(a, x)), lambda r, k: k * (k - a) / (x + 2 * k + 1 - a - r))
        return F.when(x >= a + 1, F.exp(a * F.log(x) - x - lgamma(a)) / (x + 1 - a - rest)).otherwise(1 - gammainc_p(a, x))

    return _let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), at)


def norm_cdf(z: Column) -> Column:
    return _let(z.cast("double"), lambda z: F.when(z >= 0, 1 - 0.5 * gammainc_q(F.lit(0.5), z * z / 2)).otherwise(0.5 * gammainc_q(F.lit(0.5), z * z / 2)))


def norm_sf(z: Column) -> Column:
    return norm_cdf(-z)


def chi2_sf(x: Column, df: Column | int) -> Column:
    df = F.lit(df) if isinstance(df, int) else df
    return gammainc_q(df / 2, F.greatest(x, F.lit(0.0)) / 2)


def betainc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta integral I_x(a, b)."""
    def at(v: Column) -> Column:
        swap = v.x > (v.a + 1) / (v.a + v.b + 2)
        return _let(F.struct(F.when(swap, v.b).otherwise(v.a).alias("a"), F.when(swap, v.a).otherwise(v.b).alias("b"), F.when(swap, 1 - v.x).otherwise(v.x).alias("x"), swap.alias("swap")), inner)

    def inner(v: Column) -> Column:
        a, b, x = v.a, v.b, v.x
        even = lambda m: m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = lambda m: -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        rest = _down(50 + 6 * F.sqrt(F.greatest(a, b)), lambda r, m: even(m) / (1 + odd(m) / (1 + r)))
        value = F.exp(a * F.log(x) + b * F.log(1 - x) - lbeta(a, b)) / a / (1 + odd(F.lit(0)) / (1 + rest))
        value = F.when(x <= 0, 0.0).otherwise(value)
        return F.when(v.swap, 1 - value).otherwise(value)

    return _let(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))).alias("x")), at)


def t_sf(t: Column, df: Column) -> Column:
    half = 0.5 * betainc(df / 2, F.lit(0.5), df / (df + t * t))
    return F.when(t >= 0, half).otherwise(1 - half)


def t_two_sided_p(t: Column, df: Column) -> Column:
    return betainc(df / 2, F.lit(0.5), df / (df + t * t))


def poisson_pmf(k: Column, mu: Column) -> Column:
    return F.when(k < 0, 0.0).otherwise(F.exp(k * F.log(mu) - mu - lgamma(k + 1)))


def poisson_cdf(k: Column, mu: Column) -> Column:
    return F.when(k < 0, 0.0).otherwise(gammainc_q(F.floor(k) + 1, mu))


def nbinom_cdf(k: Column, r: Column, p: Column) -> Column:
    """P(X <= k) of failures before the r-th success."""
    return F.when(k < 0, 0.0).otherwise(betainc(r, F.floor(k) + 1, p))


def _bisect(lo: Column, hi: Column, below, steps: int = 60) -> Column:
    """The point where below(x) turns false."""
    def step(s: Column, _: Column) -> Column:
        return _let((s.lo + s.hi) / 2, lambda mid: F.when(below(mid), F.struct(mid.alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), mid.alias("hi"))))

    return _let(_fold(F.lit(steps), F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi")), step), lambda s: (s.lo + s.hi) / 2)


def _first_count(hi: Column, reached) -> Column:
    """The smallest whole number at which reached(k) holds; it holds at hi."""
    def step(s: Column, _: Column) -> Column:
        return _let(F.floor((s.lo + s.hi) / 2).cast("double"), lambda mid: F.when(s.hi - s.lo <= 1, s).when(reached(mid), F.struct(s.lo.alias("lo"), mid.alias("hi"))).otherwise(F.struct(mid.alias("lo"), s.hi.alias("hi"))))

    return _fold(F.lit(48), F.struct(F.lit(-1.0).alias("lo"), F.ceil(hi).cast("double").alias("hi")), step).hi.cast("long")


def norm_ppf(p: Column) -> Column:
    return _bisect(F.lit(-40.0), F.lit(40.0), lambda z: norm_cdf(z) < p, 70)


def beta_ppf(p: Column, a: Column, b: Column) -> Column:
    return _bisect(F.lit(0.0), F.lit(1.0), lambda x: betainc(a, b, x) < p)


def gamma_ppf(p: Column, shape: Column, rate: Column) -> Column:
    return _bisect(F.lit(0.0), shape + 40 * F.sqrt(shape) + 100, lambda x: gammainc_p(shape, x) < p, 70) / rate


def chi2_ppf(p: Column, df: Column) -> Column:
    return 2 * gamma_ppf(p, df / 2, F.lit(1.0))


def poisson_ppf(p: Column, mu: Column) -> Column:
    return _first_count(mu + 40 * F.sqrt(mu) + 40, lambda k: poisson_cdf(k, mu) >= p)


def nbinom_ppf(p: Column, r: Column, prob: Column) -> Column:
    mean = r * (1 - prob) / prob
    return _first_count(mean + 40 * F.sqrt(mean / prob) + 40, lambda k: nbinom_cdf(k, r, prob) >= p)


def prob_b_beats_a(aa: Column, ba: Column, ab: Column, bb: Column) -> Column:
    """P(B > A) of independent betas with whole ab, as the finite sum over its ab terms."""
    def term(s: Column, i: Column) -> Column:
        i = i - 1
        return s + F.exp(lbeta(aa + i, ba + bb) - F.log(bb + i) - lbeta(i + F.lit(1.0), bb) - lbeta(aa, ba))

    return F.least(F.lit(1.0), _fold(ab, F.lit(0.0), term))


def expected_losses(aa: Column, ba: Column, ab: Column, bb: Column) -> tuple[Column, Column]:
    """What choosing A, and choosing B, is expected to lose against the better arm."""
    ma, mb = aa / (aa + ba), ab / (ab + bb)
    lose_a = mb * prob_b_beats_a(aa, ba, ab + 1, bb) - ma * prob_b_beats_a(aa + 1, ba, ab, bb)
    return F.greatest(F.lit(0.0), lose_a), F.greatest(F.lit(0.0), lose_a - (mb - ma))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sample p-value: Kolmogorov's series at d times the root of the effective size n * m / (n + m)."""
    lam = F.sqrt(n * m / (n + m)) * d
    terms = _fold(F.lit(100), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms)))


def kl_bernoulli(p: Column, q: Column) -> Column:
    inside = lambda x: F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), x))
    p, q = inside(p), inside(q)
    return p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q))


def first_passage(drift: Column, sigma: Column, distance: Column, horizon: Column) -> Column:
    """The chance that a Brownian balance falls by distance within the horizon (reflection principle)."""
    root = sigma * F.sqrt(horizon)
    p = norm_cdf((-distance - drift * horizon) / root) + F.exp(F.least(F.lit(700.0), -2 * drift * distance / (sigma * sigma))) * norm_cdf((-distance + drift * horizon) / root)
    return F.when((sigma <= 0) | (horizon <= 0) | (distance <= 0), 0.0).otherwise(F.least(F.lit(1.0), p))


def laplace_cdf(x: Column, scale: Column) -> Column:
    return F.when(x < 0, 0.5 * F.exp(x / scale)).otherwise(1 - 0.5 * F.exp(-x / scale))
