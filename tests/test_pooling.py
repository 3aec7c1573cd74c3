"""Partial pooling, bootstrap intervals and censored bounds against published answers and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.functions import pooling as H
from tallystream.functions import survival as V

#: Effects and standard errors of the eight schools.
SCHOOLS = [("A", 28.0, 15.0), ("B", 8.0, 10.0), ("C", -3.0, 16.0), ("D", 7.0, 11.0), ("E", -1.0, 9.0), ("F", 1.0, 11.0), ("G", 18.0, 10.0), ("H", 12.0, 18.0)]


def test_eight_schools(spark):
    got = {r.unit_ref: r for r in H.hierarchical_pool(spark.createDataFrame([*SCHOOLS, ("none", None, 1.0), ("flat", 1.0, 0.0)], "unit_ref string, effect double, se double")).collect()}
    assert set(got) == {s for s, _, _ in SCHOOLS}
    assert abs(got["A"].pooled - 11) < 2.5 and abs(got["C"].pooled - 6) < 3 and abs(got["G"].pooled - 10) < 2.5
    assert got["G"].pooled > got["B"].pooled and got["D"].pooled > got["F"].pooled and got["C"].pooled > got["E"].pooled
    a = got["A"]
    assert 0 <= a.tau_lower < 5 and 1 < a.tau < 12 and a.tau_upper > a.tau
    assert all(abs(r.pooling_factor - r.se**2 / (r.se**2 + r.tau**2)) < 1e-12 and r.lower < r.pooled < r.upper for r in got.values())
    assert H.hierarchical_pool(spark.createDataFrame([], "unit_ref string, effect double, se double")).collect() == []


def test_pool_equals_a_plain_grid(spark):
    rng = random.Random(2)
    rows = [(str(i), 1e4 + rng.gauss(0, 3), rng.uniform(0.5, 4)) for i in range(30)]
    y, s = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    top = max(4 * s.max(), 4 * y.std(ddof=1))
    taus = (np.arange(400) + 0.5) * top / 400
    logs, mus, vs = [], [], []
    for t in taus:
        p = 1 / (s**2 + t**2)
        v = 1 / p.sum()
        mu = v * (p @ y)
        logs.append(0.5 * math.log(v) + 0.5 * np.log(p).sum() - 0.5 * (p * (y - mu) ** 2).sum())
        mus.append(mu)
        vs.append(v)
    w = np.exp(np.array(logs) - max(logs))
    w /= w.sum()
    got = {r.unit_ref: r for r in H.hierarchical_pool(spark.createDataFrame(rows, "unit_ref string, effect double, se double")).collect()}
    for i, (ref, yi, si) in enumerate(rows):
        m = (yi * taus**2 + np.array(mus) * si**2) / (taus**2 + si**2)
        v = taus**2 * si**2 / (taus**2 + si**2) + (si**2 / (taus**2 + si**2)) ** 2 * np.array(vs)
        assert abs(got[ref].pooled - w @ m) < 1e-7 and abs(got[ref].sd - math.sqrt(w @ (v + m**2) - (w @ m) ** 2)) < 1e-3


def test_bca_covers_like_the_normal_interval_and_ignores_partitions(spark):
    rng = random.Random(5)
    xs = [rng.gauss(10, 2) for _ in range(600)]
    d = spark.createDataFrame(list(enumerate(xs)), "id long, x double")
    mean = lambda s, n: s / n
    sums = {"s": F.col("x"), "n": F.lit(1.0)}
    r = H.bootstrap_bca(d, ["id"], sums, mean).first()
    se = np.std(xs, ddof=1) / math.sqrt(len(xs))
    assert abs(r.estimate - np.mean(xs)) < 1e-9 and abs(r.lower - (np.mean(xs) - 1.96 * se)) < 0.4 * se and abs(r.upper - (np.mean(xs) + 1.96 * se)) < 0.4 * se and r.replicates == 400
    again = H.bootstrap_bca(d.repartition(7, "x"), ["id"], sums, mean).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(r, again, strict=True))


def test_bca_acceleration_is_that_of_leaving_one_out(spark):
    rng = random.Random(6)
    xs = [rng.expovariate(1) ** 2 for _ in range(200)]
    r = H.bootstrap_bca(spark.createDataFrame(list(enumerate(xs)), "id long, x double"), ["id"], {"s": F.col("x"), "n": F.lit(1.0)}, lambda s, n: s / n).first()
    jack = np.array([(sum(xs) - x) / 199 for x in xs])
    gap = jack.mean() - jack
    assert abs(r.acceleration - (gap**3).sum() / (6 * (gap**2).sum() ** 1.5)) < 1e-9 and r.acceleration > 0
    assert r.upper - r.estimate > r.estimate - r.lower  # a long tail to the right
    one = H.bootstrap_bca(spark.createDataFrame([(1, 2.0)], "id long, x double"), ["id"], {"s": F.col("x")}, lambda s: s).first()
    assert one.estimate is None and one.n == 1


def test_weighted_quantile_reduces_to_the_plain_one(spark):
    rng = random.Random(3)
    xs = [rng.gauss(0, 1) for _ in range(200)]
    q = V.weighted_conformal_quantile(spark.createDataFrame([(x, 1.0) for x in xs], "score double, weight double"), 0.1).first()
    assert q.q == sorted(xs)[math.ceil(201 * 0.9) - 1] and q.n == 200
    few = V.weighted_conformal_quantile(spark.createDataFrame([(1.0, 1.0)] * 8, "score double, weight double"), 0.1).first()
    assert few.q is None  # nine are needed
    heavy = V.weighted_conformal_quantile(spark.createDataFrame([(1.0, 8.0), (2.0, 1.0), (3.0, 1.0)], "score double, weight double"), 0.5).first()
    assert heavy.q == 2.0  # (8 + 1) / (10 + 8) = 0.5
    assert V.weighted_conformal_quantile(spark.createDataFrame([], "score double, weight double"), 0.1).first().q is None


def eta(rows, alpha=0.1):
    def km(rs, flip=False):
        out, s = [], 1.0
        for t in sorted({d for d, e, _ in rs if e != flip}):
            s *= 1 - sum(d == t and e != flip for d, e, _ in rs) / sum(d >= t for d, _, _ in rs)
            out.append((t, s))
        return out

    first = lambda curve, q: next((t for t, s in curve if s <= q), None)
    fit, rest = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    c0 = float(np.percentile([r[0] for r in fit], 60))
    censor = km(fit, True)
    at = lambda t: ([1.0] + [s for x, s in censor if x <= t])[-1]
    start = first(km(fit), 1 - alpha) or min(r[0] for r in fit)
    scored = sorted((start - min(d, c0), 1 / max(at(min(d, c0)), 1e-3)) for d, e, _ in rest if e or d >= c0)
    total, upto, q = sum(w for _, w in scored) + max(w for _, w in scored), 0.0, None
    for s, w in scored:
        upto += w
        if upto / total >= 1 - alpha - 1e-12:
            q = s
            break
    low = max(0.0, start - q) if q is not None else 0.0
    over = [d for d, e, _ in rest if e]
    return low, first(km(rows), 0.5) or max(r[0] for r in rows), first(km(rows), alpha) or max(r[0] for r in rows), c0, len(scored), at(c0), sum(d >= low for d in over) / len(over)


@pytest.mark.parametrize("seed,heavy", [(1, 0.02), (2, 0.05), (3, 0.001)])
def test_eta_bound_equals_plain_loops(spark, seed, heavy):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        t, c = 1 + int(rng.expovariate(0.05)), 1 + int(rng.expovariate(heavy))
        rows.append((min(t, c), t <= c, i % 2 == 0))
    r = V.survival_eta_bound(spark.createDataFrame(rows, "exit int, over_ boolean, train_ boolean"), "over_", "train_").first()
    want = eta(rows)
    assert np.allclose([r.lower_days, r.point_days, r.upper_days, r.horizon_days, r.calibration_n, r.support, r.coverage], want, atol=1e-9)
    assert r.lower_days <= r.point_days <= r.upper_days and r.blocked == (r.support <= 0.05 or r.coverage < 0.85)
