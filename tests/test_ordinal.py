"""Proportional odds: generated answers, a plain optimiser, Brant's test both ways."""

import math
import random

import numpy as np

from tallystream.functions import ordinal as O  # noqa: E741
from tallystream.functions.risk import logistic

THETA = [-1.0, 0.5, 1.8]
ANSWER = "survey string, level int, tenure double, owner double"


def answers(n, slopes, seed, name="s"):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = (rng.gauss(0, 1), float(rng.random() < 0.5))
        below = [1 / (1 + math.exp(-(t - sum(b * v for b, v in zip(bs, x, strict=True))))) for t, bs in zip(THETA, slopes, strict=True)]
        u = rng.random()
        out.append((name, 1 + sum(bool(u > b) for b in np.maximum.accumulate(below)), *x))
    return out


def test_effects_are_recovered_and_one_that_varies_is_withheld(spark):
    even = answers(1500, [(0.8, -0.5)] * 3, 7, "even")
    uneven = answers(2500, [(1.6, -0.5), (0.8, -0.5), (0.0, -0.5)], 11, "uneven")
    d = spark.createDataFrame([*even, *uneven, ("even", None, 1.0, 0.0), ("even", 2, None, 0.0), ("single", 1, 0.0, 1.0)], ANSWER)
    got = O.ordinal_logistic(d, ("tenure", "owner")).collect()
    cov = {(r.survey, r.name): r for r in got if r.kind == "covariate"}
    assert set(cov) == {(s, c) for s in ("even", "uneven") for c in ("tenure", "owner")}
    t = cov["even", "tenure"]
    assert abs(t.coefficient - 0.8) < 0.15 and t.lower < t.odds_ratio < t.upper and t.p_value < 1e-3 and t.brant_p > 0.05 and t.n == 1500
    assert abs(cov["even", "owner"].coefficient + 0.5) < 0.25
    cuts = [r.coefficient for r in got if r.kind == "cutpoint" and r.survey == "even"]
    assert len(cuts) == 3 and np.allclose(sorted(cuts), THETA, atol=0.25)
    v = cov["uneven", "tenure"]
    assert v.suppressed and v.coefficient is None and v.brant_p < 1e-3 and not cov["uneven", "owner"].suppressed
    effects = [r.coefficient for r in sorted((r for r in got if r.kind == "effect"), key=lambda r: r.cut)]
    assert len(effects) == 3 and effects[0] > effects[1] > effects[2] and abs(effects[0] - 1.6) < 0.4 and abs(effects[2]) < 0.4


def test_two_levels_are_a_logistic_regression_and_steps_meet_the_likelihood(spark):
    rows = [(s, min(y, 2), a, b) for s, y, a, b in answers(600, [(1.1, 0.3)] * 3, 3)]
    cells = spark.createDataFrame([("k", [a, b], y - 1, 1) for _, y, a, b in rows], "key string, x array<double>, y int, n long")
    phi, cov, ll = O.polr_fit(cells, {"k": 2}, 2)["k"]
    beta = logistic(spark.createDataFrame([([1.0, a, b], int(y == 1), 0) for _, y, a, b in rows], "x array<double>, label int, fold int"), 3, penalty=0.0)[-1]
    assert np.allclose([phi[0], -phi[1], -phi[2]], beta, atol=1e-6)
    # The gradient vanishes there, and the information is its derivative.
    x, y, n = np.array([r[2:] for r in rows]), np.array([r[1] - 1 for r in rows]), np.ones(len(rows))
    at = lambda p: O._likelihood(p, 2, x, y, n)
    assert np.abs(at(phi)[1:4]).max() < 1e-6 and abs(at(phi)[0] - ll) < 1e-6
    h = 1e-5
    slope = np.array([(at(phi + h * e)[1:4] - at(phi - h * e)[1:4]) / (2 * h) for e in np.eye(3)])
    assert np.allclose(-slope, np.linalg.inv(cov), rtol=1e-4)


def test_separation_is_withheld_and_nothing_gives_nothing(spark):
    rows = [(s, y, a, float(y == 4)) for s, y, a, _ in answers(400, [(0.5, 0.0)] * 3, 5)]
    got = {r.name: r for r in O.ordinal_logistic(spark.createDataFrame(rows, ANSWER), ("tenure", "owner")).collect() if r.kind == "covariate"}
    assert got["owner"].suppressed and got["owner"].coefficient is None
    assert O.ordinal_logistic(spark.createDataFrame([], ANSWER), ("tenure", "owner")).collect() == []


def test_chi_square_tails():
    assert abs(O._chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(O._chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9 and abs(O._chi2_sf(7.814727903251179, 3) - 0.05) < 1e-9
