"""Risk: as-of features, penalised models, the gate, leaks."""

import math
import random

import numpy as np
import pytest

from tallystream.functions import risk as K
from tallystream.functions import statistics as S

ROW = "ref long, stratum string, a double, b double, label int, feature_day int, horizon_day int"


def outcomes(n=900, leak=False, effect=1.5, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(10, 5)
        p = 1 / (1 + math.exp(-(effect * a - 0.1 * effect * (b - 10) - 0.5)))
        out.append((i, rng.choice(["x", "y", None]), a, b, int(rng.random() < p), 20 if leak else 9, 10))
    return out


def test_features_know_nothing_of_the_day_or_later(spark):
    rng = random.Random(7)
    events = [(rng.randrange(6), rng.randrange(400), float(rng.randint(1, 5))) for _ in range(300)]
    anchors = [(i, rng.randrange(8), rng.randrange(420)) for i in range(80)]
    got = K.as_of(spark.createDataFrame(anchors, "ref long, member_ref long, day int"), spark.createDataFrame(events, "member_ref long, day int, weight double")).collect()
    assert len(got) == len(anchors)
    want = {i: (m, d) for i, m, d in anchors}
    for r in got:
        m, d = want[r.ref]
        before = [(day, w) for who, day, w in events if who == m and day < d]
        near = [w for day, w in before if day >= d - 90]
        assert (r.total, r.frequency, r.volume) == (len(before), len(near), sum(near))
        assert (r.recency_days, r.tenure_days) == ((d - max(x for x, _ in before), d - min(x for x, _ in before)) if before else (None, None))


def test_penalised_fit_equals_newton_by_hand(spark):
    rows = outcomes(400)
    x = np.array([[1.0, r[2], (r[3] - 10) / 5] for r in rows])
    y, fold = np.array([r[4] for r in rows], float), np.array([r[0] % 3 for r in rows])
    d = spark.createDataFrame([(list(map(float, v)), int(t), int(f)) for v, t, f in zip(x, y, fold, strict=True)], "x array<double>, label int, fold int")
    got = K.logistic(d, 3, folds=3, penalty=2.0)
    for m in (-1, 0, 1, 2):
        beta, use = np.zeros(3), fold != m
        for _ in range(60):
            mu = 1 / (1 + np.exp(-x[use] @ beta))
            ridge = np.diag([0.0, 2.0, 2.0])
            beta = beta + np.linalg.solve((x[use].T * (mu * (1 - mu))) @ x[use] + ridge, x[use].T @ (y[use] - mu) - ridge @ beta)
        assert np.allclose(got[m], beta, atol=1e-7)


def test_a_real_effect_is_shown_to_individuals(spark):
    rows = outcomes() + [(10_000 + i, "x", 0.0, 10.0, None, 9, 10) for i in range(5)]
    found, checks = K.risk(spark.createDataFrame(rows, ROW), ("a", "b"), ref="ref", stratum="stratum")
    c, got = checks.first(), {r.ref: r for r in found.collect()}
    assert c.calibration_gate and c.skill > 0.1 and c.ece < K.ERROR and c.auc > 0.75 and c.sign_flips == 0 and (c.leaks, c.censored, c.n) == (0, 5, 900)
    assert len(got) == 900 and all(r.shown == "individual" and 0 < r.risk < 1 for r in got.values())
    assert np.corrcoef([r[2] for r in rows[:900]], [got[r[0]].risk for r in rows[:900]])[0, 1] > 0.7


@pytest.mark.parametrize("rows", [outcomes(leak=True), outcomes(effect=0.0), outcomes(60)])
def test_leaks_noise_and_few_outcomes_show_strata_only(spark, rows):
    found, checks = K.risk(spark.createDataFrame(rows, ROW), ("a", "b"), ref="ref", stratum="stratum")
    got, c = found.collect(), checks.first()
    assert not c.calibration_gate and {r.shown for r in got} == {"stratum"} and all(r.ref is None for r in got)
    assert {r.stratum for r in got} == {"x", "y", "unstated"} and sum(r.n for r in got) == len(rows) and all(r.lower <= r.risk <= r.upper for r in got)
    assert c.leaks == (len(rows) if rows[0][5] == 20 else 0)


def test_thin_strata_are_pooled(spark):
    rows = [(i, "big", 0.0, 0.0, i % 2, 0, 1) for i in range(20)] + [(100 + i, f"thin{i}", 0.0, 0.0, 1, 0, 1) for i in range(4)]
    got = {r.stratum: (r.n, r.rate) for r in K.stratum_rates(spark.createDataFrame(rows, ROW), "stratum").collect()}
    assert got == {"big": (20, 0.5), "other": (4, 1.0)}


def test_equal_count_edges(spark):
    ps = [0.1, 0.2, 0.2, 0.2, 0.5, 0.7, 0.7, 0.9, 1.0, 0.0]
    d = spark.createDataFrame([(p, 1) for p in ps], "p double, y int")
    s = sorted(ps)
    want = [0.0]
    for e in [s[min(9, round(i * 10 / 4))] for i in range(1, 4)] + [1.0]:
        want += [e] if e > want[-1] + 1e-12 else []
    assert S.equal_count_edges(d, 4).first().edges == want[1:]
    assert sum(r.n for r in S.score_bins(d, 4, "equal_count").collect()) == 10
    with pytest.raises(ValueError):
        S.score_bins(d, 4, "other")
