"""Decomposition: exact sums, recovery of a known build, outliers, noise."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tallystream.functions import forecast as D


def build(n=120, m=12, noise=1.0, seed=21):
    rng = random.Random(seed)
    trend = np.array([20.0 + 0.35 * i for i in range(n)])
    season = np.array([8 * math.sin(2 * math.pi * i / m) + 3 * math.cos(4 * math.pi * i / m) for i in range(n)])
    return trend, season, trend + season + np.array([rng.gauss(0, noise) for _ in range(n)])


def test_local_lines_reproduce_lines_and_equal_plain_fits():
    x = np.arange(15.0)
    assert np.allclose(D.loess(2 + 3 * x, 5, np.array([-1.0, 0, 7.5, 15])), 2 + 3 * np.array([-1.0, 0, 7.5, 15]))
    y = np.array([random.Random(i).random() for i in range(15)])
    at = 4.0
    near = sorted(range(15), key=lambda i: abs(i - at))[:7]
    h = max(abs(i - at) for i in near)
    w = np.array([(1 - (abs(i - at) / h) ** 3) ** 3 for i in near])
    a = np.array([[1.0, i - at] for i in near])
    want = np.linalg.solve((a.T * w) @ a, (a.T * w) @ y[near])[0]
    assert abs(D.loess(y, 7, np.array([at]))[0] - want) < 1e-9


def test_known_components_are_recovered():
    trend, season, y = build()
    t, s, _ = D.stl(y, 12)
    assert np.sqrt(np.mean(((s - s.mean()) - (season - season.mean())) ** 2)) < 0.7 and np.sqrt(np.mean((t - trend) ** 2)) < 0.5


def test_an_outlier_bends_a_robust_fit_less():
    trend, _, y = build(noise=0.5)
    y[60] += 80
    robust, plain = (np.abs(D.stl(y, 12, robust=r)[0] - trend).max() for r in (True, False))
    assert robust < 0.5 * plain and D.stl(y, 12)[2][60] == 0


def test_series_side_by_side(spark):
    rng = random.Random(4)
    days = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(120)]
    _, _, y = build()
    rows = [("season", d, float(v)) for d, v in zip(days, y, strict=True)] + [("noise", d, 100 + rng.gauss(0, 5)) for d in days[:96]] + [("short", d, 1.0) for d in days[:20]] + [("flat", d, 7.0) for d in days[:30]] + [("flat", days[40], None)]
    rng.shuffle(rows)
    got = D.stl_decompose(spark.createDataFrame(rows, "series string, period_start date, x double"), "series").collect()
    of = {name: sorted((r for r in got if r.series == name), key=lambda r: r.period_start) for name in ("season", "noise", "short", "flat")}
    assert [len(of[k]) for k in of] == [120, 96, 20, 30]
    assert all(abs(r.x - r.trend - r.seasonal - r.remainder) < 1e-9 for k in ("season", "noise", "flat") for r in of[k])
    assert of["season"][0].seasonal_strength > 0.9 and of["season"][0].trend_strength > 0.9 and of["noise"][0].seasonal_strength < 0.5
    assert all(r.trend is None and r.seasonal_strength is None for r in of["short"]) and abs(of["flat"][5].trend - 7) < 1e-9
    t, s, w = D.stl(y, 12)
    assert np.allclose([r.trend for r in of["season"]], t) and np.allclose([r.weight for r in of["season"]], w)
    with pytest.raises(ValueError):
        D.stl_decompose(spark.createDataFrame(rows, "series string, period_start date, x double"), "series", season=1)
    assert D.stl_decompose(spark.createDataFrame([], "series string, period_start date, x double"), "series").collect() == []
