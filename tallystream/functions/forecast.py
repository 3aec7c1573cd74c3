"""Seasonal-trend decomposition of series, one kernel a series: a series has a row per period, which aggregates have made of the events before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallystream.functions.kernels import _keyed


def loess(y: np.ndarray, span: int, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Local lines through y at the positions `at`, over the `span` nearest whole-number positions with tricube weights; a span beyond the series widens the neighbourhood in proportion."""
    n = len(y)
    x = np.arange(n)
    far = np.abs(at[:, None] - x[None])
    reach = np.sort(far, axis=1)[:, min(span, n) - 1] * max(1.0, span / n)
    w = np.clip(1 - (far / np.maximum(reach, 0.5)[:, None]) ** 3, 0, None) ** 3
    if weights is not None:
        held = w * weights
        w = np.where(held.sum(1, keepdims=True) > 0, held, w)  # where all neighbours are outliers, they count again
    total = w.sum(1)
    mid, level = (w @ x) / total, (w @ y) / total
    spread = (w * (x[None] - mid[:, None]) ** 2).sum(1)
    slope = np.where(spread > 1e-9, (w * (x[None] - mid[:, None])) @ y / np.maximum(spread, 1e-9), 0.0)
    return level + slope * (at - mid)


def _means(y: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(y, np.full(width, 1 / width), "valid")


def _odd(k: float) -> int:
    k = int(np.ceil(k))
    return k if k % 2 else k + 1


def stl(y: np.ndarray, season: int, *, smoother: int = 7, robust: bool = True, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal part and robustness weights of a series of two seasons or more; what is left is the remainder, so the parts add up exactly.

    Each phase of the season is smoothed as a series of its own, a period beyond both ends; its low pass (means over the season twice and over three, then a local line) goes back to the trend.
    """
    n, smoother = len(y), max(7, _odd(smoother))
    low, long = _odd(season), max(3, _odd(1.5 * season / (1 - 1.5 / smoother)))
    here, trend, seasonal, weights = np.arange(n, dtype=float), np.zeros(n), np.zeros(n), np.ones(n)
    for outer in range(3 if robust else 1):
        for _ in range(inner):
            wide = np.zeros(n + 2 * season)
            for phase in range(season):
                own = (y - trend)[phase::season]
                wide[phase::season][: len(own) + 2] = loess(own, smoother, np.arange(-1.0, len(own) + 1), weights[phase::season])
            passed = loess(_means(_means(_means(wide, season), season), 3), low, here)
            seasonal = wide[season : season + n] - passed
            trend = loess(y - seasonal, long, here, weights)
        if robust and outer < 2:
            left = np.abs(y - trend - seasonal)
            limit = 6 * np.median(left)
            weights = np.clip(1 - (left / limit) ** 2, 0, None) ** 2 if limit > 0 else np.ones(n)
    return trend, seasonal, weights


def strength(part: np.ndarray, remainder: np.ndarray) -> float:
    """How much of part and remainder together is the part: from 0 (noise) to 1."""
    both = np.var(part + remainder)
    return float(max(0.0, 1 - np.var(remainder) / both)) if both > 0 else 0.0


def stl_decompose(series: DataFrame, by: str, *, season: int = 12, smoother: int = 7, robust: bool = True) -> DataFrame:
    """Each series (by, period_start date, x double) as trend + seasonal + remainder, with the weight of each period (0 for an outlier) and the strengths of season and trend.

    Periods count by their order, so missing ones must be filled before; a null x takes no part.  Below a seasonal strength of 0.3 the season is not material.  A series shorter than two seasons has null parts.
    """
    if season < 2:
        raise ValueError("a season has two periods or more")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x"]).sort_values("period_start").reset_index(drop=True)
        y = pdf.x.to_numpy(float)
        out = pdf[["period_start", "x"]].assign(trend=np.nan, seasonal=np.nan, remainder=np.nan, weight=np.nan, seasonal_strength=np.nan, trend_strength=np.nan)
        if len(y) >= 2 * season:
            trend, seasonal, weight = stl(y, season, smoother=smoother, robust=robust)
            left = y - trend - seasonal
            out = out.assign(trend=trend, seasonal=seasonal, remainder=left, weight=weight, seasonal_strength=strength(seasonal, left), trend_strength=strength(trend, left))
        return out.astype(object).where(out.notna(), None)

    return _keyed(series, by, kernel, "period_start date, x double, trend double, seasonal double, remainder double, weight double, seasonal_strength double, trend_strength double")
