"""Ordinal responses: proportional-odds logistic models and Brant's test of their assumption.

Responses are counted by survey, covariates and level first.  A Newton step is one pass over these cells for all surveys at once; covariates^2 numbers a survey come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.sources.stages import Stages

Z = 1.959963984540054
#: A coefficient beyond this, in standard deviations of its covariate, means that the covariate separates the levels.
SEPARATED = 12.0

#: What a pass gives for one group: an array of sums.
_Give = Callable[[str, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _sums(cells: DataFrame, give: _Give, keys: list[str]) -> dict[str, np.ndarray]:
    """give(key, x, y, n) summed over the cells of each key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[str, np.ndarray] = {}
        for pdf in batches:
            for key, part in pdf[pdf.key.isin(keys)].groupby("key"):
                got = give(key, np.array(part.x.tolist(), float).reshape(len(part), -1), part.y.to_numpy(int), part.n.to_numpy(float))
                have[key] = have[key] + got if key in have else got
        yield pd.DataFrame([(k, i, float(v)) for k, a in have.items() for i, v in enumerate(a.ravel())], columns=["key", "i", "v"])

    rows = cells.select("key", "x", "y", "n").mapInPandas(run, "key string, i int, v double").groupBy("key", "i").agg(F.sum("v").alias("v")).collect()
    out: dict[str, dict[int, float]] = {}
    for r in rows:
        out.setdefault(r.key, {})[r.i] = r.v
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _expit(u: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(u, -500, 500)))


def _likelihood(phi: np.ndarray, levels: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log likelihood, gradient and observed information of P(Y <= j) = expit(theta_j - x beta), in one array; -inf if the cut points are out of order."""
    k, p = levels - 1, len(phi)
    theta, eta = phi[:k], x @ phi[k:]
    up, low = np.concatenate([theta, [np.inf]])[y] - eta, np.concatenate([[-np.inf], theta])[y] - eta
    a, b = np.where(y == k, 1.0, _expit(up)), np.where(y == 0, 0.0, _expit(low))
    prob = np.maximum(a - b, 1e-300)
    fa, fb = a * (1 - a), b * (1 - b)
    du, dv = np.zeros((len(y), p)), np.zeros((len(y), p))
    rows = np.arange(len(y))
    du[rows[y < k], y[y < k]] = 1.0
    dv[rows[y > 0], y[y > 0] - 1] = 1.0
    du[:, k:] = dv[:, k:] = -x
    gu, gv = fa / prob, -fb / prob
    huu, hvv, huv = fa * (1 - 2 * a) / prob - gu**2, -fb * (1 - 2 * b) / prob - gv**2, -gu * gv
    grad = (n * gu) @ du + (n * gv) @ dv
    cross = (du.T * (n * huv)) @ dv
    info = -((du.T * (n * huu)) @ du + (dv.T * (n * hvv)) @ dv + cross + cross.T)
    return np.concatenate([[n @ np.log(prob)], grad, info.ravel()])


def polr_fit(cells: DataFrame, levels: dict[str, int], covariates: int, *, steps: int = 60) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Per key the parameters (cut points, then slopes), their covariance and the log likelihood; cells has key, x (array), y (0 .. levels-1), n.

    A step that doesn't raise the likelihood, or puts cut points out of order, is halved.  A documented loop of at most `steps` passes.
    """
    start = _sums(cells, lambda key, x, y, n: np.bincount(y, n, levels[key]), list(levels))
    phi, state = {}, {}
    for key, count in start.items():
        share = np.clip(np.cumsum(count)[:-1] / count.sum(), 1e-6, 1 - 1e-6)
        share = np.maximum.accumulate(share + 1e-9 * np.arange(len(share)))
        phi[key] = np.concatenate([np.log(share / (1 - share)), np.zeros(covariates)])
    open_ = {k: (phi[k], 1.0) for k in phi}  # what is tried next
    for _ in range(steps):
        if not open_:
            break
        tried = {k: v[0] for k, v in open_.items()}
        got = _sums(cells, lambda key, x, y, n, tried=tried: _likelihood(tried[key], levels[key], x, y, n), list(tried))
        for key, sums in got.items():
            p = len(tried[key])
            ll, grad, info = sums[0], sums[1 : 1 + p], sums[1 + p :].reshape(p, p)
            before = state.get(key)
            if before is not None and not ll >= before[1] - 1e-9 * abs(before[1]):
                size = open_[key][1] / 2
            else:
                before = state[key] = (tried[key], ll, grad, info)
                size = 1.0
            base, _, grad, info = before
            step = np.linalg.pinv(info, hermitian=True) @ grad
            while (np.diff((base + size * step)[: levels[key] - 1]) <= 0).any():
                size /= 2
            if np.abs(step).max() < 1e-9 or size < 1e-6:
                open_.pop(key)
            else:
                open_[key] = (base + size * step, size)
    return {k: (v[0], np.linalg.pinv(v[3], hermitian=True), v[1]) for k, v in state.items()}


def _chi2_sf(x: float, df: int) -> float:
    """The upper tail of chi square: a finite sum for even df, with the normal tail for odd ones."""
    from math import erfc, exp, gamma, sqrt

    x = max(x, 0.0)
    half = x / 2
    if df % 2 == 0:
        return min(1.0, exp(-half) * sum(half**i / gamma(i + 1) for i in range(df // 2)))
    return min(1.0, erfc(sqrt(half)) + exp(-half) * sum(half ** (i + 0.5) / gamma(i + 1.5) for i in range((df - 1) // 2)))


def brant_test(cells: DataFrame, levels: dict[str, int], covariates: int) -> dict[str, tuple[float, int, float, list[float], np.ndarray]]:
    """Per key with three levels or more: Wald statistic, degrees of freedom and p-value of equal slopes at all cut points, p-values by covariate, slopes by cut point (of x in P(Y > j)).

    The binary models P(Y <= j) are fitted apart; the covariance of two of them follows from P(Y <= j) (1 - P(Y <= l)) for j <= l.
    """
    wide = {k: v for k, v in levels.items() if v > 2}
    cuts = {f"{k}\t{j}": 2 for k, v in wide.items() for j in range(v - 1)}
    if not cuts:
        return {}
    limits = F.create_map(*[x for k, v in wide.items() for x in (F.lit(k), F.lit(v))])
    split = cells.where(F.col("key").isin(list(wide))).withColumn("j", F.explode(F.sequence(F.lit(0), limits[F.col("key")] - 2)))
    binary = split.select(F.concat_ws("\t", "key", F.col("j").cast("string")).alias("key"), "x", (F.col("y") > F.col("j")).cast("int").alias("y"), "n")
    fits = polr_fit(binary, cuts, covariates)
    q = covariates + 1
    phis = {k: [fits[f"{k}\t{j}"][0] for j in range(v - 1)] for k, v in wide.items()}

    def give(key: str, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        d = np.concatenate([np.ones((len(x), 1)), -x], 1)
        pi = [_expit(d @ phi) for phi in phis[key]]
        return np.array([(d.T * (n * pi[j] * (1 - pi[i]))) @ d for j in range(len(pi)) for i in range(j, len(pi))])

    out = {}
    for key, sums in _sums(cells, give, list(wide)).items():
        k = wide[key] - 1
        blocks, at = {}, iter(sums.reshape(-1, q, q))
        for j in range(k):
            for i in range(j, k):
                blocks[j, i] = next(at)
        bread = [np.linalg.pinv(blocks[j, j], hermitian=True) for j in range(k)]
        cov = np.block([[(bread[j] @ blocks[min(i, j), max(i, j)] @ bread[i])[1:, 1:] for i in range(k)] for j in range(k)])
        slopes = np.array([phis[key][j][1:] for j in range(k)])
        p = covariates

        def wald(columns: list[int], slopes=slopes, cov=cov, k=k, p=p) -> tuple[float, int]:
            d = np.zeros(((k - 1) * len(columns), k * p))
            for r, (j, c) in enumerate((j, c) for j in range(1, k) for c in columns):
                d[r, c], d[r, j * p + c] = -1.0, 1.0
            gap = d @ slopes.ravel()
            return float(gap @ np.linalg.pinv(d @ cov @ d.T, hermitian=True) @ gap), len(d)

        stat, df = wald(list(range(p)))
        each = [_chi2_sf(*wald([c])) for c in range(p)]
        out[key] = (stat, df, _chi2_sf(stat, df), each, slopes)
    return out


def ordinal_logistic(responses: DataFrame, covariates: tuple[str, ...], *, by: str = "survey", level: str = "level", alpha: float = 0.05) -> DataFrame:
    """Proportional-odds models by survey: survey, kind, name, cut, coefficient, se, odds_ratio, lower, upper, p_value, brant_p, suppressed, n.

    Rows of kind 'covariate' have the slope of P(Y > j), one for all cut points; where Brant's test rejects that at alpha, or the covariate separates the levels, its numbers are null (suppressed), and rows of kind 'effect'
    give its slope at each cut point instead.  Rows of kind 'cutpoint' have the cut points.  Levels are those that occur, in order; a survey with fewer than two gives no rows.  Responses with a null level or covariate take no part.
    Surveys, and levels of a survey, are few: their numbers come to the driver.
    """
    s = Stages(responses.sparkSession)
    named = responses.select(F.col(by).cast("string").alias("key"), F.col(level).alias("level"), *[F.col(c).cast("double").alias(c) for c in covariates]).dropna()
    cells = s.step(named.groupBy("key", "level", *covariates).agg(F.count(F.lit(1)).alias("n")))
    found: dict[str, list] = {}
    for r in sorted(cells.select("key", "level").distinct().collect()):
        found.setdefault(r.key, []).append(r.level)
    found = {k: v for k, v in found.items() if len(v) > 1}
    schema = f"`{by}` string, kind string, name string, cut string, coefficient double, se double, odds_ratio double, lower double, upper double, p_value double, brant_p double, suppressed boolean, n long"
    if not found:
        return responses.sparkSession.createDataFrame([], schema)
    ranks = responses.sparkSession.createDataFrame([(k, str(v), i) for k, vs in found.items() for i, v in enumerate(vs)], "key string, name string, y int")
    # Centred and scaled within the survey, so that steps and limits mean the same for every covariate.
    w = cells.groupBy("key").agg(F.sum("n").alias("total"), *[x for i, c in enumerate(covariates) for x in ((F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(f"m{i}"), (F.sum(F.col(c) * F.col(c) * F.col("n")) / F.sum("n")).alias(f"q{i}"))])
    sd = lambda i: F.sqrt(F.greatest(F.col(f"q{i}") - F.col(f"m{i}") * F.col(f"m{i}"), F.lit(0.0)))
    scale = {r.key: r for r in w.select("key", "total", *[f"m{i}" for i in range(len(covariates))], *[F.when(sd(i) > 1e-12, sd(i)).otherwise(1.0).alias(f"s{i}") for i in range(len(covariates))]).collect()}
    table = responses.sparkSession.createDataFrame([(k, [float(r[f"m{i}"]) for i in range(len(covariates))], [float(r[f"s{i}"]) for i in range(len(covariates))]) for k, r in scale.items()], "key string, mid array<double>, sd array<double>")
    made = cells.withColumn("name", F.col("level").cast("string")).join(F.broadcast(ranks), ["key", "name"]).join(F.broadcast(table), "key")  # a row per survey and level, and per survey
    x = F.array(*[(F.col(c) - F.col("mid")[i]) / F.col("sd")[i] for i, c in enumerate(covariates)])
    made = s.step(made.select("key", x.alias("x"), "y", "n"))
    levels = {k: len(v) for k, v in found.items()}
    fits, tests = polr_fit(made, levels, len(covariates)), brant_test(made, levels, len(covariates))
    from math import erfc, exp, sqrt

    rows = []
    for key, (phi, cov, _) in fits.items():
        r, k = scale[key], levels[key] - 1
        mids, sds = np.array([r[f"m{i}"] for i in range(len(covariates))]), np.array([r[f"s{i}"] for i in range(len(covariates))])
        turn = np.zeros((k, len(phi)))  # cut points in the covariates' own units
        turn[:, :k], turn[:, k:] = np.eye(k), mids / sds
        for j in range(k):
            rows.append((key, "cutpoint", None, str(found[key][j]), float(turn[j] @ phi), float(sqrt(max(turn[j] @ cov @ turn[j], 0))), None, None, None, None, None, False, r.total))
        for i, c in enumerate(covariates):
            b, var = float(phi[k + i]), float(cov[k + i, k + i])
            brant = tests[key][3][i] if key in tests else None
            apart = abs(b) > SEPARATED or not var > 0
            if apart or (brant is not None and brant < alpha):
                rows.append((key, "covariate", c, None, *[None] * 6, brant, True, r.total))
                if not apart:
                    rows += [(key, "effect", c, str(found[key][j]), float(tests[key][4][j, i] / sds[i]), *[None] * 5, brant, False, r.total) for j in range(k)]
            else:
                b, se = b / sds[i], sqrt(var) / sds[i]
                rows.append((key, "covariate", c, None, b, se, exp(b), exp(b - Z * se), exp(b + Z * se), erfc(abs(b / se) / sqrt(2)), brant, False, r.total))
    s.close()
    return responses.sparkSession.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], schema)
