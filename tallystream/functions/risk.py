"""Risk scores: features as of each row's own day, penalised logistic models out of fold, calibration out of fold, and the gate that decides what is shown.

A model is a few sums over all rows: each Newton step is one pass for the models of all folds, and covariates^2 numbers a model come back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.functions.statistics import auc, brier_parts, score_bins, wilson
from tallystream.sources.stages import Stages

#: What the gate asks for: positive outcomes, outcomes a feature, and the calibration error that is too much.
POSITIVES, PER_FEATURE, ERROR = 40, 10, 0.05


def as_of(anchors: DataFrame, events: DataFrame, recent: int = 90) -> DataFrame:
    """anchors (member_ref, day, ...) with what was known of the member before that day from events (member_ref, day, weight): recency_days, frequency, volume, total, tenure_days.

    Events of the day itself and later ones count for nothing, so no feature can leak.  recency_days is the days since the last event, tenure_days those since the first (both null
    without one), frequency and volume the number and weight of events in the `recent` days before, total the number of all before.  Events are summed by member and day first, so a
    member's window has a row a day at most, however many events there are.
    """
    daily = events.groupBy("member_ref", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    asked = anchors.select("member_ref", "day").distinct().withColumn("asked", F.lit(True))
    both = daily.join(asked, ["member_ref", "day"], "full").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("w", F.coalesce("w", F.lit(0.0)))
    past = Window.partitionBy("member_ref").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy("member_ref").orderBy("day").rangeBetween(-recent, -1)
    active = F.when(F.col("n") > 0, F.col("day"))
    known = both.select(
        "member_ref", "day", "asked", (F.col("day") - F.max(active).over(past)).alias("recency_days"), F.coalesce(F.sum("n").over(near), F.lit(0)).alias("frequency"), F.coalesce(F.sum("w").over(near), F.lit(0.0)).alias("volume"),
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("total"), (F.col("day") - F.min(active).over(past)).alias("tenure_days"),
    ).where("asked").drop("asked")
    return anchors.join(known, ["member_ref", "day"])


def leaks(rows: DataFrame, feature_day: str, horizon_day: str) -> Column:
    """How many rows carry a feature that was known only after their horizon began."""
    return F.count_if(F.col(feature_day) > F.col(horizon_day))


def _passes(rows: DataFrame, k: int, models: dict[int, np.ndarray], label: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Gradient and information of each model at its coefficients; model m learns from the rows whose fold is not m."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = {m: np.zeros((k + 1, k)) for m in models}
        for pdf in batches:
            x, y, fold = np.array(pdf.x.tolist(), float).reshape(len(pdf), k), pdf.y.to_numpy(float), pdf.fold.to_numpy()
            for m, beta in models.items():
                mu = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
                use = fold != m
                have[m][0] += ((y - mu) * use) @ x
                have[m][1:] += (x.T * (np.maximum(mu * (1 - mu), 1e-9) * use)) @ x
        yield pd.DataFrame([(m, i, j, float(v)) for m, a in have.items() for (i, j), v in np.ndenumerate(a)], columns=["m", "i", "j", "v"])

    parts = rows.select("x", F.col(label).cast("double").alias("y"), "fold").mapInPandas(run, "m int, i int, j int, v double")
    out = {m: np.zeros((k + 1, k)) for m in models}
    for r in parts.groupBy("m", "i", "j").agg(F.sum("v").alias("v")).collect():  # models * covariates^2 rows
        out[r.m][r.i, r.j] = r.v
    return {m: (a[0], a[1:]) for m, a in out.items()}


def logistic(rows: DataFrame, k: int, *, folds: int = 0, penalty: float = 1.0, label: str = "label", steps: int = 50) -> dict[int, np.ndarray]:
    """Penalised logistic models of (x, label, fold) by Newton steps: model -1 of all rows, models 0 .. folds-1 of the rows outside their fold.

    x is an array of k numbers, the first being 1: the intercept, which is not penalised.  A documented loop of at most `steps` passes; nothing but sums comes to the driver.
    """
    models = {m: np.zeros(k) for m in (-1, *range(folds))}
    open_ = set(models)
    for _ in range(steps):
        if not open_:
            break
        for m, (grad, info) in _passes(rows, k, {m: models[m] for m in open_}, label).items():
            ridge = np.full(k, penalty)
            ridge[0] = 0.0
            step = np.linalg.solve(info + np.diag(ridge + 1e-10), grad - ridge * models[m])
            models[m] = models[m] + step
            if np.abs(step).max() < 1e-9:
                open_.discard(m)
    return models


def linear(models: dict[int, np.ndarray]) -> Column:
    """The linear score of a row by the model that has not seen its fold (models 0 ..; a row of another fold by model -1)."""

    def dot(beta: np.ndarray) -> Column:
        return F.aggregate(F.zip_with("x", F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)

    out = dot(models[-1])
    for m, beta in models.items():
        if m >= 0:
            out = F.when(F.col("fold") == m, dot(beta)).otherwise(out)
    return out


def out_of_fold(rows: DataFrame, features: tuple[str, ...], *, ref: str, label: str = "label", folds: int = 5, penalty: float = 1.0) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """rows with probability p, each from models and a calibration that have not seen the row, and the coefficients of the standardised features by fold.

    A row's fold follows from a hash of `ref`.  Null features count as their mean.  Scores are calibrated by a rising logistic map that is fitted on the scores of the other folds.
    """
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_samp(c).alias(f"s_{c}") for c in features]).first()
    scaled = [F.coalesce((F.col(c).cast("double") - (stats[f"m_{c}"] or 0.0)) / (s if (s := stats[f"s_{c}"]) and s > 1e-12 else 1.0), F.lit(0.0)) for c in features]
    made = rows.withColumn("x", F.array(F.lit(1.0), *scaled)).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), ref), F.lit(folds)).cast("int"))
    models = logistic(made, len(features) + 1, folds=folds, penalty=penalty, label=label)
    scored = made.withColumn("score", linear(models)).withColumn("x", F.array(F.lit(1.0), F.col("score"))).withColumn("fold", F.pmod(F.xxhash64(F.lit("calibration"), ref), F.lit(folds)).cast("int"))
    maps = logistic(scored, 2, folds=folds, penalty=1e-6, label=label)
    if any(b[1] < 0 for b in maps.values()):
        # Scores without information lie against the outcomes left out; a map that turned them round would find skill in that.
        flat = logistic(scored.withColumn("x", F.array(F.lit(1.0))), 1, folds=folds, label=label)
        maps = {m: b if b[1] >= 0 else np.array([flat[m][0], 0.0]) for m, b in maps.items()}
    return scored.withColumn("p", 1 / (1 + F.exp(-linear(maps)))).drop("x", "fold", "score"), models


def gate(scored: DataFrame, models: dict[int, np.ndarray], *, label: str = "label", bins: int = 10) -> DataFrame:
    """One row: n, positives, area under the curve, Brier skill, calibration error, sign flips of coefficients between folds, and whether probabilities may be shown."""
    s = scored.select("p", F.col(label).cast("int").alias("y"))
    parts = brier_parts(s, bins, "equal_count").select("brier", "uncertainty")
    error = score_bins(s, bins, "equal_count").agg(F.try_divide(F.sum(F.abs(F.col("mean_p") - F.col("observed")) * F.col("n")), F.sum("n")).alias("ece"))
    one = auc(s).crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(error))  # one row each
    signs = [np.sign(b[1:]) for m, b in models.items() if m >= 0]
    flips = int(sum(len(set(col) - {0.0}) > 1 for col in zip(*signs, strict=True))) if signs else 0
    skill = 1 - F.try_divide(F.col("brier"), F.col("uncertainty"))
    features = len(models[-1]) - 1
    return one.select(
        (F.col("positives") + F.col("negatives")).alias("n"), "positives", "auc", skill.alias("skill"), "ece", F.lit(flips).alias("sign_flips"),
        (F.col("positives") >= POSITIVES).alias("class_balance"), (F.col("positives") >= PER_FEATURE * features).alias("outcomes_per_feature"), F.coalesce((skill > 0) & (F.col("ece") < ERROR), F.lit(False)).alias("calibration_gate"),
    )


def stratum_rates(rows: DataFrame, stratum: str, label: str = "label", k: int = 5) -> DataFrame:
    """(stratum, rate, lower, upper, n): outcome rates with Wilson bounds; strata of fewer than k rows are pooled as 'other', a null one is 'unstated'."""
    named = rows.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("unstated")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    pooled = named.groupBy(F.when(F.col("n") < k, "other").otherwise(F.col("stratum")).alias("stratum")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return pooled.select("stratum", (F.col("hits") / F.col("n")).alias("rate"), lo.alias("lower"), hi.alias("upper"), "n")


def risk(rows: DataFrame, features: tuple[str, ...], *, ref: str, stratum: str, feature_day: str = "feature_day", horizon_day: str = "horizon_day", folds: int = 5, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Risk of an outcome and the checks it rests on: (ref or null, stratum, risk, lower, upper, n, shown) and one row of checks.

    Rows without a label are censored: they are scored by nobody and counted in the checks.  If no feature leaks, there are enough outcomes and the calibration gate holds, every row has its out-of-fold probability
    (shown: 'individual'); else only rates of strata are given (shown: 'stratum'), which say nothing about any single row.
    """
    s = Stages(rows.sparkSession)
    full = s.step(rows)
    known = full.where(F.col(label).isNotNull())
    whole = full.agg(leaks(full, feature_day, horizon_day).alias("leaks"), F.count_if(F.col(label).isNull()).alias("censored"), F.sum(F.col(label).cast("long")).alias("positives"), F.count(label).alias("n")).first()
    rates = stratum_rates(known, stratum, label).select(F.lit(None).cast(full.schema[ref].dataType).alias(ref), "stratum", F.col("rate").alias("risk"), "lower", "upper", "n", F.lit("stratum").alias("shown"))
    positives = whole.positives or 0
    checks: Callable[[DataFrame], DataFrame] = lambda g: g.select(F.lit(whole.leaks).alias("leaks"), F.lit(whole.censored).alias("censored"), "*")
    if whole.leaks or positives < POSITIVES or positives == whole.n:
        empty = rows.sparkSession.createDataFrame([(whole.n, positives, None, None, None, 0, positives >= POSITIVES, positives >= PER_FEATURE * len(features), False)], "n long, positives long, auc double, skill double, ece double, sign_flips int, class_balance boolean, outcomes_per_feature boolean, calibration_gate boolean")
        return rates, checks(empty)
    scored, models = out_of_fold(known, features, ref=ref, label=label, folds=folds)
    scored = s.step(scored.select(ref, F.col(stratum).cast("string").alias("stratum"), "p", label))
    found = s.step(gate(scored, models, label=label))
    if not found.first().calibration_gate:
        return rates, checks(found)
    none = F.lit(None).cast("double")
    return scored.select(ref, "stratum", F.col("p").alias("risk"), none.alias("lower"), none.alias("upper"), F.lit(1).cast("long").alias("n"), F.lit("individual").alias("shown")), checks(found)
