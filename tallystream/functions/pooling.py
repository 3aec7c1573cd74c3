"""Partial pooling of units and bootstrap intervals, both in sums that one pass gives."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.959963984540054


def tau_posterior(units: DataFrame, points: int = 400) -> DataFrame:
    """(tau, weight, mu, v_mu): the posterior of the spread between units on a grid, under a flat prior, with the mean and variance of their centre at each point.

    units has effect and se.  The centre is integrated out, so a point needs four sums over units: every unit adds to `points` groups before the shuffle.  The grid reaches four times the
    largest se or four times the spread of effects, whichever is more.  No units give no rows.
    """
    whole = units.agg(F.max("se").alias("most"), F.coalesce(F.stddev_samp("effect"), F.lit(0.0)).alias("spread"), F.avg("effect").alias("mid")).where("most is not null")
    step = F.greatest(4 * F.col("most"), 4 * F.col("spread"), F.lit(1e-6)) / points
    each = units.select("effect", "se").crossJoin(F.broadcast(whole.select("mid", step.alias("step")))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))  # one row
    tau = (F.col("i") + 0.5) * F.col("step")
    p, y = 1 / (F.col("se") * F.col("se") + tau * tau), F.col("effect") - F.col("mid")
    s = each.groupBy("i").agg(F.max(tau).alias("tau"), F.max("mid").alias("mid"), F.sum(p).alias("p"), F.sum(p * y).alias("py"), F.sum(p * y * y).alias("pyy"), F.sum(F.log(p)).alias("lp"))
    log = 0.5 * (-F.log("p") + F.col("lp") - (F.col("pyy") - F.col("py") * F.col("py") / F.col("p")))
    s = s.withColumn("log", log)
    grid = Window.partitionBy()  # `points` rows
    w = F.exp(F.col("log") - F.max("log").over(grid))
    return s.withColumn("w", w).select("tau", (F.col("w") / F.sum("w").over(grid)).alias("weight"), (F.col("mid") + F.col("py") / F.col("p")).alias("mu"), (1 / F.col("p")).alias("v_mu"))


def hierarchical_pool(units: DataFrame, points: int = 400) -> DataFrame:
    """units (unit_ref, effect, se) with their pooled means: unit_ref, effect, se, pooled, sd, lower, upper, pooling_factor, tau, tau_lower, tau_upper.

    pooled and sd are the exact moments of each unit's posterior over the grid of tau_posterior, without draws; lower and upper are pooled -+ 1.96 sd.  tau is the posterior mean, its bounds are the grid points
    at 2.5 and 97.5 %.  pooling_factor is se^2 / (se^2 + tau^2).  Units with a null effect, or without a positive se, take no part.
    """
    units = units.where("effect is not null and se > 0").select("unit_ref", F.col("effect").cast("double").alias("effect"), F.col("se").cast("double").alias("se"))
    grid = tau_posterior(units, points)
    upto = F.sum("weight").over(Window.orderBy("tau"))  # `points` rows
    run = grid.withColumn("upto", upto)
    line = run.agg(
        F.array_sort(F.collect_list(F.struct("tau", "weight", "mu", "v_mu"))).alias("grid"), F.sum(F.col("tau") * F.col("weight")).alias("tau"),
        F.min(F.when(F.col("upto") >= 0.025, F.col("tau"))).alias("tau_lower"), F.min(F.when(F.col("upto") >= 0.975, F.col("tau"))).alias("tau_upper"),
    )
    s2 = F.col("se") * F.col("se")
    total = lambda f: F.aggregate("grid", F.lit(0.0), lambda a, g: a + g["weight"] * f(g))
    share = lambda g: s2 / (s2 + g["tau"] * g["tau"])
    centre = lambda g: F.col("effect") + share(g) * (g["mu"] - F.col("effect"))
    r = units.crossJoin(F.broadcast(line)).withColumn("pooled", total(centre))  # one row
    var = total(lambda g: g["tau"] * g["tau"] * share(g) + share(g) * share(g) * g["v_mu"] + (centre(g) - F.col("pooled")) * (centre(g) - F.col("pooled")))
    r = r.withColumn("sd", F.sqrt(var))
    return r.select("unit_ref", "effect", "se", "pooled", "sd", (F.col("pooled") - Z * F.col("sd")).alias("lower"), (F.col("pooled") + Z * F.col("sd")).alias("upper"), (s2 / (s2 + F.col("tau") * F.col("tau"))).alias("pooling_factor"), "tau", "tau_lower", "tau_upper")


#: Poisson(1) by its distribution function: the shares of weights up to 0, 1, 2, ...
_POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]


def _weight(key: list[str], replicate: Column, seed: int) -> Column:
    """The Poisson(1) weight of a row in a replicate, from a hash of its key: the same wherever the row lies."""
    u = F.pmod(F.xxhash64(F.lit(seed), replicate, *key), F.lit(1 << 48)) / float(1 << 48)
    out = F.lit(len(_POISSON))
    for k in range(len(_POISSON) - 1, -1, -1):
        out = F.when(u < _POISSON[k], k).otherwise(out)
    return out


def bootstrap_bca(rows: DataFrame, key: list[str], sums: dict[str, Column], statistic: Callable[..., float], *, replicates: int = 400, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Bias-corrected accelerated interval of a statistic of sums: estimate, lower, upper, bias, acceleration, replicates, n.

    statistic takes the sums by name, as numbers or as columns.  All replicates come from one pass: a row counts in each as often as a Poisson(1) variable says that is hashed from its key (unique,
    or rows with one key count alike), so results do not depend on partitions.  The acceleration comes from leave-one-out sums, another pass.  Only a row per replicate reaches the driver.  Rows whose terms
    are null count as 0; fewer than two rows give no interval.  Where replicates lie all on one side of the estimate, the plain percentiles are given (bias is null then).
    """
    terms = rows.select(*key, *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"_{c}") for c, v in sums.items()])
    whole = terms.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_{c}").alias(c) for c in sums]).first()
    schema = "estimate double, lower double, upper double, bias double, acceleration double, replicates int, n long"
    if whole.n < 2:
        return rows.sparkSession.createDataFrame([(None, None, None, None, None, 0, whole.n)], schema)
    at = {c: float(whole[c]) for c in sums}
    estimate = float(statistic(**at))
    dealt = terms.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_w", _weight(key, F.col("_r"), seed)).where("_w > 0")
    drawn = dealt.groupBy("_r").agg(*[F.sum(F.col("_w") * F.col(f"_{c}")).alias(c) for c in sums]).collect()  # a row per replicate
    boots = []
    for r in drawn:
        try:
            boots.append(float(statistic(**{c: r[c] for c in sums})))
        except (ZeroDivisionError, ValueError):
            continue
    boots.sort()
    below = sum(b < estimate for b in boots) / max(1, len(boots))
    normal, bias, speed = NormalDist(), None, None
    low, high = alpha / 2, 1 - alpha / 2
    if 0 < below < 1:
        less = statistic(**{c: F.lit(at[c]) - F.col(f"_{c}") for c in sums}) - F.lit(estimate)
        m1, m2, m3 = terms.select(less.alias("d")).agg(F.avg("d"), F.avg(F.col("d") * F.col("d")), F.avg(F.col("d") * F.col("d") * F.col("d"))).first()
        square = (m2 or 0.0) - (m1 or 0.0) ** 2
        cube = (m3 or 0.0) - 3 * (m1 or 0.0) * (m2 or 0.0) + 2 * (m1 or 0.0) ** 3
        bias, speed = normal.inv_cdf(below), -cube / (6 * math.sqrt(whole.n) * square**1.5) if square > 0 else 0.0
        turned = [bias + z for z in (normal.inv_cdf(alpha / 2), normal.inv_cdf(1 - alpha / 2))]
        if all(1 - speed * t > 0 for t in turned):
            low, high = sorted(normal.cdf(bias + t / (1 - speed * t)) for t in turned)

    def quantile(q: float) -> float:
        place = q * (len(boots) - 1)
        i = min(int(place), len(boots) - 2)
        return boots[i] + (place - i) * (boots[i + 1] - boots[i])

    few = len(boots) < 20
    return rows.sparkSession.createDataFrame([(estimate, estimate if few else quantile(low), estimate if few else quantile(high), bias, speed, len(boots), whole.n)], schema)
