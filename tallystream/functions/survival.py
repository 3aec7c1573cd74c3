"""Survival services: product-limit curves with delayed entry, cumulative incidence, log-rank parts.

The risk set at t holds spells with entry < t <= exit (entry <= 0 at t = 0); spells that end before they enter are left out.  Counts are grouped by distinct time first, so the running sums go over
distinct times, not over spells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.functions.statistics import order_statistics, running_sums
from tallystream.sources.stages import Stages

Z = 1.959963984540054


def risk_table(spells: DataFrame, events: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """t, at_risk, leaving and one count per event (name: SQL condition) at every distinct exit time, per group of `by`."""
    spells = spells.where("exit > entry or entry <= 0")  # others are never at risk
    exits = spells.groupBy(*by, F.col("exit").alias("t")).agg(F.count(F.lit(1)).alias("leaving"), *[F.sum(F.expr(f"cast({c} as long)")).alias(k) for k, c in events.items()])
    entries = spells.groupBy(*by, F.col("entry").alias("t")).agg(F.count(F.lit(1)).alias("entering"))
    both = exits.unionByName(entries, allowMissingColumns=True).groupBy(*by, "t").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("leaving", "entering", *events)])
    before = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    at_zero = F.when(F.col("t") <= 0, F.col("entering")).otherwise(0)
    return both.withColumn("at_risk", so_far("entering") + at_zero - so_far("leaving")).where("leaving > 0").drop("entering")


def kaplan_meier(spells: DataFrame, event: str, by: tuple[str, ...] = ()) -> DataFrame:
    """t, at_risk, events, censored, survival, lower and upper at every event time; the band is survival * exp(+-z * sqrt(G)), clipped at 1."""
    t = risk_table(spells, {"events": event}, by).withColumn("censored", F.col("leaving") - F.col("events")).where("events > 0 and at_risk > 0")
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dead = F.max((F.col("events") >= F.col("at_risk")).cast("int")).over(w) == 1
    log_s = F.sum(F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).over(w)
    g = F.sum(F.when(F.col("events") < F.col("at_risk"), F.col("events") / (F.col("at_risk") * (F.col("at_risk") - F.col("events")))).otherwise(0.0)).over(w)
    s = F.when(dead, 0.0).otherwise(F.exp(log_s))
    out = t.withColumn("survival", s).withColumn("green", g)
    return out.select(
        *by, "t", "at_risk", "events", "censored", "survival", "green", (F.col("survival") * F.exp(-Z * F.sqrt("green"))).alias("lower"), F.least(F.lit(1.0), F.col("survival") * F.exp(Z * F.sqrt("green"))).alias("upper")
    )


def quantile_time(curve: DataFrame, q: float = 0.5) -> DataFrame:
    """The first time at which survival, and each side of its band, is at most q."""
    first = lambda c: F.min(F.when(F.col(c) <= q, F.col("t")))
    return curve.agg(first("survival").alias("median"), first("lower").alias("lower"), first("upper").alias("upper"))


def attainment(curve: DataFrame, horizon: float) -> DataFrame:
    """1 - survival at a horizon (right-continuous step), with its band; null beyond the last event time, where the curve says nothing."""
    last = lambda c: F.when(F.max("t") >= horizon, F.coalesce(F.max_by(c, F.when(F.col("t") <= horizon, F.col("t"))), F.lit(1.0)))
    return curve.agg((1 - last("survival")).alias("attained"), (1 - last("upper")).alias("lower"), (1 - last("lower")).alias("upper"))


def cumulative_incidence(spells: DataFrame, causes: tuple[str, ...], outcome: str = "outcome") -> DataFrame:
    """Aalen-Johansen incidence per cause and still_open, at every time with an event of any cause (long form)."""
    names = {f"d{i}": f"{outcome} = '{c}'" for i, c in enumerate(causes)}
    t = risk_table(spells, names)
    total = sum((F.col(k) for k in names), F.lit(0))
    t = t.withColumn("d", total).where("d > 0")
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.max((F.col("d") >= F.col("at_risk")).cast("int")).over(w)
    s = F.when(gone == 1, 0.0).otherwise(F.exp(F.sum(F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk"))).otherwise(0.0)).over(w)))
    t = t.withColumn("s", s).withColumn("before", F.coalesce(F.lag("s").over(Window.orderBy("t")), F.lit(1.0)))
    for i, _ in enumerate(causes):
        t = t.withColumn(f"f{i}", F.sum(F.col("before") * F.col(f"d{i}") / F.col("at_risk")).over(w))
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"f{i}").alias("incidence")) for i, c in enumerate(causes)]))
    return t.select("t", "at_risk", F.col("s").alias("still_open"), long.alias("x")).select("t", "at_risk", "x.cause", "x.incidence", "still_open")


def logrank_times(spells: DataFrame, group: str, levels: tuple[str, ...], event: str) -> DataFrame:
    """A row per event time and declared level of group: n at risk and d events in it, n_all and d_all in all."""
    times = risk_table(spells, {"d": event}).where("d > 0").select("t", F.col("d").alias("d_all"), F.col("at_risk").alias("n_all"))
    own = risk_table(spells, {"d": event}, (group,)).select(group, F.col("t").alias("t_own"), "d")
    # The group's risk set at every event time: entries before it less exits before it.
    spells = spells.where("exit > entry or entry <= 0")
    marks = spells.select(group, F.explode(F.array(F.struct(F.col("entry").alias("t"), F.lit(1).alias("step")), F.struct(F.col("exit").alias("t"), F.lit(-1).alias("step")))).alias("m")).groupBy(group, "m.t").agg(
        F.sum(F.when(F.col("m.step") > 0, 1).otherwise(0)).alias("enter"), F.sum(F.when(F.col("m.step") < 0, 1).otherwise(0)).alias("leave")
    )
    grid = times.withColumn(group, F.explode(F.array(*map(F.lit, levels))))  # a row per distinct event time and level
    points = grid.select(group, "t", "d_all", "n_all").unionByName(marks, allowMissingColumns=True).groupBy(group, "t").agg(*[F.max(c).alias(c) for c in ("d_all", "n_all", "enter", "leave")])
    before = Window.partitionBy(group).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("enter").over(before), F.lit(0)) + F.when(F.col("t") <= 0, F.coalesce("enter", F.lit(0))).otherwise(0) - F.coalesce(F.sum("leave").over(before), F.lit(0))
    return points.withColumn("n", n).where("d_all is not null").join(own.withColumnRenamed(group, "_own"), (F.col(group) == F.col("_own")) & (F.col("t") == F.col("t_own")), "left").withColumn("d", F.coalesce("d", F.lit(0)))


def logrank_parts(spells: DataFrame, group: str, levels: tuple[str, ...], event: str) -> DataFrame:
    """Observed, expected and variance of events per declared level of group (hypergeometric, ties allowed)."""
    at = logrank_times(spells, group, levels, event)
    share = F.col("n") / F.col("n_all")
    var = F.when(F.col("n_all") > 1, F.col("d_all") * (F.col("n_all") - F.col("d_all")) / (F.col("n_all") - 1) * share * (1 - share)).otherwise(0.0)
    return at.groupBy(group).agg(F.sum("d").alias("observed"), F.sum(F.col("d_all") * share).alias("expected"), F.sum(var).alias("variance"))


def mondrian_bounds(spells: DataFrame, by: str, event: str, alpha: float = 0.1) -> DataFrame:
    """A lower bound on the duration in each class that holds for 1 - alpha of its spells, and the time by which 1 - alpha are expected to be over.

    The class-conditional correction of any fitted lower quantile by its conformal score is an order statistic of the class's durations: of n
    durations the one of rank n + 1 - ceil((n + 1)(1 - alpha)), and 0 if there is none.  Durations are counted first.
    """
    c = spells.groupBy(by, "exit").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(by).orderBy("exit")  # a row per distinct duration
    c = c.withColumn("upto", F.sum("m").over(w)).withColumn("n", F.sum("m").over(Window.partitionBy(by)))
    rank = F.col("n") + 1 - F.ceil((F.col("n") + 1) * (1 - alpha))
    low = c.groupBy(by).agg(F.max("n").alias("n"), F.min(F.when((F.col("upto") >= rank) & (rank >= 1), F.col("exit"))).alias("low"), F.max("exit").alias("most"))
    up = kaplan_meier(spells, event, (by,)).groupBy(by).agg(F.min(F.when(F.col("survival") <= alpha, F.col("t"))).alias("up"))
    return low.join(up, by, "left").select(by, "n", F.coalesce("low", F.lit(0)).alias("lower_days"), F.coalesce("up", "most").alias("upper_days"))


def weighted_conformal_quantile(scores: DataFrame, alpha: float) -> DataFrame:
    """One row (q, n): the smallest score at which the weights of (score, weight) reach 1 - alpha of all, the new point's own (the largest weight) included; null if they never do.

    With equal weights it is the conformal quantile.  Weights are summed by distinct score first; sums run in buckets.
    """
    c = scores.where("score is not null").groupBy("score").agg(F.sum("weight").alias("w"))
    whole = scores.where("score is not null").agg((F.sum("weight") + F.max("weight")).alias("total"), F.count(F.lit(1)).alias("n"))
    run = running_sums(c, "score", (), {"upto": F.col("w")}).crossJoin(F.broadcast(whole))  # one row
    reached = F.min(F.when(F.col("upto") / F.col("total") >= 1 - alpha - 1e-12, F.col("score")))
    return run.agg(reached.alias("q"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def survival_eta_bound(spells: DataFrame, event: str, train: str, alpha: float = 0.1) -> DataFrame:
    """A lower bound on durations that 1 - alpha of new spells exceed, under censoring: one row.

    spells has exit (a duration); event and train are SQL conditions: what ends a spell, and which half fits the curves; the rest calibrates.  The bound is the time by which alpha of
    the training spells are over, corrected by the weighted conformal quantile of how far it lies beyond the calibration durations, cut at a horizon (the 60th percentile of training durations) that censoring
    still supports.  A spell censored before the horizon can't be scored (dropped counts them); others weigh the inverse of their chance of not being censored till then, at least 0.001.
    point_days and upper_days are the times by which half, and 1 - alpha, of all are over (the longest duration where the curve doesn't get there): they follow from the model, only the lower bound is guaranteed.
    blocked says that censoring leaves no support (0.05) at the horizon, or that the bound held for less than 1 - alpha - 0.05 of the calibration spells that ended: no number should be shown then.
    """
    st = Stages(spells.sparkSession)
    s = st.step(spells.select(F.col("exit").cast("double").alias("exit"), F.lit(0.0).alias("entry"), F.coalesce(F.expr(event), F.lit(False)).alias("over"), F.expr(train).alias("train")))
    fit, rest = s.where("train"), s.where("not train")
    horizon = order_statistics(fit.select(F.lit(0).alias("g"), F.col("exit").alias("x")), "g", (0.6,)).select(F.col("quantiles")[0].alias("horizon"))
    reach = lambda curve, q, name: curve.agg(F.min(F.when(F.col("survival") <= q, F.col("t"))).alias(name))
    start = reach(kaplan_meier(fit, "over"), 1 - alpha, "low").crossJoin(F.broadcast(fit.agg(F.min("exit").alias("least")))).select(F.coalesce("low", "least").alias("start"))  # one row each
    # The chance of not being censored by a time: the curve of censoring, a step function on distinct times.
    censor = kaplan_meier(fit, "not over").select("t", F.col("survival").alias("open"))
    cut = rest.crossJoin(F.broadcast(horizon)).crossJoin(F.broadcast(start))  # one row each
    scored = cut.withColumn("t", F.least("exit", "horizon")).withColumn("usable", F.col("over") | (F.col("exit") >= F.col("horizon")))
    times = scored.select("t").distinct().unionByName(horizon.select(F.col("horizon").alias("t"))).distinct()
    steps = times.withColumn("asked", F.lit(1)).unionByName(censor, allowMissingColumns=True).groupBy("t").agg(F.max("asked").alias("asked"), F.max("open").alias("open"))
    last = F.last("open", True).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # a row per distinct time
    chance = steps.withColumn("open", F.coalesce(last, F.lit(1.0))).where("asked = 1").select("t", "open")
    weighed = scored.where("usable").groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.max("start").alias("start")).join(chance, "t")
    scores = weighed.select((F.col("start") - F.col("t")).alias("score"), (F.col("n") / F.greatest("open", F.lit(1e-3))).alias("weight"), (1 / F.greatest("open", F.lit(1e-3))).alias("one"), "n")
    whole = scores.agg((F.sum("weight") + F.max("one")).alias("total"), F.sum("n").alias("calibration_n"))
    run = running_sums(scores.groupBy("score").agg(F.sum("weight").alias("w")), "score", (), {"upto": F.col("w")}).crossJoin(F.broadcast(whole))  # one row
    q = run.agg(F.min(F.when(F.col("upto") / F.col("total") >= 1 - alpha - 1e-12, F.col("score"))).alias("q"), F.max("calibration_n").alias("calibration_n"))
    every = kaplan_meier(s, "over")
    ends = reach(every, 0.5, "point").crossJoin(F.broadcast(reach(every, alpha, "up"))).crossJoin(F.broadcast(s.agg(F.max("exit").alias("most"))))  # one row each
    bound = q.crossJoin(F.broadcast(start)).crossJoin(F.broadcast(horizon)).select(F.greatest(F.lit(0.0), F.coalesce(F.col("start") - F.col("q"), F.lit(0.0))).alias("lower_days"), "calibration_n", F.col("horizon").alias("horizon_days"))
    held = rest.crossJoin(F.broadcast(bound)).agg(
        F.max("lower_days").alias("lower_days"), F.max("calibration_n").alias("calibration_n"), F.max("horizon_days").alias("horizon_days"),
        F.try_divide(F.count_if(F.col("over") & (F.col("exit") >= F.col("lower_days"))), F.count_if("over")).alias("coverage"), F.count_if(~F.col("over") & (F.col("exit") < F.col("horizon_days"))).alias("dropped"),
    )
    support = chance.join(F.broadcast(horizon), F.col("t") == F.col("horizon")).select(F.col("open").alias("support"))
    out = held.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(support))  # one row each
    out = st.step(out.select(
        "lower_days", F.coalesce("point", "most").alias("point_days"), F.coalesce("up", "most").alias("upper_days"), "horizon_days", "calibration_n", "dropped", "support", "coverage",
        ((F.col("support") <= 0.05) | (F.coalesce("coverage", F.lit(0.0)) < 1 - alpha - 0.05)).alias("blocked"),
    ))
    st.close(out)
    return out
