"""Tests, intervals, rankings and checks on tables of groups, periods and arms; their tails come from `special`.

Everything that grows with the data is an aggregate; what follows runs over its groups.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping
from statistics import NormalDist
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.functions import special as P
from tallystream.functions.statistics import beta_shrink, gamma_shrink, running_sums, wilson
from tallystream.functions.survival import logrank_parts, logrank_times
from tallystream.sources.stages import Stages


def _one(rows: DataFrame, row: DataFrame) -> DataFrame:
    """rows beside the only row of another table."""
    return rows.crossJoin(F.broadcast(row))


# --- The envelope -----------------------------------------------------------------------------------


def params_hash(method: str, version: int, params: Mapping[str, Any]) -> str:
    """Eight hex digits over how a number is computed: method, version and all parameters, in any order; never the data."""
    text = json.dumps({"method": method, "params": dict(params), "version": version}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:8]


def envelope(result: DataFrame, method: str, *, n: Column, least: int, params: Mapping[str, Any], values: tuple[str, ...], censored: Column | None = None, checks: Mapping[str, Column] | None = None, blocking: tuple[str, ...] = ()) -> DataFrame:
    """A result with what one must know to read it.

    n and n_censored count what it rests on; checks name conditions that must hold: each becomes PASS or FAIL (SKIPPED where it can't be told).  Below
    `least`, or where a blocking check fails, the values are null and insufficient_data or blocked says why.  params_hash tells computations apart.
    """
    checks = checks or {}
    status = {k: F.when(c, "PASS").when(~c, "FAIL").otherwise("SKIPPED") for k, c in checks.items()}
    few = F.coalesce(n, F.lit(0)) < least
    blocked = F.lit(False)
    for k in blocking:
        blocked = blocked | (status[k] == "FAIL")
    kept = [F.when(~few & ~blocked, F.col(c)).alias(c) if c in values else F.col(c) for c in result.columns]
    return result.select(
        *kept, F.lit(method).alias("method"), F.coalesce(n, F.lit(0)).cast("long").alias("n"), (censored if censored is not None else F.lit(0)).cast("long").alias("n_censored"),
        few.alias("insufficient_data"), blocked.alias("blocked"), *[s.alias(f"check_{k}") for k, s in status.items()], F.lit(params_hash(method, 1, params)).alias("params_hash"),
    )


# --- Survival, queues, charts -----------------------------------------------------------------------


def logrank_test(spells: DataFrame, group: str, levels: tuple[str, str], event: str) -> DataFrame:
    """The two-group log-rank statistic with its p-value (one degree of freedom)."""
    parts = logrank_parts(spells, group, levels, event)
    of = lambda c, i: F.max(F.when(F.col(group) == levels[i], F.col(c)))
    r = parts.agg(of("observed", 0).alias("observed_a"), of("expected", 0).alias("expected_a"), of("observed", 1).alias("observed_b"), of("expected", 1).alias("expected_b"), of("variance", 0).alias("variance"))
    chi2 = F.try_divide((F.col("observed_a") - F.col("expected_a")) ** 2, F.col("variance"))
    return r.withColumn("chi2", chi2).withColumn("p_value", P.chi2_sf(F.col("chi2"), 1))


def logrank_groups(spells: DataFrame, group: str, event: str, most: int = 64) -> DataFrame:
    """Log-rank test of any number of groups: one row with chi2, df, p_value, groups, n and events.

    Groups are those that occur (`most` at most, else an error; a null one is a group of its own).  Observed less expected events and their hypergeometric covariance are sums over event times, at
    each of which a row a group is joined with the others'; groups^2 numbers come back.  df is the rank of the covariance; fewer than two groups, or no events, give chi2 0 on 0 degrees and a null p_value.
    """
    s = spells.withColumn("_g", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))).withColumn("_e", F.coalesce(F.expr(event), F.lit(False)))
    sizes = sorted(s.where("exit > entry or entry <= 0").groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.count_if("_e").alias("d")).limit(most + 1).collect())
    if len(sizes) > most:
        raise ValueError(f"more than {most} groups")
    names = tuple(r["_g"] for r in sizes)
    k, total, events = len(names), sum(r.n for r in sizes), sum(r.d for r in sizes)
    chi2, df = 0.0, 0
    if k > 1 and events:
        st = Stages(spells.sparkSession)
        at = st.step(logrank_times(s, "_g", names, "_e").select("_g", "t", "d", "d_all", "n_all", (F.col("n") / F.col("n_all")).alias("share")))
        gap = {r["_g"]: r.u for r in at.groupBy("_g").agg(F.sum(F.col("d") - F.col("d_all") * F.col("share")).alias("u")).collect()}
        other = at.select(F.col("_g").alias("h"), "t", F.col("share").alias("share_h"))
        f = F.when(F.col("n_all") > 1, F.col("d_all") * (F.col("n_all") - F.col("d_all")) / (F.col("n_all") - 1)).otherwise(0.0)
        both = at.join(other, "t").groupBy("_g", "h").agg(F.sum(f * (F.when(F.col("_g") == F.col("h"), F.col("share")).otherwise(0.0) - F.col("share") * F.col("share_h"))).alias("v")).collect()
        st.close()
        place = {g: i for i, g in enumerate(names)}
        cov = np.zeros((k, k))
        for r in both:
            cov[place[r["_g"]], place[r.h]] = r.v
        u = np.array([gap.get(g, 0.0) for g in names])
        df = int(np.linalg.matrix_rank(cov, tol=1e-9 * max(1.0, np.abs(cov).max()), hermitian=True))
        chi2 = float(u @ np.linalg.pinv(cov, rcond=1e-9, hermitian=True) @ u)
    out = spells.sparkSession.createDataFrame([(chi2, df, k, total, events)], "chi2 double, df int, groups int, n long, events long")
    return out.withColumn("p_value", F.when(F.col("df") > 0, P.chi2_sf(F.col("chi2"), F.col("df"))))


def poisson_rate_chart(series: DataFrame, tail: float = 0.00135, most: float = 1.5) -> DataFrame:
    """A u-chart of (period_start, x, exposure): exact quantile limits for each period's exposure, negative binomial ones if the variance passes `most` times the mean."""
    whole = series.agg((F.sum("x") / F.sum("exposure")).alias("centre"), (F.var_samp("x") / F.avg("x")).alias("ratio"))
    expected = F.col("centre") * F.col("exposure")
    prob = F.least(F.lit(0.999), F.greatest(F.lit(1e-6), 1 / F.col("ratio")))
    wide = F.col("ratio") > most
    upper = F.when(wide, P.nbinom_ppf(F.lit(1 - tail), expected * prob / (1 - prob), prob)).otherwise(P.poisson_ppf(F.lit(1 - tail), expected))
    lower = F.when(wide, P.nbinom_ppf(F.lit(tail), expected * prob / (1 - prob), prob)).otherwise(F.greatest(F.lit(0), P.poisson_ppf(F.lit(tail), expected) - 1))
    r = _one(series, whole).select("period_start", "x", "exposure", "centre", (F.col("x") / F.col("exposure")).alias("rate"), (lower / F.col("exposure")).alias("lower"), (upper / F.col("exposure")).alias("upper"), wide.alias("overdispersed"))
    return r.withColumn("signal", (F.col("rate") > F.col("upper")) | (F.col("rate") < F.col("lower")))


def active_servers(events: DataFrame, fte: float, period: str = "month") -> DataFrame:
    """Distinct people who worked in each period (at, member_ref), and their full-time equivalents; a period without work has no row, hence no server."""
    return events.groupBy(F.to_date(F.date_trunc(period, "at")).alias("period_start")).agg(F.countDistinct("member_ref").alias("people")).withColumn("servers", F.col("people") * F.lit(fte))


# --- Rates and experiments --------------------------------------------------------------------------


#: Parameters from here on, the posterior is so narrow that its expansion around the normal law is exact to six digits and more.
NARROW = 1000


def _gamma_quantile(p: float, shape: Column, rate: Column) -> Column:
    z = NormalDist().inv_cdf(p)
    cube = 1 - 1 / (9 * shape) + z / (3 * F.sqrt(shape))  # the cube root of a gamma variable is close to normal
    return F.when(shape > NARROW, shape * cube * cube * cube / rate).otherwise(P.gamma_ppf(F.lit(p), shape, rate))


def _beta_quantile(p: float, a: Column, b: Column) -> Column:
    z, n = NormalDist().inv_cdf(p), a + b
    skew = 2 * (b - a) * F.sqrt(n + 1) / ((n + 2) * F.sqrt(a * b))
    near = a / n + F.sqrt(a * b / (n * n * (n + 1))) * (z + skew * (z * z - 1) / 6)
    return F.when(F.least(a, b) > NARROW, near).otherwise(P.beta_ppf(F.lit(p), a, b))


def beta_credible(rates: DataFrame, level: float = 0.95) -> DataFrame:
    """beta_shrink with the credible interval of each group's rate, and whether it leaves out the prior mean: group_ref, successes, trials, raw, shrunk, weight, lower, upper, differs."""
    s = beta_shrink(rates).withColumn("size", F.col("trials") / F.col("weight"))
    a, b, tail = F.col("shrunk") * F.col("size"), (1 - F.col("shrunk")) * F.col("size"), (1 - level) / 2
    s = s.withColumn("lower", _beta_quantile(tail, a, b)).withColumn("upper", _beta_quantile(1 - tail, a, b))
    prior = (a - F.col("successes")) / (F.col("size") - F.col("trials"))
    return s.withColumn("differs", (prior < F.col("lower")) | (prior > F.col("upper"))).drop("size")


def gamma_credible(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """gamma_shrink with the credible interval of each group's rate, and whether it leaves out the prior mean: group_ref, events, exposure_days, raw, shrunk, lower, upper, differs."""
    s, tail = gamma_shrink(counts, posterior=True), (1 - level) / 2
    s = s.withColumn("lower", _gamma_quantile(tail, F.col("shape"), F.col("rate"))).withColumn("upper", _gamma_quantile(1 - tail, F.col("shape"), F.col("rate")))
    prior = (F.col("shape") - F.col("events")) / (F.col("rate") - F.col("exposure_days"))
    return s.withColumn("differs", (prior < F.col("lower")) | (prior > F.col("upper"))).drop("shape", "rate")


def rank_by_lower_bound(rates: DataFrame, prior: tuple[float, float] = (1.0, 1.0), quantile: float = 0.05) -> DataFrame:
    """(group_ref, successes, trials) ranked by the lower quantile of their beta posteriors; neighbours whose intervals overlap by more than half the narrower one share a band."""
    a, b = F.col("successes") + F.lit(prior[0]), F.col("trials") - F.col("successes") + F.lit(prior[1])
    r = rates.select("group_ref", "successes", "trials", (a / (a + b)).alias("posterior_mean"), P.beta_ppf(F.lit(quantile), a, b).alias("lower_bound"), P.beta_ppf(F.lit(0.025), a, b).alias("lower"), P.beta_ppf(F.lit(0.975), a, b).alias("upper"))
    w = Window.orderBy(F.desc("lower_bound"), F.desc("posterior_mean"), "group_ref")  # a row per group
    r = r.withColumn("rank", F.row_number().over(w))
    overlap = F.least("upper", F.lag("upper").over(w)) - F.greatest("lower", F.lag("lower").over(w))
    apart = F.coalesce(F.try_divide(overlap, F.least(F.col("upper") - F.col("lower"), F.lag("upper").over(w) - F.lag("lower").over(w))) <= 0.5, F.lit(False))
    return r.withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(w).cast("int")).drop("apart")


def beta_ab_test(arms: DataFrame, prior: tuple[int, int] = (1, 1)) -> DataFrame:
    """P(B beats A), expected losses and posterior means of (arm 0 or 1, exposures, conversions), with a two-proportion p-value."""
    of = lambda c, i: F.max(F.when(F.col("arm") == i, F.col(c)))
    r = arms.agg(*[of(c, i).alias(f"{c[0]}{i}") for c in ("exposures", "conversions") for i in (0, 1)])
    aa, ba = F.col("c0") + float(prior[0]), F.col("e0") - F.col("c0") + float(prior[1])
    ab, bb = F.col("c1") + float(prior[0]), F.col("e1") - F.col("c1") + float(prior[1])
    pool = (F.col("c0") + F.col("c1")) / (F.col("e0") + F.col("e1"))
    z = (F.col("c1") / F.col("e1") - F.col("c0") / F.col("e0")) / F.sqrt(pool * (1 - pool) * (1 / F.col("e0") + 1 / F.col("e1")))
    la, lb = P.expected_losses(aa, ba, ab, bb)
    out = r.select(
        F.col("e0").alias("n_a"), F.col("e1").alias("n_b"), (aa / (aa + ba)).alias("posterior_a"), (ab / (ab + bb)).alias("posterior_b"), P.prob_b_beats_a(aa, ba, ab, bb).alias("p_b_beats_a"),
        la.alias("loss_a"), lb.alias("loss_b"), z.alias("z"),
    )
    return out.withColumn("p_value", 2 * P.norm_sf(F.abs("z")))


def mixture_boundary(target: int, variance: float, alpha: float) -> tuple[float, Column]:
    """The mixture's rho that makes the always-valid boundary tightest at `target`, and the boundary as a function of the column v."""
    c = u = 2 * math.log(1 / alpha)
    for _ in range(200):
        u = c + math.log1p(u)
    rho = max(1e-12, target * variance / u)
    return rho, F.sqrt((F.col("v") + rho) * F.log((F.col("v") + rho) / (rho * alpha * alpha)))


def arm_states(arms: DataFrame, horizon: int) -> DataFrame:
    """Mean of each arm, its divergence to the best, and its part of the least regret that any consistent policy has over a horizon."""
    r = _one(arms.withColumn("mean", F.col("conversions") / F.col("exposures")), arms.agg(F.max(F.col("conversions") / F.col("exposures")).alias("best")))
    kl = P.kl_bernoulli(F.col("mean"), F.col("best"))
    gap = F.when(F.col("mean") < F.col("best"), (F.col("best") - F.col("mean")) / kl).otherwise(0.0)
    return r.select("arm", "exposures", "conversions", "mean", kl.alias("divergence"), (gap * math.log(horizon)).alias("regret_bound"))


# --- Drift, ranks, calibration ----------------------------------------------------------------------


def holm(tests: DataFrame) -> DataFrame:
    """(feature, p_value) with Holm's adjusted p-values."""
    w = Window.orderBy("p_value", "feature")  # a row per test
    scaled = F.least(F.lit(1.0), F.col("p_value") * (F.count(F.lit(1)).over(Window.partitionBy()) - F.row_number().over(w) + 1))
    return tests.withColumn("scaled", scaled).withColumn("adjusted", F.max("scaled").over(w)).drop("scaled")


def mann_whitney(values: DataFrame) -> DataFrame:
    """U of side a against side b over (side, value), by counts per distinct value; normal p-value with the correction for ties."""
    c = values.groupBy("value").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    t = F.col("a") + F.col("b")
    r = running_sums(c, "value", (), {"upto": F.col("b")}).withColumn("below", F.col("upto") - F.col("b")).agg(F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)).alias("u"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum((t * t * t - t).cast("double")).alias("ties"))
    n = F.col("n_a") + F.col("n_b")
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1.0))))
    return r.withColumn("z", (F.col("u") - F.col("n_a") * F.col("n_b") / 2.0) / sd).select("u", "n_a", "n_b", "z", (2 * P.norm_sf(F.abs("z"))).alias("p_value"))


def representativeness(votes: DataFrame, k: int = 5) -> DataFrame:
    """(stratum, eligible, voted): turnout with its interval, each stratum's part of chi square against equal turnout, and its p-value; strata under k lose their figures."""
    whole = votes.agg((F.sum("voted") / F.sum("eligible")).alias("overall"), F.count(F.lit(1)).alias("strata"))
    expected = F.col("eligible") * F.col("overall")
    r = _one(votes, whole).withColumn("part", F.when(expected > 0, (F.col("voted") - expected) ** 2 / expected).otherwise(0.0)).withColumn("chi2", F.sum("part").over(Window.partitionBy()))  # a row per stratum
    lo, hi = wilson(F.col("voted"), F.col("eligible"))
    small = (F.col("voted") < k) | (F.col("eligible") < k)
    shown = lambda c, name: F.when(~small, c).alias(name)
    return r.select(
        "stratum", shown(F.col("eligible"), "eligible"), shown(F.col("voted"), "voted"), shown(F.col("voted") / F.col("eligible"), "turnout"), shown(lo, "lower"), shown(hi, "upper"), "chi2",
        P.chi2_sf(F.col("chi2"), F.col("strata") - 1).alias("p_value"), small.alias("suppressed"),
    )


def platt(scores: DataFrame, steps: int = 25) -> tuple[float, float]:
    """Slope and intercept of a logistic map from scores (p) to outcomes (y), by Newton steps.

    Each step is one aggregate over counts per distinct score, five numbers of which come back; targets are smoothed by one pseudo-case of each kind.
    """
    c = scores.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    hits, n = (float(x or 0) for x in c.agg(F.sum("hits"), F.sum("n")).first())
    high, low = (hits + 1) / (hits + 2), 1 / (n - hits + 2)
    aim = (F.col("hits") * high + (F.col("n") - F.col("hits")) * low).alias("aim")
    c = c.select("p", "n", aim).persist()
    slope = intercept = 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(slope * F.col("p") + intercept)))
        off, w = F.col("aim") - F.col("n") * q, F.col("n") * q * (1 - q)
        g1, g0, h11, h10, h00 = c.agg(F.sum(off * F.col("p")), F.sum(off), F.sum(w * F.col("p") * F.col("p")), F.sum(w * F.col("p")), F.sum(w)).first()
        det = h11 * h00 - h10 * h10
        if not det:
            break
        da, db = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        slope, intercept = slope + da, intercept + db
        if abs(da) + abs(db) < 1e-12:
            break
    c.unpersist()
    return slope, intercept


#: Tied deaths that are summed in one row; more are dealt over several.
TIES = 4096


def _efron(cells: DataFrame, k: int, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and information at beta: one row of sums comes back.

    cells has x0 .. x(k-1), entry, exit, n spells and d events.  Sums over risk sets enter at entry and leave at exit, in the order of distinct times.
    """
    xs = [f"x{i}" for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    risk = F.exp(sum((F.col(x) * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0)))
    names = ["s", *[f"s{i}" for i in range(k)], *[f"s{i}_{j}" for i, j in pairs]]
    moments = lambda n: [n * risk, *[n * risk * F.col(x) for x in xs], *[n * risk * F.col(xs[i]) * F.col(xs[j]) for i, j in pairs]]
    zero = F.lit(0.0)

    def ends(t: str, sign: float, dying: bool) -> Column:
        died = [m.alias(f"d{c}") for c, m in zip(names, moments(F.col("d")), strict=True)] if dying else [zero.alias(f"d{c}") for c in names]
        plain = [(F.col("d") * F.col(x) if dying else zero).alias(f"e{x}") for x in xs]
        return F.struct(F.col(t).cast("double").alias("t"), *[(m * sign).alias(c) for c, m in zip(names, moments(F.col("n")), strict=True)], *died, *plain, (F.col("d").cast("double") if dying else zero).alias("d"))

    summed = [*names, *[f"d{c}" for c in names], *[f"e{x}" for x in xs], "d"]
    moves = cells.select(F.explode(F.array(ends("entry", 1.0, False), ends("exit", -1.0, True))).alias("m")).select("m.*").groupBy("t").agg(*[F.sum(c).alias(c) for c in summed])
    # At a time, those who left before are gone and those who enter at it are not yet there (but at time zero they are).
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct time
    at_zero = cells.where("entry <= 0").agg(*[F.sum(m).alias(f"z{c}") for c, m in zip(names, moments(F.col("n")), strict=True)])
    late = moves.crossJoin(F.broadcast(at_zero))  # one row
    here = late.select(*[c for c in summed if c not in names], *[(F.coalesce(F.sum(c).over(before), zero) + F.when(F.col("t") <= 0, F.col(f"z{c}")).otherwise(0.0)).alias(c) for c in names]).where("d > 0")
    # Of d tied deaths the l-th leaves a risk set without l / d of them.
    last = (F.col("d") - 1).cast("long")
    dealt = here.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(TIES).cast("long"))))
    ls = F.sequence(F.col("first"), F.least(last, F.col("first") + TIES - 1))
    over = lambda f: F.aggregate(ls, F.lit(0.0), lambda acc, l: acc + f(l / F.col("d")))
    less = lambda c, q: F.col(c) - q * F.col(f"d{c}")
    own = F.col("first") == 0
    parts = [F.when(own, sum((F.col(f"e{x}") * float(b) for x, b in zip(xs, beta, strict=True)), F.lit(0.0))).otherwise(0.0) - over(lambda q: F.log(less("s", q)))]
    parts += [F.when(own, F.col(f"e{xs[i]}")).otherwise(0.0) - over(lambda q, i=f"s{i}": less(i, q) / less("s", q)) for i in range(k)]
    parts += [over(lambda q, i=i, j=j: less(f"s{i}_{j}", q) / less("s", q) - less(f"s{i}", q) * less(f"s{j}", q) / (less("s", q) * less("s", q))) for i, j in pairs]
    row = dealt.agg(*[F.sum(p) for p in parts]).first()
    info = np.zeros((k, k))
    for (i, j), h in zip(pairs, row[1 + k :], strict=True):
        info[i, j] = info[j, i] = h or 0.0
    return float(row[0] or 0.0), np.array([x or 0.0 for x in row[1 : 1 + k]]), info


def cox(spells: DataFrame, covariates: tuple[str, ...], event: str, steps: int = 25) -> DataFrame:
    """Cox hazard ratios with delayed entry and Efron's ties: covariate, coefficient, se, hazard_ratio, lower, upper, z, p_value, n, events, converged.

    Covariates are centred at their means, so that weights stay in range; a Newton step that doesn't raise the likelihood is halved.  The fit is a loop of at most `steps` jobs (and
    halvings), each of which brings back one row of covariates^2 numbers; spells are grouped by time and covariates first.  Spells with a null covariate take no part.  Without events
    coefficients are 0 and their errors null; so are errors of covariates that don't vary.
    """
    k = len(covariates)
    s = spells.where("exit > entry or entry <= 0").select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(covariates)], "entry", "exit", F.coalesce(F.expr(event), F.lit(False)).cast("int").alias("d")).dropna(subset=[f"x{i}" for i in range(k)])
    whole = s.agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)]).first()
    cells = s.select(*[(F.col(f"x{i}") - (whole[f"m{i}"] or 0.0)).alias(f"x{i}") for i in range(k)], "entry", "exit", "d")
    cells = cells.groupBy(*[f"x{i}" for i in range(k)], "entry", "exit").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d")).persist()
    beta, done = np.zeros(k), False
    ll, grad, info = _efron(cells, k, beta)
    for _ in range(steps if whole.d else 0):
        move = np.linalg.pinv(info, hermitian=True) @ grad
        if np.abs(move * np.sqrt(np.diag(info))).max() < 1e-8:  # in units of the standard error
            done = True
            break
        for _ in range(20):
            got = _efron(cells, k, beta + move)
            if np.isfinite(got[0]) and got[0] >= ll - 1e-10 * abs(ll):
                break
            move = move / 2
        beta, (ll, grad, info) = beta + move, got
    cells.unpersist()
    inverse = np.linalg.pinv(info, hermitian=True)
    rows = []
    for i, c in enumerate(covariates):
        se = math.sqrt(inverse[i, i]) if inverse[i, i] > 0 else None
        b, half = float(beta[i]), None if se is None else 1.959963984540054 * se
        rows.append((c, b, se, math.exp(b), *((None, None, None) if se is None else (math.exp(b - half), math.exp(b + half), b / se)), whole.n, whole.d or 0, done))
    out = spells.sparkSession.createDataFrame(rows, "covariate string, coefficient double, se double, hazard_ratio double, lower double, upper double, z double, n long, events long, converged boolean")
    return out.withColumn("p_value", 2 * P.norm_sf(F.abs("z")))


def schoenfeld(spells: DataFrame, covariates: tuple[str, ...], event: str, beta: tuple[float, ...]) -> DataFrame:
    """Whether hazards stay proportional: per covariate the correlation of its Schoenfeld residuals with time, weighted by events, and its p-value.

    A residual is the mean covariate of those who have the event at a time less its mean over the risk set there, weighted by their hazards.  The p-value takes events * correlation^2 as chi square.
    """
    k = len(covariates)
    xs = [f"x{i}" for i in range(k)]
    s = spells.where("exit > entry or entry <= 0").select(*[F.col(c).cast("double").alias(x) for c, x in zip(covariates, xs, strict=True)], "entry", "exit", F.coalesce(F.expr(event), F.lit(False)).cast("int").alias("d")).dropna(subset=xs)
    means = s.agg(*[F.avg(x) for x in xs]).first()
    risk = F.exp(sum(((F.col(x) - (m or 0.0)) * float(b) for x, m, b in zip(xs, means, beta, strict=True)), F.lit(0.0)))
    zero = F.lit(0.0)
    ends = lambda t, sign, dying: F.struct(F.col(t).cast("double").alias("t"), (risk * sign).alias("s"), *[(risk * F.col(x) * sign).alias(f"s{x}") for x in xs], *[(F.col("d") * F.col(x) if dying else zero).alias(f"e{x}") for x in xs], (F.col("d").cast("double") if dying else zero).alias("d"), ((risk if not dying else zero) * (F.col("entry") <= 0).cast("int")).alias("z"), *[((risk * F.col(x) if not dying else zero) * (F.col("entry") <= 0).cast("int")).alias(f"z{x}") for x in xs])
    names = ["s", *[f"s{x}" for x in xs]]
    moves = s.select(F.explode(F.array(ends("entry", 1.0, False), ends("exit", -1.0, True))).alias("m")).select("m.*").groupBy("t").agg(*[F.sum(c).alias(c) for c in (*names, *[f"e{x}" for x in xs], "d", "z", *[f"z{x}" for x in xs])])
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct time
    at = moves.select("t", "d", *[f"e{x}" for x in xs], *[(F.coalesce(F.sum(c).over(before), zero) + F.when(F.col("t") <= 0, F.col("z" + c[1:])).otherwise(0.0)).alias(c) for c in names]).where("d > 0")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), (F.col(f"e{x}") / F.col("d") - F.col(f"s{x}") / F.col("s")).alias("r")) for c, x in zip(covariates, xs, strict=True)])).alias("c")
    rows = at.select("t", "d", each).select("t", "d", "c.*")
    w = lambda c: F.sum(F.col("d") * c)
    m = rows.groupBy("covariate").agg(F.sum("d").alias("events"), w(F.col("t")).alias("t1"), w(F.col("r")).alias("r1"), w(F.col("t") * F.col("t")).alias("t2"), w(F.col("r") * F.col("r")).alias("r2"), w(F.col("t") * F.col("r")).alias("tr"))
    cov = F.col("tr") - F.col("t1") * F.col("r1") / F.col("events")
    var = (F.col("t2") - F.col("t1") * F.col("t1") / F.col("events")) * (F.col("r2") - F.col("r1") * F.col("r1") / F.col("events"))
    m = m.withColumn("correlation", F.when(var > 0, cov / F.sqrt(var)).otherwise(0.0))
    return m.select("covariate", "events", "correlation", P.chi2_sf(F.col("events") * F.col("correlation") * F.col("correlation"), 1).alias("p_value"))
