"""More registered services, each with the SQL that it is held against; like `catalogue`, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.functions import budgeting as G
from tallystream.functions import forecast as D
from tallystream.functions import inference as I  # noqa: E741
from tallystream.functions import kernels as K
from tallystream.functions import networks as N
from tallystream.functions import ordinal as O  # noqa: E741
from tallystream.functions import pooling as H
from tallystream.functions import risk as Q
from tallystream.functions import special as P
from tallystream.functions import statistics as S
from tallystream.functions import survival as V
from tallystream.functions import topics as T
from tallystream.operators import periods as W
from tallystream.operators import reducers as R
from tallystream.operators import spells as L
from tallystream.plans.catalogue import (
    _ARMS, _BALLOTS, _FLOW, _LEDGER, _LIKERT, _MATRIX, _RATES, _SERIES, _SIDES, _SPELLS, _VERDICT, PRIORITIES, _arrivals, _count_observations, _flow, _matrix, _pairs, _responses, _spells, _trials, _two_years, query,
)
from tallystream.sources import streams as A


def _phi(z: str) -> str:
    """The normal integral as a series in SQL."""
    return (
        f"(0.5 + ({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), "
        f"lambda i_: exp(i_ * ln(greatest(({z}) * ({z}), 1e-300)) - (lgamma(2.0 * i_ + 2) - i_ * ln(2.0) - lgamma(i_ + 1.0))))))"
    )


def _chi2_even(x: str, df: int) -> str:
    """The upper tail of chi square for an even number of degrees of freedom, a finite sum."""
    return f"(exp(-({x}) / 2) * list_sum(list_transform(range(0, {df // 2}), lambda i_: exp(i_ * ln(greatest(({x}) / 2, 1e-300)) - lgamma(i_ + 1.0)))))"


# --- Survival -----------------------------------------------------------------------------------------


_KM_BY = _SPELLS + """,
ar AS (SELECT * FROM sp WHERE leave > entry OR entry <= 0), tt AS (SELECT DISTINCT category, leave AS t FROM ar WHERE outcome = 'resolved'),
nn AS (SELECT tt.category, t, count(*) FILTER (entry < t OR (t <= 0 AND entry <= 0)) AS at_risk, count(*) FILTER (leave = t AND outcome = 'resolved') AS events, count(*) FILTER (leave = t AND outcome <> 'resolved') AS censored
  FROM tt JOIN ar ON ar.category = tt.category AND leave >= t GROUP BY 1, 2),
km AS (SELECT *, product(1 - events / at_risk) OVER w AS survival FROM nn WHERE at_risk > 0 WINDOW w AS (PARTITION BY category ORDER BY t))"""


@query("survival_km_by_category", _KM_BY + " --select SELECT category, t, at_risk, events, censored, survival FROM km", "survival")
def _(spark, d):
    return V.kaplan_meier(_spells(spark, d), "outcome = 'resolved'", ("category",)).drop("green", "lower", "upper")


@query("survival_logrank_two_groups", _SPELLS + """,
ar AS (SELECT *, CASE WHEN category < '3' THEN 'fast' ELSE 'slow' END AS g FROM sp WHERE leave > entry OR entry <= 0), tt AS (SELECT DISTINCT leave AS t FROM ar WHERE outcome = 'resolved'),
nn AS (SELECT t, count(*) AS n, count(*) FILTER (g = 'fast') AS nj, count(*) FILTER (leave = t AND outcome = 'resolved') AS dd, count(*) FILTER (g = 'fast' AND leave = t AND outcome = 'resolved') AS dj
  FROM tt JOIN ar ON leave >= t AND (entry < t OR (t <= 0 AND entry <= 0)) GROUP BY t),
pp AS (SELECT sum(dj)::BIGINT AS observed_a, sum(dd * nj / n) AS expected_a, sum(dd - dj)::BIGINT AS observed_b, sum(dd * (n - nj) / n) AS expected_b, sum(CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1) * (nj / n) * (1 - nj / n) ELSE 0 END) AS variance FROM nn),
cc AS (SELECT *, (observed_a - expected_a) ^ 2 / variance AS chi2 FROM pp)
--select SELECT *, 2 * (1 - """ + _phi("sqrt(chi2)") + ") AS p_value FROM cc", "expected_a expected_b variance chi2 p_value")
def _(spark, d):
    s = _spells(spark, d).withColumn("g", F.when(F.col("category") < "3", "fast").otherwise("slow"))
    return I.logrank_test(s, "g", ("fast", "slow"), "outcome = 'resolved'")


@query("survival_logrank_compare", _SPELLS + """,
ar AS (SELECT *, CASE WHEN category < '2' THEN 'a' WHEN category < '4' THEN 'b' ELSE 'c' END AS g FROM sp WHERE leave > entry OR entry <= 0), tt AS (SELECT DISTINCT leave AS t FROM ar WHERE outcome = 'resolved'),
nn AS (SELECT t, count(*) AS n, count(*) FILTER (leave = t AND outcome = 'resolved') AS dd, count(*) FILTER (g = 'a') / count(*) AS sa, count(*) FILTER (g = 'b') / count(*) AS sb, count(*) FILTER (g = 'a' AND leave = t AND outcome = 'resolved') AS da, count(*) FILTER (g = 'b' AND leave = t AND outcome = 'resolved') AS db
  FROM tt JOIN ar ON leave >= t AND (entry < t OR (t <= 0 AND entry <= 0)) GROUP BY t),
ff AS (SELECT *, CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1) ELSE 0 END AS f FROM nn), uu AS (SELECT sum(da - dd * sa) AS ua, sum(db - dd * sb) AS ub, sum(f * sa * (1 - sa)) AS vaa, sum(f * sb * (1 - sb)) AS vbb, -sum(f * sa * sb) AS vab, sum(dd)::BIGINT AS events FROM ff),
cc AS (SELECT events, (ua * ua * vbb - 2 * ua * ub * vab + ub * ub * vaa) / (vaa * vbb - vab * vab) AS chi2 FROM uu)
--select SELECT chi2, 2 AS df, 3 AS groups, (SELECT count(*) FROM ar) AS n, events, exp(-chi2 / 2) AS p_value FROM cc""", "chi2 p_value")
def logrank_compare(spark, d):
    s = _spells(spark, d).withColumn("g", F.when(F.col("category") < "2", "a").when(F.col("category") < "4", "b").otherwise("c"))
    return I.logrank_groups(s, "g", "outcome = 'resolved'")


@query("survival_cox_hazard_ratios")
def cox_hazard_ratios(spark, d):
    s = _spells(spark, d).withColumn("priority", F.substring("category", 1, 1).cast("double")).withColumn("opened_year", (F.col("opened") / 365.25 - 26).cast("double"))
    return I.cox(s, ("priority", "opened_year"), "outcome = 'resolved'")


@query("survival_proportional_hazards")
def _(spark, d):
    s = _spells(spark, d).withColumn("priority", F.substring("category", 1, 1).cast("double")).withColumn("opened_year", (F.col("opened") / 365.25 - 26).cast("double"))
    x = ("priority", "opened_year")
    beta = {r.covariate: r.coefficient for r in I.cox(s, x, "outcome = 'resolved'").collect()}  # a row per covariate
    return I.schoenfeld(s, x, "outcome = 'resolved'", tuple(beta[c] for c in x))


_MEDIAN = {"window": "1996-2000", "event": "resolved", "quantile": 0.5}


@query("evidence_resolution_median", _KM_BY + f""",
c AS (SELECT category, count(*) FILTER (outcome = 'resolved') AS n, count(*) FILTER (outcome <> 'resolved') AS cens, count(*) FILTER (outcome IN ('escalated', 'withdrawn')) AS comp FROM sp GROUP BY 1),
m AS (SELECT category, min(t) FILTER (survival <= 0.5) AS median FROM km GROUP BY 1), e AS (SELECT category, CASE WHEN comp / (n + cens) <= 0.1 THEN 'PASS' ELSE 'FAIL' END AS k, median, n, cens FROM c LEFT JOIN m USING (category))
--select SELECT category, CASE WHEN n >= 30 AND k = 'PASS' THEN median END AS median, 'survival.median_resolution_days' AS method, n, cens AS n_censored, n < 30 AS insufficient_data, k = 'FAIL' AS blocked, k AS check_few_competing,
  left(sha256('{{"method":"survival.median_resolution_days","params":{{"event":"resolved","quantile":0.5,"window":"1996-2000"}},"version":1}}'), 8) AS params_hash FROM e""")
def _(spark, d):
    s = _spells(spark, d)
    km = V.kaplan_meier(s, "outcome = 'resolved'", ("category",)).groupBy("category").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))
    n = s.groupBy("category").agg(F.count_if(F.col("outcome") == "resolved").alias("_n"), F.count_if(F.col("outcome") != "resolved").alias("_c"), F.count_if(F.col("outcome").isin("escalated", "withdrawn")).alias("_k"))
    r = n.join(km, "category", "left")
    out = I.envelope(
        r, "survival.median_resolution_days", n=F.col("_n"), least=30, params=_MEDIAN, values=("median",), censored=F.col("_c"), checks={"few_competing": F.col("_k") / (F.col("_n") + F.col("_c")) <= 0.1}, blocking=("few_competing",)
    )
    return out.drop("_n", "_c", "_k")


@query("conformal_mondrian_eta", _KM_BY + """,
o AS (SELECT category, leave, row_number() OVER (PARTITION BY category ORDER BY leave) AS i, count(*) OVER (PARTITION BY category) AS n FROM sp),
l AS (SELECT category, max(n) AS n, max(leave) FILTER (i = n + 1 - ceil((n + 1) * 0.9)) AS lower_days, max(leave) AS most FROM o GROUP BY 1), u AS (SELECT category, min(t) FILTER (survival <= 0.1) AS t FROM km GROUP BY 1)
--select SELECT category, n, coalesce(lower_days, 0) AS lower_days, coalesce(t, most) AS upper_days FROM l LEFT JOIN u USING (category)""")
def _(spark, d):
    s = _spells(spark, d)
    return V.mondrian_bounds(s, "category", "outcome = 'resolved'", 0.1)


# --- Periods and queues -------------------------------------------------------------------------------


_MONTHS = _FLOW + ", x AS (SELECT period_start, arrivals::DOUBLE AS x, date_diff('day', period_start, (period_start + INTERVAL 1 MONTH)::DATE)::DOUBLE AS exposure FROM flow)"


def _exposed(spark, d):
    return _flow(spark, d).select("period_start", F.col("arrivals").cast("double").alias("x"), F.date_diff(F.add_months("period_start", 1), "period_start").cast("double").alias("exposure"))


@query("spc_poisson_rate_chart", _MONTHS + """, w AS (SELECT sum(x) / sum(exposure) AS centre, var_samp(x) / avg(x) AS ratio FROM x), e AS (SELECT DISTINCT exposure, centre, ratio, centre * exposure AS mu FROM x, w),
k AS (SELECT exposure, mu, ratio, i, CASE WHEN ratio > 1.5 THEN exp(lgamma(i + mu / (ratio - 1)) - lgamma(mu / (ratio - 1)) - lgamma(i + 1.0) + mu / (ratio - 1) * ln(1 / ratio) + i * ln(1 - 1 / ratio)) ELSE exp(i * ln(mu) - mu - lgamma(i + 1.0)) END AS pmf FROM e, range(0, 5000) AS r(i)),
c AS (SELECT *, sum(pmf) OVER (PARTITION BY exposure ORDER BY i) AS cdf FROM k), q AS (SELECT exposure, min(i) FILTER (cdf >= 0.99865) AS hi, CASE WHEN max(ratio) > 1.5 THEN min(i) FILTER (cdf >= 0.00135) ELSE greatest(0, min(i) FILTER (cdf >= 0.00135) - 1) END AS lo FROM c GROUP BY exposure)
--select SELECT period_start, x, exposure, centre, x / exposure AS rate, lo / exposure AS lower, hi / exposure AS upper, ratio > 1.5 AS overdispersed, x / exposure > hi / exposure OR x / exposure < lo / exposure AS signal FROM x JOIN q USING (exposure), w""", "x centre rate lower upper")
def _(spark, d):
    return I.poisson_rate_chart(_exposed(spark, d))


@query("series_autocorrelation", _SERIES + f""", c AS (SELECT i, x - mean AS u, n FROM x, b), d AS (SELECT sum(u * u) AS d, max(n) AS n FROM c), r AS (SELECT k::INT AS lag, sum(a.u * b.u) / max(d) AS rho, max(d.n) AS n FROM range(1, 9) AS g(k), c a JOIN c b ON TRUE, d WHERE b.i = a.i - k GROUP BY k),
q AS (SELECT *, n * (n + 2) * sum(rho * rho / (n - lag)) OVER () AS ljung_box FROM r) --select SELECT lag, rho, ljung_box, {_chi2_even('ljung_box', 8)} AS p_value FROM q""", "rho ljung_box p_value")
def _(spark, d):
    r = S.autocorrelations(_arrivals(spark, d), 8)
    return r.withColumn("p_value", P.chi2_sf(F.col("ljung_box"), 8))


@query("series_trend", _SERIES + " --select SELECT regr_slope(x, i) AS slope, corr(x, i) AS correlation, count(*) AS n FROM x", "slope correlation")
def _(spark, d):
    x = _arrivals(spark, d).withColumn("i", F.row_number().over(Window.orderBy("period_start")))  # a row per period
    return x.agg(F.regr_slope("x", "i").alias("slope"), F.corr("x", "i").alias("correlation"), F.count(F.lit(1)).alias("n"))


@query("capacity_active_servers_by_period", _SPELLS + """, w AS (SELECT assignee_ref AS m, DATE '1970-01-01' + opened::INT AS dt FROM sp UNION ALL SELECT assignee_ref, DATE '1970-01-01' + (opened + leave)::INT FROM sp WHERE outcome <> 'open')
--select SELECT date_trunc('month', dt)::DATE AS period_start, count(DISTINCT m) AS people, count(DISTINCT m) * 0.2::DOUBLE AS servers FROM w GROUP BY 1""", "servers")
def _(spark, d):
    s = _spells(spark, d)
    day = lambda c: F.date_from_unix_date(c.cast("int")).alias("at")
    work = s.select(F.col("assignee_ref").alias("member_ref"), day(F.col("opened"))).unionByName(s.where("outcome <> 'open'").select(F.col("assignee_ref").alias("member_ref"), day(F.col("opened") + F.col("exit"))))
    return I.active_servers(work, 0.2)


@query("queueing_mmc_metrics", _SPELLS + """, f AS (SELECT count(*) / 1461.0::DOUBLE AS rate, avg(leave) FILTER (outcome <> 'open') AS service FROM sp WHERE opened >= DATE '1996-01-01' - DATE '1970-01-01'), a AS (SELECT *, rate * service AS load, floor(rate * service)::INT + 2 AS c FROM f),
b AS (SELECT 0 AS i, 1.0::DOUBLE AS b, load, c, rate, service FROM a UNION ALL SELECT i + 1, load * b / (i + 1 + load * b), load, c, rate, service FROM b WHERE i < c), l AS (SELECT *, b / (1 - load / c * (1 - b)) AS p FROM b WHERE i = c)
--select SELECT c AS servers, load, load / c AS utilisation, p AS p_wait, p * service / (c - load) AS wait_days, rate * p * service / (c - load) AS queue FROM l""", "load utilisation p_wait wait_days queue")
def _(spark, d):
    s = _spells(spark, d).where(F.col("opened") >= F.unix_date(F.lit("1996-01-01").cast("date")))
    f = s.agg((F.count(F.lit(1)) / 1461.0).alias("rate"), F.avg(F.when(F.col("outcome") != "open", F.col("exit"))).alias("service"))
    return K.mmc(f, spare=2)


@query("forecast_rolling_backtest", _SERIES + """, s AS (SELECT x.i, abs(x.x - y.x) AS e FROM x JOIN x y ON y.i = x.i - 12), o AS (SELECT n - g AS origin FROM b, range(3, 15) AS r(g)),
f AS (SELECT o.origin, h::INT AS h, a.x AS actual, p.x AS point, (SELECT avg(e) FROM s WHERE s.i <= o.origin) AS scale FROM o, range(1, 4) AS r(h), x a, x p WHERE a.i = origin + h AND p.i = origin + h - 12)
--select SELECT h, count(*) AS origins, avg(abs(actual - point) / scale) AS mase, 100 * avg(CASE WHEN actual + point = 0 THEN 0 ELSE abs(actual - point) / ((abs(actual) + abs(point)) / 2) END) AS smape, sqrt(avg((actual - point) ^ 2)) AS rmse FROM f GROUP BY h""", "mase smape rmse")
def _(spark, d):
    return S.seasonal_backtest(_arrivals(spark, d), 12, origins=12, horizon=3)


_NET = _LEDGER + ", p AS (SELECT date_trunc('month', dt)::DATE AS m, sum(CASE WHEN st = 'F' THEN amount ELSE 0 END) / 100.0 AS net FROM e GROUP BY 1), g AS (SELECT avg(net)::DOUBLE - 900000 AS drift, stddev_samp(net) AS sigma FROM p), h AS (SELECT *, 5000000.0::DOUBLE AS dist, 12.0::DOUBLE AS hz, sigma * sqrt(12.0) AS root FROM g)"


@query("montecarlo_closed_forms", _NET + f""" --select SELECT drift, sigma, least(1, {_phi('(-dist - drift * hz) / root')} + exp(least(700, -2 * drift * dist / (sigma * sigma))) * {_phi('(-dist + drift * hz) / root')}) AS first_passage, {_phi('(-dist - drift * hz) / root')} AS terminal FROM h""", "drift sigma first_passage terminal")
def _(spark, d):
    months = R.ledger_periods(A.ledger_entries(spark, d)).select((F.col("net_minor") / 100).alias("net"))
    g = months.agg((F.avg("net") - 900000).alias("drift"), F.stddev_samp("net").alias("sigma"))
    far, months = F.lit(5_000_000.0), F.lit(12.0)
    return g.select("drift", "sigma", P.first_passage(F.col("drift"), F.col("sigma"), far, months).alias("first_passage"), P.norm_cdf((-far - F.col("drift") * months) / (F.col("sigma") * F.sqrt(months))).alias("terminal"))


# --- Rates and experiments ------------------------------------------------------------------------------


@query("bayes_rank_by_posterior_lower_bound", _RATES + """, q AS (SELECT *, successes + 1 AS a, trials - successes + 1 AS b FROM r),
z AS (SELECT group_ref, p, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i, a, b FROM q, (SELECT unnest([0.05, 0.025, 0.975])::DOUBLE AS p) UNION ALL
  SELECT group_ref, p, CASE WHEN c < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c < p THEN hi ELSE (lo + hi) / 2 END, i + 1, a, b FROM (SELECT *, list_sum(list_transform(range(a, a + b), lambda j: exp(lgamma(a + b + 0.0) - lgamma(j + 1.0) - lgamma(a + b - j + 0.0) + j * ln((lo + hi) / 2) + (a + b - 1 - j) * ln(1 - (lo + hi) / 2)))) AS c FROM z WHERE i < 48)),
v AS (SELECT group_ref, max((lo + hi) / 2) FILTER (p = 0.05) AS lower_bound, max((lo + hi) / 2) FILTER (p = 0.025) AS lower, max((lo + hi) / 2) FILTER (p = 0.975) AS upper FROM z WHERE i = 48 GROUP BY 1),
w AS (SELECT q.group_ref, successes, trials, a / (a + b) AS posterior_mean, lower_bound, lower, upper, row_number() OVER (ORDER BY lower_bound DESC, a / (a + b) DESC, q.group_ref)::INT AS rank FROM q JOIN v USING (group_ref)),
s AS (SELECT *, CASE WHEN (least(upper, lag(upper) OVER t) - greatest(lower, lag(lower) OVER t)) / least(upper - lower, lag(upper) OVER t - lag(lower) OVER t) <= 0.5 THEN 1 ELSE 0 END AS apart FROM w WINDOW t AS (ORDER BY rank))
--select SELECT group_ref, successes, trials, posterior_mean, lower_bound, lower, upper, rank, (sum(apart) OVER (ORDER BY rank))::INT AS band FROM s""", "posterior_mean lower_bound lower upper")
def _(spark, d):
    return I.rank_by_lower_bound(R.rate_observations(_spells(spark, d), "assignee_ref", _VERDICT))


def _arms(spark, d):
    return _trials(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("exposures"), F.sum("y").alias("conversions"))


def _beats(aa: str, ba: str, ab: str, bb: str) -> str:
    lb = lambda x, y: f"(lgamma({x}) + lgamma({y}) - lgamma({x} + {y}))"
    return f"least(1, list_sum(list_transform(range(0, ({ab})::BIGINT), lambda i_: exp({lb(f'({aa} + i_)', f'({ba} + {bb})')} - ln({bb} + i_) - {lb('(i_ + 1.0)', f'({bb})')} - {lb(f'({aa})', f'({ba})')}))))"


@query("experiments_beta_ab_test", _ARMS + f""", k AS (SELECT count(*) FILTER (arm = 0) AS e0, count(*) FILTER (arm = 1) AS e1, (sum(y) FILTER (arm = 0))::BIGINT AS c0, (sum(y) FILTER (arm = 1))::BIGINT AS c1 FROM t),
m AS (SELECT *, c0 + 1.0::DOUBLE AS aa, e0 - c0 + 1.0::DOUBLE AS ba, c1 + 1.0::DOUBLE AS ab, e1 - c1 + 1.0::DOUBLE AS bb, (c1 / e1 - c0 / e0) / sqrt((c0 + c1) / (e0 + e1) * (1 - (c0 + c1) / (e0 + e1)) * (1 / e0 + 1 / e1)) AS z FROM k),
l AS (SELECT *, {_beats('aa', 'ba', 'ab', 'bb')} AS p, ab / (ab + bb) * {_beats('aa', 'ba', '(ab + 1)', 'bb')} - aa / (aa + ba) * {_beats('(aa + 1)', 'ba', 'ab', 'bb')} AS la FROM m)
--select SELECT e0 AS n_a, e1 AS n_b, aa / (aa + ba) AS posterior_a, ab / (ab + bb) AS posterior_b, p AS p_b_beats_a, greatest(0, la) AS loss_a, greatest(0, la - (ab / (ab + bb) - aa / (aa + ba))) AS loss_b, z, 2 * (1 - {_phi('abs(z)')}) AS p_value FROM l""", "posterior_a posterior_b p_b_beats_a loss_a loss_b z p_value")
def _(spark, d):
    return I.beta_ab_test(_arms(spark, d))


@query("bandits_arm_states", _ARMS + """, k AS (SELECT arm, count(*) AS exposures, sum(y)::BIGINT AS conversions, sum(y) / count(*) AS mean FROM t GROUP BY arm), g AS (SELECT *, max(mean) OVER () AS best FROM k),
v AS (SELECT *, mean * ln(mean / best) + (1 - mean) * ln((1 - mean) / (1 - best)) AS divergence FROM g) --select SELECT arm, exposures, conversions, mean, divergence, CASE WHEN mean < best THEN (best - mean) / divergence ELSE 0 END * ln(10000) AS regret_bound FROM v""", "mean divergence regret_bound")
def _(spark, d):
    return I.arm_states(_arms(spark, d), 10_000)


@query("experiments_mixture_boundary", _ARMS.replace("WITH", "WITH RECURSIVE", 1) + """, u AS (SELECT 0 AS i, 2 * ln(20.0) AS u UNION ALL SELECT i + 1, 2 * ln(20.0) + ln(1 + u) FROM u WHERE i < 60), r AS (SELECT 1000 * 4 / u AS rho FROM u WHERE i = 60), n AS (SELECT arm, count(*) AS n FROM t GROUP BY arm)
--select SELECT arm, n, n * 4.0::DOUBLE AS v, sqrt((n * 4 + rho) * ln((n * 4 + rho) / (rho * 0.0025))) AS boundary FROM n, r""", "v boundary")
def _(spark, d):
    _, boundary = I.mixture_boundary(1000, 4.0, 0.05)
    return _trials(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("n") * 4.0).withColumn("boundary", boundary)


# --- Votes and surveys ----------------------------------------------------------------------------------


@query("voting_score", """WITH c AS (SELECT o_custkey AS v, o_orderpriority AS o, count(*) AS s FROM orders GROUP BY 1, 2), n AS (SELECT count(DISTINCT v) AS n FROM c), k AS (SELECT o AS option_ref, sum(s)::BIGINT AS total, count(*) AS scored, avg(s) AS mean_of_scorers, sum(s) / max(n) AS mean_of_all FROM c, n GROUP BY 1)
--select SELECT *, row_number() OVER (ORDER BY total DESC, option_ref)::INT AS rank FROM k""", "mean_of_scorers mean_of_all")
def _(spark, d):
    return S.score_vote(A.ballots(spark, d).select("voter_ref", "option_ref", F.col("n").alias("score")))


@query("voting_smith_set", _MATRIX.replace("WITH", "WITH RECURSIVE", 1) + """, l AS (SELECT x.a_ref AS a, x.b_ref AS b FROM m x JOIN m y ON x.a_ref = y.b_ref AND x.b_ref = y.a_ref WHERE x.votes >= y.votes), p AS (SELECT a, b FROM l UNION SELECT p.a, l.b FROM p JOIN l ON l.a = p.b)
--select SELECT o AS option_ref, (SELECT count(*) FROM p WHERE p.a = o AND p.b <> o) = (SELECT count(*) - 1 FROM opt) AS in_smith_set FROM opt""")
def _(spark, d):
    return S.smith_set(_matrix(spark, d), PRIORITIES)


@query("voting_turnout_representativeness", f"""WITH v AS (SELECT DISTINCT o_custkey FROM orders), k AS (SELECT n_name AS stratum, count(*) AS eligible, count(o_custkey) AS voted FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN v ON o_custkey = c_custkey GROUP BY 1), w AS (SELECT sum(voted) / sum(eligible) AS r FROM k),
x AS (SELECT *, sum((voted - eligible * r) ^ 2 / (eligible * r)) OVER () AS chi2, voted / eligible AS p, 1.959963984540054 AS z, voted < 5 OR eligible < 5 AS s FROM k, w)
--select SELECT stratum, CASE WHEN NOT s THEN eligible END AS eligible, CASE WHEN NOT s THEN voted END AS voted, CASE WHEN NOT s THEN p END AS turnout, CASE WHEN NOT s THEN (p + z * z / (2 * eligible)) / (1 + z * z / eligible) - z * sqrt(p * (1 - p) / eligible + z * z / (4.0 * eligible * eligible)) / (1 + z * z / eligible) END AS lower,
  CASE WHEN NOT s THEN (p + z * z / (2 * eligible)) / (1 + z * z / eligible) + z * sqrt(p * (1 - p) / eligible + z * z / (4.0 * eligible * eligible)) / (1 + z * z / eligible) END AS upper, chi2, {_chi2_even('chi2', 24)} AS p_value, s AS suppressed FROM x""", "turnout lower upper chi2 p_value")
def _(spark, d):
    v = A.table(spark, d, "orders").select("o_custkey").distinct()
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("stratum"))
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(v, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return I.representativeness(c.groupBy("stratum").agg(F.count(F.lit(1)).alias("eligible"), F.count("o_custkey").alias("voted")))


@query("survey_mann_whitney_u", _LIKERT + f""", g AS (SELECT value, count(*) FILTER (right(stratum, 1) < '5') AS a, count(*) FILTER (right(stratum, 1) >= '5') AS b FROM r GROUP BY 1), n AS (SELECT sum(a)::BIGINT AS na, sum(b)::BIGINT AS nb, sum((a + b) ^ 3 - (a + b)) AS ties FROM g),
u AS (SELECT sum(x.a * y.b * CASE WHEN x.value > y.value THEN 1 WHEN x.value = y.value THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM g x, g y), z AS (SELECT u, na AS n_a, nb AS n_b, (u - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))) AS z FROM u, n)
--select SELECT *, 2 * (1 - {_phi('abs(z)')}) AS p_value FROM z""", "u z p_value")
def _(spark, d):
    return I.mann_whitney(_responses(spark, d).select(F.when(F.substring("stratum", -1, 1) < "5", "a").otherwise("b").alias("side"), "value"))


# --- Drift, segments, networks, audit --------------------------------------------------------------------


_KS = """WITH v AS (SELECT CASE year(l_shipdate) WHEN 1997 THEN 'ref' WHEN 1999 THEN 'cur' END AS side, l_quantity AS l_quantity, l_extendedprice, l_discount FROM lineitem WHERE year(l_shipdate) IN (1997, 1999)),
f AS (SELECT side, 'price' AS feature, l_extendedprice AS x FROM v UNION ALL SELECT side, 'quantity', l_quantity FROM v UNION ALL SELECT side, 'discount', l_discount FROM v),
c AS (SELECT DISTINCT feature, x, count(*) FILTER (side = 'ref') OVER w / (count(*) FILTER (side = 'ref') OVER (PARTITION BY feature)) AS a, count(*) FILTER (side = 'cur') OVER w / (count(*) FILTER (side = 'cur') OVER (PARTITION BY feature)) AS b FROM f WINDOW w AS (PARTITION BY feature ORDER BY x)),
k AS (SELECT feature, max(abs(a - b)) AS d FROM c GROUP BY 1), n AS (SELECT sqrt(count(*) FILTER (side = 'ref') * count(*) FILTER (side = 'cur') / count(*)) AS s FROM v), l AS (SELECT feature, d, s * d AS l FROM k, n),
p AS (SELECT feature, d, CASE WHEN l < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * l * l))))) END::DOUBLE AS p_value FROM l),
h AS (SELECT *, least(1, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, feature) + 1)) AS s FROM p)"""


@query("drift_holm_adjusted", _KS + " --select SELECT feature, d, p_value, max(s) OVER (ORDER BY p_value, feature) AS adjusted FROM h", "d p_value adjusted")
def _(spark, d):
    tests = None
    for feature, column in (("price", "l_extendedprice"), ("quantity", "l_quantity"), ("discount", "l_discount")):
        t = S.ks(_two_years(spark, d, F.col(column).alias("x"))).select(F.lit(feature).alias("feature"), "d", P.ks_p_value(F.col("d"), F.col("n_ref"), F.col("n_cur")).alias("p_value"))
        tests = t if tests is None else tests.unionByName(t)
    return I.holm(tests)


@query("drift_psi_quantile", _SIDES + """, q AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM v WHERE side = 'ref'), b AS (SELECT side, len(list_filter(e, lambda y: y < x))::INT AS bin FROM v, q), n AS (SELECT bin, count(*) FILTER (side = 'ref') AS ref, count(*) FILTER (side = 'cur') AS cur FROM b GROUP BY bin),
s AS (SELECT *, greatest(1e-6, ref / sum(ref) OVER ()) AS p, greatest(1e-6, cur / sum(cur) OVER ()) AS q FROM n) --select SELECT bin, ref, cur, (q - p) * ln(q / p) AS psi FROM s""", "psi")
def _(spark, d):
    return S.psi_quantile(_two_years(spark, d, F.col("l_extendedprice").alias("x")), 10)


@query("calibration_expected_error", """WITH s AS (SELECT CAST(l_discount * 10 AS DECIMAL(12, 9)) AS p, (l_returnflag = 'R')::INT AS y, greatest(1, ceil(round(l_discount * 100, 9)))::INT AS bin FROM lineitem), b AS (SELECT bin, count(*) AS n, abs(sum(p)::DOUBLE / count(*) - sum(y) / count(*)) AS gap FROM s GROUP BY bin)
--select SELECT sum(n * gap) / sum(n) AS expected_error, max(gap) AS largest_gap, sum(n)::BIGINT AS n FROM b""", "expected_error largest_gap")
def _(spark, d):
    b = S.score_bins(A.scores(spark, d), 10).withColumn("gap", F.abs(F.col("mean_p") - F.col("observed")))
    return b.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("expected_error"), F.max("gap").alias("largest_gap"), F.sum("n").alias("n"))


@query("calibration_platt")
def platt_scaling(spark, d):
    s = A.scores(spark, d)
    slope, intercept = I.platt(s)
    return s.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).withColumn("calibrated", 1 / (1 + F.exp(-(slope * F.col("p") + intercept))))


@query("fairness_lorenz", _SPELLS + """, l AS (SELECT assignee_ref AS group_ref, count(*) AS load FROM sp GROUP BY 1) --select SELECT group_ref, load, row_number() OVER w / count(*) OVER () AS share_of_workers, sum(load) OVER w / sum(load) OVER () AS share_of_load FROM l WINDOW w AS (ORDER BY load, group_ref)""", "share_of_workers share_of_load")
def _(spark, d):
    return S.lorenz(_spells(spark, d).groupBy(F.col("assignee_ref").alias("group_ref")).agg(F.count(F.lit(1)).alias("load")))


@query("network_modularity", """WITH s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS m FROM lineitem), c AS (SELECT o, count(*) AS n FROM s GROUP BY o), g AS (SELECT a.m AS a, b.m AS b, sum(1.0::DOUBLE / (n - 1)) AS w FROM s a JOIN s b ON a.o = b.o AND a.m < b.m JOIN c ON c.o = a.o GROUP BY 1, 2),
k AS (SELECT s_suppkey AS m, n_regionkey AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey), e AS (SELECT w, x.c AS ca, y.c AS cb FROM g JOIN k x ON x.m = a JOIN k y ON y.m = b), t AS (SELECT sum(w) AS m FROM e), i AS (SELECT ca AS c, sum(w) AS w FROM e WHERE ca = cb GROUP BY 1),
d AS (SELECT c, sum(w) AS d FROM (SELECT ca AS c, w FROM e UNION ALL SELECT cb, w FROM e) GROUP BY 1) --select SELECT d.c AS community, d AS degree, coalesce(i.w, 0) AS inside, coalesce(i.w, 0) / m - (d / (2 * m)) ^ 2 AS modularity FROM d LEFT JOIN i USING (c), t""", "degree inside modularity")
def _(spark, d):
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("community"))
    of = A.table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("member_ref"), "community")
    return R.modularity(R.interaction_edges(_pairs(spark, d)), of)


def _ties(spark, d):
    """Suppliers who share an order, by how often they do."""
    return R.interaction_edges(_pairs(spark, d))


@query("network_louvain_communities")
def louvain_communities(spark, d):
    return N.communities(_ties(spark, d), sweeps=15, levels=6)


@query("network_betweenness_centrality", """WITH s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS m FROM lineitem), t AS MATERIALIZED (SELECT DISTINCT a.m AS a, b.m AS b FROM s a JOIN s b ON a.o = b.o AND a.m <> b.m),
w1 AS MATERIALIZED (SELECT a AS s, b AS v, 1 AS d, 1::DOUBLE AS k FROM t), x2 AS MATERIALIZED (SELECT s, b AS v, 2 AS d, sum(k) AS k FROM w1 JOIN t ON a = v WHERE b <> s GROUP BY s, b), w2 AS MATERIALIZED (SELECT * FROM x2 ANTI JOIN w1 USING (s, v)),
x3 AS MATERIALIZED (SELECT s, b AS v, 3 AS d, sum(k) AS k FROM w2 JOIN t ON a = v WHERE b <> s GROUP BY s, b), w3 AS MATERIALIZED (SELECT * FROM x3 ANTI JOIN w1 USING (s, v) ANTI JOIN w2 USING (s, v)),
p AS MATERIALIZED (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3), c AS (SELECT sv.v, sum(sv.k * vt.k / st.k) / 2 AS x FROM p st JOIN p sv ON sv.s = st.s AND sv.d < st.d JOIN p vt ON vt.s = sv.v AND vt.v = st.v AND vt.d = st.d - sv.d GROUP BY 1),
n AS (SELECT a AS member_ref, count(*) AS degree FROM t GROUP BY 1) --select SELECT member_ref, coalesce(x, 0) / greatest((count(*) OVER () - 1) * (count(*) OVER () - 2) / 2, 1) AS betweenness, degree FROM n LEFT JOIN c ON v = member_ref""", "betweenness")
def betweenness_centrality(spark, d):
    return N.betweenness(_ties(spark, d))


@query("segmentation_adjusted_rand", """WITH t AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), s AS (SELECT sum(n * (n - 1) / 2) AS ij, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM t GROUP BY a)) AS i, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM t GROUP BY b)) AS j, sum(n) * (sum(n) - 1) / 2 AS al FROM t)
--select SELECT ((ij - i * j / al) / ((i + j) / 2 - i * j / al))::DOUBLE AS adjusted_rand FROM s""", "adjusted_rand")
def _(spark, d):
    return S.adjusted_rand(A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b")))


@query("segmentation_robust_scale", "WITH q AS (SELECT c_mktsegment AS s, quantile_cont(c_acctbal, 0.5) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer GROUP BY 1) --select SELECT c_custkey AS member_ref, (c_acctbal - m) / r AS scaled FROM customer JOIN q ON s = c_mktsegment", "scaled")
def _(spark, d):
    return S.robust_scale(A.table(spark, d, "customer").select(F.col("c_custkey").alias("member_ref"), "c_mktsegment", F.col("c_acctbal").alias("x")), "c_mktsegment").select("member_ref", "scaled")


@query("audit_benford_two_digits", """WITH a AS (SELECT substr((round(l_extendedprice * 100)::BIGINT)::VARCHAR, 1, 2)::INT AS digits FROM lineitem WHERE round(l_extendedprice * 100) >= 10), n AS (SELECT g::INT AS digits, (SELECT count(*) FROM a WHERE a.digits = g) AS n FROM range(10, 100) AS r(g)), t AS (SELECT sum(n) AS t FROM n)
--select SELECT digits, n, n / t AS share, log10(1 + 1.0 / digits) AS expected, (n - t * log10(1 + 1.0 / digits)) ^ 2 / (t * log10(1 + 1.0 / digits)) AS chi2_part FROM n, t""", "share expected chi2_part")
def _(spark, d):
    return S.benford_digits(A.table(spark, d, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount")), 2)


# --- Logs with reopening ------------------------------------------------------------------------------

_LOG = """WITH ds AS (SELECT o_orderkey AS k, list_sort(list(DISTINCT l_shipdate::DATE)) AS ds FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate::DATE >= o_orderdate::DATE GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS od, o_custkey % 20 AS who, o_orderpriority AS cat, ds, min(o_orderkey) OVER (PARTITION BY o_custkey) AS survivor FROM orders LEFT JOIN ds ON k = o_orderkey),
m AS (SELECT *, ds[4] IS NOT NULL AND k % 7 = 3 AND k <> survivor AS merged FROM o)"""
_REOPEN = _LOG + """,
e AS (SELECT k, 0 AS i, od AS opened, ds[4] AS term, CASE WHEN merged THEN 'merged' ELSE 'resolved' END AS kind, coalesce(ds[5], DATE '2000-01-01') AS until, ds[1] AS answer, ds[2] AS p, coalesce(ds[3], DATE '2099-01-01') AS r, CASE WHEN merged THEN survivor END AS parent, who, cat FROM m
  UNION ALL SELECT k, 1, ds[5], ds[6], 'withdrawn', DATE '2000-01-01', ds[7], NULL, NULL, k, NULL, NULL FROM m WHERE ds[5] IS NOT NULL),
f AS (SELECT *, greatest(opened, DATE '1996-01-01') AS s, coalesce(term < DATE '2000-01-01', false) AS done FROM e WHERE opened < DATE '2000-01-01' AND NOT coalesce(term < DATE '1996-01-01', false)),
g AS (SELECT *, CASE WHEN done THEN greatest(s, term) ELSE DATE '2000-01-01' END AS z FROM f),
h AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE greatest(0, least(r, z) - greatest(p, s)) END * 24.0 AS paused FROM g)
--select SELECT CASE WHEN i > 0 THEN k || '#2' ELSE k::VARCHAR END AS spell_ref, CASE WHEN i > 0 OR done THEN parent::VARCHAR END AS parent_ref, opened::TIMESTAMP::VARCHAR AS opened_at, opened < DATE '1996-01-01' AS left_truncated,
  (z - s) * 24.0::DOUBLE AS duration_hours, greatest(0.0, (z - s) * 24.0 - paused)::DOUBLE AS active_hours, paused::DOUBLE AS paused_hours, CASE WHEN done THEN kind END AS outcome, CASE WHEN done THEN 'none' ELSE 'administrative' END AS censoring,
  CASE WHEN answer < DATE '2000-01-01' THEN (answer - opened) * 24.0::DOUBLE END AS first_response_hours, (SELECT count(*) FROM m WHERE merged AND survivor = h.k AND ds[4] >= h.opened AND ds[4] < h.until) AS duplicate_count,
  coalesce(cat, 'other') AS category, CASE WHEN answer <= z THEN who END AS assignee_ref FROM h"""


@query("reducer_request_spells_reopened", _REOPEN, "duration_hours active_hours paused_hours first_response_hours")
def _(spark, d):
    s = L.spells_from_log(A.request_log(spark, d), A.START, A.END, sla_clock="active")
    return s.withColumn("opened_at", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss")).drop("at_risk_from", "terminal_at", "interval_lo_hours", "interval_hi_hours", "reopened_count")


# --- Raking -------------------------------------------------------------------------------------------


def _sweeps(k: int) -> str:
    """Proportional fitting to two margins, written out step by step."""
    fit = lambda i, c: f"r{i} AS (SELECT survey, segment, region, n, ps, pr, w * p{c[0]} * sum(n) OVER (PARTITION BY survey) / sum(n * w) OVER (PARTITION BY survey, {c}) AS w FROM r{i - 1})"
    return ",\n".join(fit(i, "segment" if i % 2 else "region") for i in range(1, 2 * k + 1))


_RAKED = """WITH c AS (SELECT c_custkey, c_mktsegment AS segment, n_regionkey AS region FROM customer JOIN nation ON n_nationkey = c_nationkey),
a AS (SELECT segment, count(*) / (SELECT count(*) FROM c) AS ps FROM c GROUP BY 1), b AS (SELECT region, count(*) / (SELECT count(*) FROM c) AS pr FROM c GROUP BY 1),
r0 AS (SELECT year(o_orderdate) AS survey, segment, region, count(*) AS n, any_value(ps) AS ps, any_value(pr) AS pr, 1.0::DOUBLE AS w FROM orders JOIN c ON c_custkey = o_custkey JOIN a USING (segment) JOIN b USING (region) GROUP BY 1, 2, 3),
"""


@query("survey_raking_weights", _RAKED + _sweeps(25) + """
--select SELECT survey, segment, region, n, w AS weight, sum(n) OVER v * sum(n * w * w) OVER v / (sum(n * w) OVER v) ** 2 AS design_effect FROM r50 WINDOW v AS (PARTITION BY survey)""", "weight design_effect")
def _(spark, d):
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_mktsegment").alias("segment")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = A.table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("survey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    share = lambda k: c.groupBy(k).agg(F.count(F.lit(1)).alias("m")).select(k, (F.col("m") / F.sum("m").over(Window.partitionBy())).alias("share"))  # noqa: E731  a row per level
    return K.rake(o, "survey", {k: share(k) for k in ("segment", "region")}, tolerance=1e-12).drop("missing_share", "converged")


# --- Risk ---------------------------------------------------------------------------------------------


#: Days after which an order that has not shipped counts as late, and the end of what is known.
LATE, KNOWN = 60, 10957


def _dues(spark, d):
    """Orders as dues: ref, member, day, amount, and whether they were settled late (null if neither is known yet)."""
    o = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), F.col("o_custkey").alias("member_ref"), A.day("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("stratum")).where(F.col("day") < KNOWN)
    paid = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ref")).agg(F.min(A.day("l_shipdate")).alias("paid"))
    known = o.join(paid, "ref", "left").withColumn("paid", F.when(F.col("paid") < KNOWN, F.col("paid")))
    late = F.when(F.col("paid") <= F.col("day") + LATE, 0).when(F.col("day") + LATE < KNOWN, 1)
    return known.withColumn("label", late).withColumn("verdict_day", F.least(F.col("paid"), F.col("day") + LATE + 1))


_DUES = f"""WITH p AS (SELECT l_orderkey AS ref, min(l_shipdate::DATE - DATE '1970-01-01') AS paid FROM lineitem GROUP BY 1),
d0 AS (SELECT o_orderkey AS ref, o_custkey AS member_ref, o_orderdate::DATE - DATE '1970-01-01' AS day, o_totalprice AS amount, CASE WHEN paid < {KNOWN} THEN paid END AS paid FROM orders LEFT JOIN p ON ref = o_orderkey WHERE o_orderdate::DATE - DATE '1970-01-01' < {KNOWN}),
d AS (SELECT *, CASE WHEN paid <= day + {LATE} THEN 0 WHEN day + {LATE} < {KNOWN} THEN 1 END AS label, CASE WHEN paid IS NULL THEN day + {LATE} + 1 ELSE least(paid, day + {LATE} + 1) END AS verdict FROM d0)"""


def _due_features(spark, d):
    """What was known of each due's member the day before: earlier dues, and earlier verdicts on them."""
    dues = _dues(spark, d)
    opened = Q.as_of(dues, dues.select("member_ref", "day", F.col("amount").alias("weight")))
    verdicts = dues.where("label is not null").select("member_ref", F.col("verdict_day").alias("day"), F.col("label").cast("double").alias("weight"))
    judged = Q.as_of(dues.select("ref", "member_ref", "day"), verdicts, recent=36500).select("ref", F.col("total").alias("judged"), F.col("volume").alias("late_before"))
    return opened.join(judged, "ref").withColumn("late_rate", F.try_divide("late_before", "judged"))


@query("risk_late_payment_features", _DUES + """ --select SELECT ref, label, count(e.ref) FILTER (e.day < d.day) AS total, count(e.ref) FILTER (e.day < d.day AND e.day >= d.day - 90) AS frequency, d.day - max(e.day) FILTER (e.day < d.day) AS recency_days, d.day - min(e.day) FILTER (e.day < d.day) AS tenure_days,
  coalesce(sum(e.amount) FILTER (e.day < d.day AND e.day >= d.day - 90), 0) AS volume, count(e.label) FILTER (e.verdict < d.day) AS judged, coalesce(sum(e.label) FILTER (e.verdict < d.day), 0)::DOUBLE AS late_before FROM (SELECT ref, label, member_ref AS m, day FROM d) d JOIN (SELECT ref AS ref_, member_ref AS m, day, amount, label, verdict FROM d) e USING (m) GROUP BY ref, label, d.day""".replace("e.ref)", "e.ref_)").replace("SELECT ref, label, count", "SELECT ref, d.label AS label, count").replace("GROUP BY ref, label, d.day", "GROUP BY ref, d.label, d.day"), "volume")
def late_payment_features(spark, d):
    return _due_features(spark, d).select("ref", F.col("label").cast("int").alias("label"), "total", "frequency", "recency_days", "tenure_days", "volume", "judged", "late_before")


_DUE_FEATURES = ("recency_days", "frequency", "volume", "tenure_days", "late_rate", "amount")


@query("risk_late_payment")
def late_payment_risk(spark, d):
    rows = _due_features(spark, d).withColumn("feature_day", F.col("day") - 1).withColumn("horizon_day", F.col("day"))
    return Q.risk(rows, _DUE_FEATURES, ref="ref", stratum="stratum")[0]


def _quarters(spark, d):
    """Members who were active in the year before a quarter's first day, what was known of them then, and whether they stayed away for the 180 days from it (null if that is not known yet)."""
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("member_ref"), A.day("o_orderdate").alias("day"), F.col("o_totalprice").alias("weight")).where(F.col("day") < KNOWN)
    starts = spark.sql(f"select unix_date(s) as start from (select explode(sequence(date'1995-01-01', date_from_unix_date({KNOWN}), interval 3 month)) as s)")  # a row per quarter
    days = o.groupBy("member_ref", "day").agg(F.count(F.lit(1)).alias("n"))
    near = days.join(F.broadcast(starts), (F.col("start") > F.col("day") - 180) & (F.col("start") <= F.col("day") + 365))
    seen = near.groupBy("member_ref", F.col("start").alias("q")).agg(F.max((F.col("day") < F.col("start")).cast("int")).alias("before"), F.max((F.col("day") >= F.col("start")).cast("int")).alias("after")).where("before = 1")
    label = F.when(F.col("after") == 1, 0).when(F.col("q") + 180 < KNOWN, 1)
    anchors = seen.select("member_ref", F.col("q").alias("day"), label.cast("int").alias("label"))
    return Q.as_of(anchors, o)


@query("risk_disengagement_features", f"""WITH o AS (SELECT o_custkey AS m, o_orderdate::DATE - DATE '1970-01-01' AS day, o_totalprice AS w FROM orders WHERE o_orderdate::DATE - DATE '1970-01-01' < {KNOWN}),
q AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1970-01-01' + {KNOWN}, INTERVAL 3 MONTH))::DATE - DATE '1970-01-01' AS q), x AS (SELECT m, q, day, w FROM o, q WHERE day < q + 180)
--select SELECT m AS member_ref, q AS day, CASE WHEN max(day) >= q THEN 0 WHEN q + 180 < {KNOWN} THEN 1 END AS label, q - max(day) FILTER (day < q) AS recency_days, count(*) FILTER (day < q AND day >= q - 90) AS frequency, coalesce(sum(w) FILTER (day < q AND day >= q - 90), 0) AS volume,
  count(*) FILTER (day < q) AS total, q - min(day) FILTER (day < q) AS tenure_days FROM x GROUP BY m, q HAVING count(*) FILTER (day < q AND day >= q - 365) > 0""", "volume")
def disengagement_features(spark, d):
    return _quarters(spark, d)


@query("risk_member_disengagement")
def member_disengagement_risk(spark, d):
    rows = _quarters(spark, d).select("*", F.concat_ws(":", "member_ref", "day").alias("ref"), (F.col("member_ref") % 5).alias("stratum"), (F.col("day") - 1).alias("feature_day"), F.col("day").alias("horizon_day"))
    return Q.risk(rows, ("recency_days", "frequency", "volume", "total", "tenure_days"), ref="ref", stratum="stratum")[0]


# --- Topics -------------------------------------------------------------------------------------------


def _texts(spark, d):
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text")


@query("text_nmf_topics")
def nmf_topics(spark, d):
    return T.nmf_topics(_texts(spark, d), topics=(4,), max_features=2000, iterations=20)


@query("text_npmi_coherence", r"""WITH w AS (SELECT DISTINCT doc_id AS d, lang, unnest(regexp_split_to_array(lower(text), '\s+')) AS t FROM documents), f AS (SELECT lang, t, count(*) AS n FROM w WHERE lang IS NOT NULL AND t <> '' GROUP BY 1, 2),
tp AS (SELECT lang AS topic, t FROM (SELECT lang, t, row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) AS i FROM f) WHERE i <= 8), n AS (SELECT count(*) AS n FROM documents), x AS (SELECT DISTINCT d, t FROM w),
s AS (SELECT t, count(*) AS n FROM x GROUP BY 1), p AS (SELECT topic, a.t AS a, b.t AS b FROM tp a JOIN tp b USING (topic) WHERE a.t < b.t), c AS (SELECT topic, p.a, p.b, (SELECT count(*) FROM x y JOIN x z USING (d) WHERE y.t = p.a AND z.t = p.b) AS k FROM p),
r AS (SELECT topic, CASE WHEN k = 0 THEN -1 WHEN k = n.n THEN 1 ELSE ln(k / n.n * n.n * n.n / (sa.n * sb.n)) / -ln(k / n.n) END AS v FROM c JOIN s sa ON sa.t = a JOIN s sb ON sb.t = b, n) --select SELECT topic, count(*) AS pairs, avg(v) AS coherence FROM r GROUP BY 1""", "coherence")
def npmi_coherence(spark, d):
    words = A.table(spark, d, "documents").where("lang is not null").select("doc_id", "lang", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("term")).where("term <> ''")
    n = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "term"))
    first = n.withColumn("i", best("lang", F.pmod(F.xxhash64("term"), F.lit(64)))).where("i <= 8").withColumn("i", best("lang")).where("i <= 8")
    return T.npmi_coherence(_texts(spark, d), first.select(F.col("lang").alias("topic"), "term"))


# --- Budgets ------------------------------------------------------------------------------------------


def _budget(spark, d):
    """Each nation decides on the order priorities: a customer approves those it orders most and second most often; an option costs a thousandth of its orders' worth, half of all costs can be spent."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("v"), F.col("c_nationkey").cast("string").alias("decision_ref"), F.col("c_mktsegment").alias("stratum"))
    votes = A.ballots(spark, d).where("tier <= 2").groupBy(F.col("voter_ref").alias("v")).agg(F.collect_set("option_ref").alias("approvals"))
    ballots = votes.join(c, "v").select("decision_ref", "stratum", "approvals")
    worth = A.table(spark, d, "orders").select(F.col("o_custkey").alias("v"), F.col("o_orderpriority").alias("option_ref"), "o_totalprice").join(c, "v").groupBy("decision_ref", "option_ref").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) / 1000).cast("double").alias("cost"))
    half = worth.groupBy("decision_ref").agg((F.sum("cost") / 2).alias("budget"))
    return ballots, worth.join(half, "decision_ref")


@query("budgeting_method_of_equal_shares")
def method_of_equal_shares(spark, d):
    return G.equal_shares(*_budget(spark, d))


@query("budgeting_greedy_knapsack")
def greedy_knapsack(spark, d):
    return G.greedy_knapsack(*_budget(spark, d))


@query("budgeting_ejr_violations", _BALLOTS + """, a AS (SELECT c_nationkey::VARCHAR AS g, v, o FROM bal JOIN customer ON c_custkey = v WHERE tier <= 2), nv AS (SELECT g, count(DISTINCT v) AS n FROM a GROUP BY 1),
k AS (SELECT c_nationkey::VARCHAR AS g, o_orderpriority AS o, round(sum(o_totalprice::DECIMAL(18, 2)) / 1000)::DOUBLE AS cost FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), b AS (SELECT g, sum(cost) / 2 AS budget FROM k GROUP BY 1),
f AS (SELECT g, o FROM k WHERE false), u AS (SELECT v, count(f.o) AS got FROM a LEFT JOIN f USING (g, o) GROUP BY 1), os AS (SELECT g, list(o ORDER BY o) AS os, list(cost ORDER BY o) AS cs FROM k GROUP BY 1),
t AS (SELECT g, list_filter(range(0, len(os)), lambda i: (m >> i) % 2 = 1) AS ix, os, cs FROM os, range(1, 4096) r(m) WHERE m < 2 ^ len(os)), w AS (SELECT g, list_transform(ix, lambda i: os[i + 1]) AS s, list_sum(list_transform(ix, lambda i: cs[i + 1])) AS cost FROM t),
l AS (SELECT g, v, list(o) AS likes FROM a GROUP BY 1, 2), gr AS (SELECT w.g, s, w.cost, count(*) AS voters, max(got) AS best FROM w JOIN l ON l.g = w.g AND len(list_intersect(s, likes)) = len(s) JOIN u USING (v) GROUP BY 1, 2, 3)
--select SELECT g AS decision_ref, array_to_string(s, ',') AS options, cost, voters::DOUBLE AS voters, best::INT AS best, len(s)::INT AS required, true AS exhaustive FROM gr JOIN nv USING (g) JOIN b USING (g) WHERE voters * budget >= cost * n AND best < len(s)""", "cost voters")
def ejr_violations(spark, d):
    ballots, paper = _budget(spark, d)
    return G.ejr_violations(ballots, paper, paper.where("false"))  # with nothing funded: all that groups are entitled to


@query("budgeting_fairness_report", _BALLOTS + """, a AS (SELECT c_nationkey::VARCHAR AS g, c_mktsegment AS s, v, o FROM bal JOIN customer ON c_custkey = v WHERE tier <= 2),
k AS (SELECT c_nationkey::VARCHAR AS g, o_orderpriority AS o, round(sum(o_totalprice::DECIMAL(18, 2)) / 1000)::DOUBLE AS cost FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), f AS (SELECT g, arg_min(o, (cost, o)) AS o FROM k GROUP BY 1),
z AS (SELECT g, s, count(DISTINCT v) AS n FROM a GROUP BY 1, 2), y AS (SELECT a.g, a.s, k.cost / count(*) OVER (PARTITION BY a.g) AS part FROM a JOIN f USING (g, o) JOIN k USING (g, o)), p AS (SELECT g, s, sum(part) AS won FROM y GROUP BY 1, 2),
r AS (SELECT g, CASE WHEN n < 5 THEN 'other' ELSE s END AS s, sum(n)::BIGINT AS voters, sum(coalesce(won, 0)) AS won FROM z LEFT JOIN p USING (g, s) GROUP BY 1, 2), e AS (SELECT *, voters / sum(voters) OVER (PARTITION BY g) AS electorate, coalesce(won / nullif(sum(won) OVER (PARTITION BY g), 0), 0) AS share_won FROM r)
--select SELECT g AS decision_ref, s AS stratum, voters, electorate, won, share_won, share_won / electorate AS utilisation FROM e""", "electorate won share_won utilisation")
def budget_fairness(spark, d):
    ballots, paper = _budget(spark, d)
    cheapest = paper.groupBy("decision_ref").agg(F.min(F.struct("cost", "option_ref")).alias("m")).select("decision_ref", F.col("m.option_ref").alias("option_ref"))
    return G.fairness_report(ballots, paper, cheapest)


# --- Bounds, pools and models -------------------------------------------------------------------------


def _curve(name: str, where: str, event: str) -> str:
    return f"""{name}n AS (SELECT t, count(*) AS n, count(*) FILTER (x = t AND {event}) AS d FROM (SELECT DISTINCT x AS t FROM s WHERE {where} AND {event}) JOIN s ON {where} AND x >= t GROUP BY t), {name} AS MATERIALIZED (SELECT t, product(1 - d / n) OVER (ORDER BY t) AS o FROM {name}n)"""


@query("conformal_survival_eta_bound", _SPELLS + f""", s AS MATERIALIZED (SELECT leave::DOUBLE AS x, outcome = 'resolved' AS e, request_ref % 2 = 0 AS tr FROM sp), {_curve("ck", "tr", "NOT e")}, {_curve("ek", "tr", "e")}, {_curve("ak", "true", "e")},
h AS (SELECT quantile_cont(x, 0.6) AS h FROM s WHERE tr), st AS (SELECT coalesce((SELECT min(t) FROM ek WHERE o <= 0.9), (SELECT min(x) FROM s WHERE tr)) AS st), c AS (SELECT x, e, least(x, h) AS t FROM s, h WHERE NOT tr AND (e OR x >= h)),
u AS (SELECT st - c.t AS score, 1 / greatest(coalesce(o, 1), 0.001) AS w FROM (SELECT c.t, ck.o FROM c ASOF LEFT JOIN ck ON c.t >= ck.t) c, st), r AS (SELECT score, sum(sum(w)) OVER (ORDER BY score) AS upto FROM u GROUP BY score), z AS (SELECT sum(w) + max(w) AS tot, count(*) AS n FROM u),
b AS (SELECT greatest(0, coalesce(st - (SELECT min(score) FROM r, z WHERE upto / tot >= 0.9 - 1e-12), 0)) AS low FROM st), f AS (SELECT low, h, n, coalesce((SELECT min(t) FROM ak WHERE o <= 0.5), (SELECT max(x) FROM s)) AS mid, coalesce((SELECT min(t) FROM ak WHERE o <= 0.1), (SELECT max(x) FROM s)) AS up,
  (SELECT count(*) FROM s WHERE NOT tr AND NOT e AND x < h) AS dropped, coalesce((SELECT arg_max(o, t) FROM ck WHERE t <= h), 1) AS support, (SELECT count(*) FILTER (x >= low) / count(*) FROM s WHERE NOT tr AND e) AS coverage FROM b, h, z)
--select SELECT low AS lower_days, mid AS point_days, up AS upper_days, h AS horizon_days, n AS calibration_n, dropped, support, coverage, support <= 0.05 OR coalesce(coverage, 0) < 0.85 AS blocked FROM f""", "lower_days point_days upper_days horizon_days support coverage")
def survival_eta_bound(spark, d):
    return V.survival_eta_bound(_spells(spark, d), "outcome = 'resolved'", "request_ref % 2 = 0")


@query("bayes_hierarchical_pool", """WITH u AS (SELECT l_suppkey AS unit_ref, avg(l_quantity) AS y, stddev_samp(l_quantity) / sqrt(count(*)) AS s FROM lineitem GROUP BY 1), v AS (SELECT * FROM u WHERE s > 0), k AS (SELECT greatest(4 * max(s), 4 * stddev_samp(y), 1e-6) / 400 AS step FROM v),
g0 AS (SELECT (i + 0.5) * step AS tau FROM k, range(400) t(i)), g1 AS (SELECT tau, 1 / sum(1 / (s * s + tau * tau)) AS v_mu, sum(y / (s * s + tau * tau)) / sum(1 / (s * s + tau * tau)) AS mu, sum(ln(1 / (s * s + tau * tau))) / 2 AS lp FROM g0, v GROUP BY tau),
g2 AS (SELECT tau, any_value(v_mu) AS v_mu, any_value(mu) AS mu, ln(any_value(v_mu)) / 2 + any_value(lp) - sum((y - mu) ^ 2 / (s * s + tau * tau)) / 2 AS l FROM g1, v GROUP BY tau), g AS MATERIALIZED (SELECT tau, mu, v_mu, exp(l - max(l) OVER ()) / sum(exp(l - m)) OVER () AS w FROM g2, (SELECT max(l) AS m FROM g2)),
a AS (SELECT sum(tau * w) AS tau, (SELECT min(tau) FROM (SELECT tau, sum(w) OVER (ORDER BY tau) AS c FROM g) WHERE c >= 0.025) AS tau_lower, (SELECT min(tau) FROM (SELECT tau, sum(w) OVER (ORDER BY tau) AS c FROM g) WHERE c >= 0.975) AS tau_upper FROM g),
p AS (SELECT unit_ref, y, s, sum(w * (y * g.tau ^ 2 + mu * s ^ 2) / (s ^ 2 + g.tau ^ 2)) AS pooled, sum(w * (g.tau ^ 2 * s ^ 2 / (s ^ 2 + g.tau ^ 2) + (s ^ 2 / (s ^ 2 + g.tau ^ 2)) ^ 2 * v_mu)) AS inner_, sum(w * ((y * g.tau ^ 2 + mu * s ^ 2) / (s ^ 2 + g.tau ^ 2) - y) ^ 2) AS gap FROM v, g GROUP BY 1, 2, 3),
f AS (SELECT *, sqrt(inner_ + gap - (pooled - y) ^ 2) AS sd FROM p)
--select SELECT unit_ref, y AS effect, s AS se, pooled, sd, pooled - 1.959963984540054 * sd AS lower, pooled + 1.959963984540054 * sd AS upper, s * s / (s * s + tau * tau) AS pooling_factor, tau, tau_lower, tau_upper FROM f, a""", "effect se pooled sd lower upper pooling_factor tau tau_lower tau_upper")
def hierarchical_pool(spark, d):
    u = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit_ref")).agg(F.avg("l_quantity").alias("effect"), (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return H.hierarchical_pool(u)


@query("numeric_bootstrap_bca")
def bootstrap_bca(spark, d):
    """The share of discounts in the worth of all lines."""
    l = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")  # noqa: E741
    return H.bootstrap_bca(l, ["l_orderkey", "l_linenumber"], {"off": F.col("l_extendedprice") * F.col("l_discount"), "worth": F.col("l_extendedprice")}, lambda off, worth: off / worth, replicates=200)


@query("survey_ordinal_logistic")
def ordinal_logistic(spark, d):
    """How order priority goes with the month and with being still open, in each market segment."""
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("survey"))
    o = A.table(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "O").cast("int").alias("is_open"))
    return O.ordinal_logistic(o.join(c, F.col("o_custkey") == F.col("c_custkey")), ("month", "is_open"))


@query("forecast_stl_decompose")
def stl_decompose(spark, d):
    """Monthly arrivals of each category, months without any filled with 0."""
    month = F.trunc(F.date_from_unix_date(F.col("opened").cast("int")), "month")
    n = _spells(spark, d).groupBy(F.col("category").alias("series"), month.alias("period_start")).agg(F.count(F.lit(1)).alias("n"))
    span = n.groupBy("series").agg(F.explode(F.sequence(F.min("period_start"), F.max("period_start"), F.expr("interval 1 month"))).alias("period_start"))
    full = span.join(n, ["series", "period_start"], "left").select("series", "period_start", F.coalesce("n", F.lit(0)).cast("double").alias("x"))
    return D.stl_decompose(full, "series", season=12)


# --- Local time ---------------------------------------------------------------------------------------


def _local(period: str, step: str) -> str:
    return f"""WITH e AS (SELECT o_orderdate::TIMESTAMP AS t FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'), n AS (SELECT date_trunc('{period}', (t AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS p, count(*) AS n FROM e GROUP BY 1),
w AS (SELECT unnest(generate_series(date_trunc('{period}', (TIMESTAMP '1996-01-01' AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'), TIMESTAMP '1998-12-31 18:00:00', INTERVAL {step})) AS p), b AS (SELECT p, ((p AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS a, (((p + INTERVAL {step}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS z FROM w)
--select SELECT b.p::DATE AS period_start, coalesce(n, 0) AS events, coalesce(n, 0) / (epoch(z - a) / 86400) AS per_day, epoch(z - a) / 86400 AS days, a >= TIMESTAMP '1996-01-01' AND z <= TIMESTAMP '1999-01-01' AS complete FROM b LEFT JOIN n ON n.p = b.p::DATE"""


def _order_times(spark, d):
    return A.table(spark, d, "orders").select(F.col("o_orderdate").alias("at"))


@query("reducer_local_weeks", _local("week", "7 DAY"), "per_day days")
def local_weeks(spark, d):
    return W.counts_by_period(_order_times(spark, d), "1996-01-01", "1999-01-01", "week", "America/New_York")


@query("reducer_local_quarters", _local("quarter", "3 MONTH"), "per_day days")
def local_quarters(spark, d):
    return W.counts_by_period(_order_times(spark, d), "1996-01-01", "1999-01-01", "quarter", "America/New_York")


# --- Credible intervals -------------------------------------------------------------------------------


@query("bayes_beta_binomial_intervals")
def beta_intervals(spark, d):
    return I.beta_credible(R.rate_observations(_spells(spark, d), "assignee_ref", _VERDICT))


@query("bayes_gamma_poisson_intervals")
def gamma_intervals(spark, d):
    return I.gamma_credible(_count_observations(spark, d))
