"""The registered queries over the star-schema tables, each with the SQL that it is held against.

The SQL is written on its own terms (correlated counts, recursion, plain joins) rather than after the DataFrame plans.  Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.functions import kernels as K
from tallystream.functions import statistics as S
from tallystream.functions import survival as V
from tallystream.operators import reducers as R
from tallystream.sources import streams as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
Z = "1.959963984540054"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles as they are compared: six places, twelve below a thousandth.  The operators themselves round nothing."""
    return df.select(*[F.when(F.abs(c) < 0.001, F.round(c, 12)).otherwise(F.round(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            with_, _, body = sql.rpartition("--select")
            replace = ", ".join(f"CASE WHEN abs({c}) < 0.001 THEN round({c}, 12) ELSE round({c}, 6) END AS {c}" for c in doubles.split())
            ORACLE_SQL[name] = f"{with_} SELECT * {f'REPLACE ({replace})' if replace else ''} FROM ({body.strip()}) AS result"
        return f

    return keep


_SPELLS = """
WITH RECURSIVE days AS (SELECT o_orderkey AS k, list_sort(list(DISTINCT l_shipdate::DATE)) AS ds FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate::DATE >= o_orderdate::DATE GROUP BY 1),
raw AS (SELECT o_orderkey AS request_ref, o_orderdate::DATE AS od, ds[1] AS closed, ds[2] AS replied, o_orderstatus AS st, o_orderpriority AS category, o_custkey % 20 AS assignee_ref
  FROM orders LEFT JOIN days ON k = o_orderkey WHERE o_orderdate < TIMESTAMP '2000-01-01'),
judged AS (SELECT *, CASE WHEN st = 'O' OR closed IS NULL OR closed >= DATE '2000-01-01' THEN 'open' WHEN st = 'P' AND request_ref % 10 = 0 THEN 'escalated' WHEN st = 'P' AND request_ref % 10 = 1 THEN 'withdrawn' ELSE 'resolved' END AS outcome FROM raw),
sp AS (SELECT request_ref, od - DATE '1970-01-01' AS opened, category, assignee_ref, outcome, od < DATE '1996-01-01' AS left_truncated, greatest(DATE '1996-01-01' - od, 0) AS entry,
  (CASE WHEN outcome <> 'open' THEN closed ELSE DATE '2000-01-01' END) - od AS leave, (CASE WHEN replied < DATE '2000-01-01' THEN replied ELSE DATE '2000-01-01' END) - od AS response, coalesce(replied < DATE '2000-01-01', false) AS answered
  FROM judged WHERE outcome = 'open' OR closed >= DATE '1996-01-01')"""
_MEMBERS = """
WITH RECURSIVE o AS (SELECT o_custkey AS m, min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS z, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1),
sp AS (SELECT m AS member_ref, a - DATE '1970-01-01' AS entered, n AS orders, 0 AS entry, (CASE WHEN z + 180 < DATE '2000-01-01' THEN z + 180 ELSE DATE '2000-01-01' END) - a AS leave, z + 180 < DATE '2000-01-01' AS event FROM o)"""


def _km(event: str, leave: str = "leave") -> str:
    return f""",
ar AS (SELECT * FROM sp WHERE {leave} > entry OR entry <= 0),
tt AS (SELECT DISTINCT {leave} AS t FROM ar WHERE {event}),
nn AS (SELECT t, count(*) FILTER (entry < t OR (t <= 0 AND entry <= 0)) AS at_risk, count(*) FILTER ({leave} = t AND {event}) AS events, count(*) FILTER ({leave} = t AND NOT ({event})) AS censored
  FROM tt JOIN ar ON {leave} >= t GROUP BY t),
ss AS (SELECT *, product(1 - events / at_risk) OVER w AS survival, sum(CASE WHEN events < at_risk THEN events / (at_risk * (at_risk - events)) ELSE 0 END) OVER w AS green FROM nn WHERE at_risk > 0 WINDOW w AS (ORDER BY t)),
km AS (SELECT t, at_risk, events, censored, survival, green, survival * exp(-{Z} * sqrt(green)) AS lower, least(1, survival * exp({Z} * sqrt(green))) AS upper FROM ss)"""


def _spells(spark, d):
    return A.request_spells(spark, d)


@query("reducer_request_spells", _SPELLS + " --select SELECT request_ref, opened, category, assignee_ref, outcome, left_truncated, entry, leave AS exit, response, answered FROM sp")
def _(spark, d):
    return _spells(spark, d)


@query("survival_km_resolution_curve", _SPELLS + _km("outcome = 'resolved'") + " --select SELECT * FROM km", "survival green lower upper")
def km_resolution(spark, d):
    return V.kaplan_meier(_spells(spark, d), "outcome = 'resolved'")


@query("survival_median_resolution_days", _SPELLS + _km("outcome = 'resolved'") + " --select SELECT min(t) FILTER (survival <= 0.5) AS median, min(t) FILTER (lower <= 0.5) AS lower, min(t) FILTER (upper <= 0.5) AS upper FROM km")
def _(spark, d):
    return V.quantile_time(km_resolution(spark, d))


@query("survival_sla_attainment", _SPELLS + _km("outcome = 'resolved'") + " --select SELECT 1 - arg_max(survival, t) AS attained, 1 - arg_max(upper, t) AS lower, 1 - arg_max(lower, t) AS upper FROM km WHERE t <= 90", "attained lower upper")
def _(spark, d):
    return V.attainment(km_resolution(spark, d), 90)


@query("survival_first_response_curve", _SPELLS + _km("answered", "response") + " --select SELECT * FROM km", "survival green lower upper")
def _(spark, d):
    s = _spells(spark, d)
    return V.kaplan_meier(s.drop("exit").withColumnRenamed("response", "exit"), "answered")


@query("survival_churn_curve", _MEMBERS + _km("event") + " --select SELECT * FROM km", "survival green lower upper")
def _(spark, d):
    return V.kaplan_meier(A.member_spells(spark, d), "event")


@query("survival_naive_vs_km_gap", _SPELLS + _km("outcome = 'resolved'") + """ --select SELECT avg(leave) FILTER (outcome = 'resolved') AS naive_mean, count(*) FILTER (outcome = 'resolved') AS n_closed,
  count(*) FILTER (outcome = 'open') AS n_open, (SELECT min(t) FILTER (survival <= 0.5) FROM km) AS km_median FROM sp""", "naive_mean")
def _(spark, d):
    s = _spells(spark, d)
    n = s.agg(F.avg(F.when(F.col("outcome") == "resolved", F.col("exit"))).alias("naive_mean"), F.count_if(F.col("outcome") == "resolved").alias("n_closed"), F.count_if(F.col("outcome") == "open").alias("n_open"))
    return n.join(F.broadcast(V.quantile_time(V.kaplan_meier(s, "outcome = 'resolved'")).select(F.col("median").alias("km_median"))))  # one row each


@query("survival_competing_risks_cif", _SPELLS + """,
ar AS (SELECT * FROM sp WHERE leave > entry OR entry <= 0), tt AS (SELECT DISTINCT leave AS t FROM ar WHERE outcome <> 'open'),
nn AS (SELECT t, count(*) FILTER (entry < t OR (t <= 0 AND entry <= 0)) AS at_risk, count(*) FILTER (leave = t AND outcome <> 'open') AS e, count(*) FILTER (leave = t AND outcome = 'resolved') AS e1,
  count(*) FILTER (leave = t AND outcome = 'escalated') AS e2, count(*) FILTER (leave = t AND outcome = 'withdrawn') AS e3 FROM tt JOIN ar ON leave >= t GROUP BY t),
ss AS (SELECT *, product(1 - e / at_risk) OVER (ORDER BY t) AS s FROM nn), bb AS (SELECT *, coalesce(lag(s) OVER (ORDER BY t), 1) AS b FROM ss),
ff AS (SELECT *, sum(b * e1 / at_risk) OVER w AS f1, sum(b * e2 / at_risk) OVER w AS f2, sum(b * e3 / at_risk) OVER w AS f3 FROM bb WINDOW w AS (ORDER BY t))
--select SELECT t, at_risk, 'resolved' AS cause, f1 AS incidence, s AS still_open FROM ff UNION ALL SELECT t, at_risk, 'escalated', f2, s FROM ff UNION ALL SELECT t, at_risk, 'withdrawn', f3, s FROM ff""", "incidence still_open")
def _(spark, d):
    return V.cumulative_incidence(_spells(spark, d), ("resolved", "escalated", "withdrawn"))


@query("survival_logrank_parts", _SPELLS + """,
ar AS (SELECT * FROM sp WHERE leave > entry OR entry <= 0), tt AS (SELECT DISTINCT leave AS t FROM ar WHERE outcome = 'resolved'),
nn AS (SELECT t, category, count(*) FILTER (entry < t OR (t <= 0 AND entry <= 0)) AS nj, count(*) FILTER (leave = t AND outcome = 'resolved') AS dj FROM tt JOIN ar ON leave >= t GROUP BY t, category),
al AS (SELECT t, sum(nj) AS n, sum(dj) AS dd FROM nn GROUP BY t)
--select SELECT category, sum(dj)::BIGINT AS observed, sum(dd * nj / n) AS expected, sum(CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1) * (nj / n) * (1 - nj / n) ELSE 0 END) AS variance FROM nn JOIN al USING (t) GROUP BY category""", "expected variance")
def _(spark, d):
    return V.logrank_parts(_spells(spark, d), "category", PRIORITIES, "outcome = 'resolved'")


_FLOW = _SPELLS + """,
months AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1999-12-01', INTERVAL 1 MONTH))::DATE AS period_start),
flow AS (SELECT period_start, (SELECT count(*) FROM sp WHERE DATE '1970-01-01' + opened::INT >= period_start AND DATE '1970-01-01' + opened::INT < period_start + INTERVAL 1 MONTH) AS arrivals,
  (SELECT count(*) FROM sp WHERE outcome <> 'open' AND DATE '1970-01-01' + (opened + leave)::INT >= period_start AND DATE '1970-01-01' + (opened + leave)::INT < period_start + INTERVAL 1 MONTH) AS terminals,
  (SELECT count(*) FROM sp WHERE DATE '1970-01-01' + opened::INT < period_start + INTERVAL 1 MONTH AND NOT (outcome <> 'open' AND DATE '1970-01-01' + (opened + leave)::INT < period_start + INTERVAL 1 MONTH)) AS backlog_end FROM months)"""


def _flow(spark, d):
    return R.flow_periods(_spells(spark, d), A.START, A.END)


@query("reducer_flow_periods", _FLOW + " --select SELECT period_start, arrivals, terminals, backlog_end, backlog_end - arrivals + terminals AS backlog_start FROM flow")
def _(spark, d):
    return _flow(spark, d)


def _arrivals(spark, d):
    return _flow(spark, d).select("period_start", F.col("arrivals").cast("double").alias("x"))


_SERIES = _FLOW + ", x AS (SELECT row_number() OVER (ORDER BY period_start) AS i, period_start, arrivals::DOUBLE AS x, abs(arrivals - lag(arrivals) OVER (ORDER BY period_start)) AS mr FROM flow), b AS (SELECT avg(x) AS mean, avg(mr) / 1.128 AS sigma, count(*) AS n FROM x)"


@query("spc_ewma_chart", _SERIES + """, z AS (SELECT i, 0.2 * x + 0.8 * mean AS z FROM x, b WHERE i = 1 UNION ALL SELECT x.i, 0.2 * x.x + 0.8 * z.z FROM z JOIN x ON x.i = z.i + 1)
--select SELECT period_start, x, z, mean - 2.962 * sigma * sqrt(0.2 / 1.8) AS lower, mean + 2.962 * sigma * sqrt(0.2 / 1.8) AS upper, abs(z - mean) > 2.962 * sigma * sqrt(0.2 / 1.8) AS signal FROM x JOIN z USING (i), b""", "z lower upper")
def _(spark, d):
    return S.ewma(_arrivals(spark, d))


@query("spc_cusum_chart", _SERIES + """, u AS (SELECT i, period_start, x, (x - mean) / sigma AS u FROM x, b), c AS (SELECT i, greatest(0, u - 0.5) AS hi, greatest(0, -u - 0.5) AS lo FROM u WHERE i = 1 UNION ALL
  SELECT u.i, greatest(0, c.hi + u.u - 0.5), greatest(0, c.lo - u.u - 0.5) FROM c JOIN u ON u.i = c.i + 1)
--select SELECT period_start, x, u, hi AS high, lo AS low, greatest(hi, lo) > 5 AS signal FROM u JOIN c USING (i)""", "u high low")
def _(spark, d):
    return S.cusum(_arrivals(spark, d))


@query("queueing_little_law_wait", _FLOW + " --select SELECT avg(backlog_end) AS l, avg(arrivals / date_diff('day', period_start, (period_start + INTERVAL 1 MONTH)::DATE)) AS rate, count(*) AS n, l / rate AS wait_days FROM flow", "l rate wait_days")
def _(spark, d):
    return S.little_law(_flow(spark, d))


@query("queueing_mg1_wait", _SPELLS + """ --select SELECT avg(leave) AS mean, var_samp(leave) AS var, count(*) AS n, 0.0005 * avg(leave) AS rho,
  CASE WHEN 0.0005 * avg(leave) < 1 THEN 0.0005 * (var_samp(leave) + avg(leave) * avg(leave)) / (2 * (1 - 0.0005 * avg(leave))) END AS wait FROM sp WHERE outcome <> 'open'""", "mean var rho wait")
def _(spark, d):
    return S.pollaczek_khinchine(_spells(spark, d).where("outcome <> 'open'"), 0.0005)


@query("queueing_backlog_projection", _FLOW + ", b AS (SELECT arg_max(backlog_end, period_start) AS b0 FROM flow) --select SELECT h::INT AS h, greatest(0, b0 + h * (40.0 - 55.5))::DOUBLE AS backlog FROM b, range(1, 13) AS r(h)", "backlog")
def _(spark, d):
    return S.backlog_projection(_flow(spark, d), 40.0, 55.5, 12)


@query("fairness_workload_gini", _SPELLS + """, l AS (SELECT assignee_ref, count(*) AS load FROM sp GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY load, assignee_ref) AS i, count(*) OVER () AS n FROM l)
--select SELECT n, 2.0 * sum(i * load) / (n * sum(load)) - (n + 1.0) / n AS gini, (sum(load) FILTER (i > n - ceil(n * 0.1))) / sum(load) AS top_share, sum(load)::BIGINT AS total FROM r GROUP BY n""", "gini top_share")
def _(spark, d):
    return S.gini(_spells(spark, d).groupBy(F.col("assignee_ref").alias("group_ref")).agg(F.count(F.lit(1)).alias("load")))


_RATES = _SPELLS + ", r AS (SELECT assignee_ref AS group_ref, count(*) FILTER (outcome = 'resolved' AND leave <= 365) AS successes, count(*) FILTER (outcome <> 'open' OR leave > 365) AS trials FROM sp GROUP BY 1)"
_VERDICT = "case when outcome <> 'open' or exit > 365 then outcome = 'resolved' and exit <= 365 end"


@query("reducer_rate_observations", _RATES + " --select SELECT * FROM r")
def _(spark, d):
    return R.rate_observations(_spells(spark, d), "assignee_ref", _VERDICT)


@query("bayes_beta_binomial_shrink", _RATES + """, q AS (SELECT *, successes / trials AS raw FROM r WHERE trials > 0), p AS (SELECT avg(raw) AS mu, var_samp(raw) - avg(raw) * (1 - avg(raw)) * avg(1.0 / trials) AS between_ FROM q),
s AS (SELECT mu, CASE WHEN between_ > 0 THEN greatest(0.001, mu * (1 - mu) / between_ - 1) ELSE 1e6 END AS k FROM p)
--select SELECT group_ref, successes, trials, raw, (successes + mu * k) / (trials + k) AS shrunk, trials / (trials + k) AS weight FROM q, s""", "raw shrunk weight")
def _(spark, d):
    return S.beta_shrink(R.rate_observations(_spells(spark, d), "assignee_ref", _VERDICT))


_COUNTS = _SPELLS + ", r AS (SELECT category AS group_ref, count(*) AS events, (DATE '2000-01-01' - DATE '1970-01-01') - min(opened) AS exposure_days FROM sp GROUP BY 1)"


def _count_observations(spark, d):
    return R.count_observations(_spells(spark, d), "category", 10957)


@query("reducer_count_observations", _COUNTS + " --select SELECT * FROM r")
def _(spark, d):
    return _count_observations(spark, d)


@query("bayes_gamma_poisson_shrink", _COUNTS + """, q AS (SELECT *, events / exposure_days AS raw FROM r), p AS (SELECT sum(events) / sum(exposure_days) AS mu, var_samp(raw) AS v, avg(1.0 / exposure_days) AS inv FROM q),
s AS (SELECT mu, mu / greatest(1e-9, v - mu * inv) AS rate FROM p) --select SELECT group_ref, events, exposure_days, raw, (mu * rate + events) / (rate + exposure_days) AS shrunk FROM q, s""", "raw shrunk")
def _(spark, d):
    return S.gamma_shrink(_count_observations(spark, d))


@query("reducer_member_spells", _MEMBERS + " --select SELECT member_ref, entered, orders, entry, leave AS exit, event FROM sp")
def _(spark, d):
    return A.member_spells(spark, d)


@query("reducer_roster_snapshot", _MEMBERS + " --select SELECT n_name AS stratum, count(*) AS n FROM sp JOIN customer ON c_custkey = member_ref JOIN nation ON n_nationkey = c_nationkey WHERE NOT event GROUP BY 1")
def _(spark, d):
    c, n = A.table(spark, d, "customer").select("c_custkey", "c_nationkey"), A.table(spark, d, "nation").select("n_nationkey", "n_name")
    m = A.member_spells(spark, d).join(c, F.col("member_ref") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.roster_snapshot(m.withColumnRenamed("n_name", "stratum"), "stratum")


_LEDGER = """WITH e AS (SELECT o_orderdate::DATE AS dt, round(o_totalprice * 100)::BIGINT AS amount, 'inflow' AS way, o_orderstatus AS st FROM orders UNION ALL
  SELECT o_orderdate::DATE, -round(l_extendedprice * l_discount * 100)::BIGINT, 'outflow', o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query("reducer_ledger_periods", _LEDGER + """, p AS (SELECT date_trunc('month', dt)::DATE AS period_start, coalesce(sum(amount) FILTER (st = 'F' AND way = 'inflow'), 0)::BIGINT AS inflow_minor, coalesce(-sum(amount) FILTER (st = 'F' AND way = 'outflow'), 0)::BIGINT AS outflow_minor,
  coalesce(sum(amount) FILTER (st <> 'F'), 0)::BIGINT AS expected_minor FROM e GROUP BY 1)
--select SELECT *, inflow_minor - outflow_minor AS net_minor, (sum(inflow_minor - outflow_minor) OVER (ORDER BY period_start))::BIGINT AS closing_minor FROM p""")
def _(spark, d):
    return R.ledger_periods(A.ledger_entries(spark, d))


_PART = """WITH e AS (SELECT user_id AS member_ref, ts AS dt, CASE event_type WHEN 'click' THEN 'attend' WHEN 'view' THEN 'read_receipt' WHEN 'signup' THEN 'rsvp' WHEN 'purchase' THEN 'volunteer_hours' WHEN 'error' THEN 'comment' ELSE 'other' END AS kind,
  CASE event_type WHEN 'purchase' THEN value ELSE 1 END AS weight, (props->>'$.k')::INT AS object_ref FROM events)"""


@query("reducer_participation_periods", _PART + """ --select SELECT date_trunc('week', dt)::DATE AS period_start, count(DISTINCT member_ref) FILTER (kind <> 'read_receipt') AS active_members, count(*) AS events, sum(weight) FILTER (kind <> 'read_receipt') AS total_weight FROM e GROUP BY 1""", "total_weight")
def _(spark, d):
    return R.participation_periods(A.participation(spark, d))


@query("reducer_engagement_features", _PART + """ --select SELECT member_ref, date_diff('day', max(dt)::DATE, DATE '2024-01-31') AS recency_days, count(*) FILTER (date_diff('day', dt::DATE, DATE '2024-01-31') <= 14) AS frequency_14d, count(DISTINCT kind) AS breadth,
  coalesce(sum(weight) FILTER (kind = 'volunteer_hours'), 0) AS volunteer_weight, date_diff('day', min(dt)::DATE, DATE '2024-01-31') AS tenure_days FROM e WHERE kind <> 'read_receipt' AND dt < TIMESTAMP '2024-01-31' GROUP BY 1""", "volunteer_weight")
def _(spark, d):
    return R.engagement_features(A.participation(spark, d), "2024-01-31")


def _pairs(spark, d):
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("object_ref"), F.col("l_suppkey").alias("member_ref"))


_EDGES = """WITH s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS m FROM lineitem), c AS (SELECT o, count(*) AS n FROM s GROUP BY o),
g AS (SELECT a.m AS a_ref, b.m AS b_ref, sum(1.0 / (n - 1)) AS weight, count(*) AS objects FROM s a JOIN s b ON a.o = b.o AND a.m < b.m JOIN c ON c.o = a.o GROUP BY 1, 2)"""


@query("reducer_interaction_edges", _EDGES + " --select SELECT * FROM g", "weight")
def _(spark, d):
    return R.interaction_edges(_pairs(spark, d))


@query("network_isolation_report", _EDGES + " --select SELECT n_name AS stratum, count(*) AS members, count(*) FILTER (s_suppkey NOT IN (SELECT a_ref FROM g UNION SELECT b_ref FROM g)) AS isolated FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
def _(spark, d):
    tied = R.tied_members(_pairs(spark, d)).select(F.col("member_ref").alias("s_suppkey"), F.lit(True).alias("tied"))
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("stratum"))
    s = A.table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(tied, "s_suppkey", "left").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("stratum").agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("tied").isNull()).alias("isolated"))


_BALLOTS = "WITH c AS (SELECT o_custkey AS v, o_orderpriority AS o, count(*) AS n FROM orders GROUP BY 1, 2), bal AS (SELECT v, o, dense_rank() OVER (PARTITION BY v ORDER BY n DESC) AS tier FROM c)"
_MATRIX = _BALLOTS + """, opt AS (SELECT DISTINCT o FROM c), vot AS (SELECT DISTINCT v FROM c), f AS (SELECT v, opt.o, coalesce(tier, 6) AS tier FROM vot CROSS JOIN opt LEFT JOIN bal USING (v, o)),
m AS (SELECT a.o AS a_ref, b.o AS b_ref, count(*) FILTER (a.tier < b.tier) AS votes FROM f a JOIN f b ON a.v = b.v AND a.o <> b.o GROUP BY 1, 2)"""


def _matrix(spark, d):
    return S.pairwise_matrix(A.ballots(spark, d), PRIORITIES)


@query("reducer_pairwise_results", _BALLOTS + """ --select SELECT a.v AS voter_ref, CASE WHEN a.tier <= b.tier THEN a.o ELSE b.o END AS winner_ref, CASE WHEN a.tier <= b.tier THEN b.o ELSE a.o END AS loser_ref, a.tier = b.tier AS drawn FROM bal a JOIN bal b ON a.v = b.v AND a.o < b.o""")
def _(spark, d):
    return R.pairwise_results(A.ballots(spark, d))


@query("voting_pairwise_matrix", _MATRIX + " --select SELECT * FROM m")
def _(spark, d):
    return _matrix(spark, d)


@query("voting_condorcet_winner", _MATRIX + " --select SELECT x.a_ref AS option_ref, count(*) FILTER (x.votes > y.votes) AS wins, count(*) FILTER (x.votes = y.votes) AS ties, count(*) FILTER (x.votes > y.votes) = 4 AS condorcet FROM m x JOIN m y ON x.a_ref = y.b_ref AND x.b_ref = y.a_ref GROUP BY 1")
def _(spark, d):
    return S.condorcet(_matrix(spark, d), 5)


@query("voting_schulze", _MATRIX.replace("WITH", "WITH RECURSIVE", 1) + """, l AS (SELECT x.a_ref AS a, x.b_ref AS b, CASE WHEN x.votes > y.votes THEN x.votes ELSE 0 END AS w FROM m x JOIN m y ON x.a_ref = y.b_ref AND x.b_ref = y.a_ref),
p AS (SELECT a, b, w, 1 AS n FROM l UNION SELECT p.a, l.b, least(p.w, l.w), p.n + 1 FROM p JOIN l ON l.a = p.b AND l.b <> p.a WHERE p.n < 4), best AS (SELECT a, b, max(w) AS w FROM p GROUP BY 1, 2)
--select SELECT x.a AS option_ref, count(*) FILTER (x.w > y.w)::INT AS wins FROM best x JOIN best y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def _(spark, d):
    return S.schulze(_matrix(spark, d), PRIORITIES)


@query("voting_borda", _MATRIX + " --select SELECT f.o AS option_ref, sum((SELECT count(*) + 0.0 FROM f g WHERE g.v = f.v AND g.tier > f.tier) + 0.5 * (SELECT count(*) FROM f g WHERE g.v = f.v AND g.o <> f.o AND g.tier = f.tier)) AS points FROM f GROUP BY 1", "points")
def _(spark, d):
    voters = A.table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("v"))
    return S.borda(_matrix(spark, d).crossJoin(F.broadcast(voters)), F.col("v"))  # one row


@query("voting_approval", _BALLOTS + f""", k AS (SELECT o AS option_ref, count(*) AS approvals, (SELECT count(*) FROM customer) AS n FROM bal GROUP BY 1)
--select SELECT option_ref, approvals, approvals / n AS share, (approvals / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} * sqrt(approvals / n * (1 - approvals / n) / n + {Z} * {Z} / (4.0 * n * n)) / (1 + {Z} * {Z} / n) AS lower,
  (approvals / n + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + {Z} * sqrt(approvals / n * (1 - approvals / n) / n + {Z} * {Z} / (4.0 * n * n)) / (1 + {Z} * {Z} / n) AS upper FROM k""", "share lower upper")
def _(spark, d):
    return S.approval(A.ballots(spark, d), A.table(spark, d, "customer").agg(F.count(F.lit(1)).alias("voters")))


@query("voting_turnout", "WITH v AS (SELECT DISTINCT o_custkey FROM orders) --select SELECT n_name AS stratum, count(*) AS eligible, count(o_custkey) AS voted, count(o_custkey) / count(*) AS turnout FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN v ON o_custkey = c_custkey GROUP BY 1", "turnout")
def _(spark, d):
    v = A.table(spark, d, "orders").select("o_custkey").distinct()
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("stratum"))
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(v, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("stratum").agg(F.count(F.lit(1)).alias("eligible"), F.count("o_custkey").alias("voted")).withColumn("turnout", F.col("voted") / F.col("eligible"))


_BINS = "WITH s AS (SELECT CAST(l_discount * 10 AS DECIMAL(12, 9)) AS p, (l_returnflag = 'R')::INT AS y, greatest(1, ceil(round(l_discount * 100, 9)))::INT AS bin FROM lineitem), b AS (SELECT bin, count(*) AS n, sum(y)::BIGINT AS hits, sum(p)::DOUBLE / count(*) AS mean_p, sum(y) / count(*) AS observed FROM s GROUP BY bin)"


@query("calibration_reliability_diagram", _BINS + f""" --select SELECT bin, n, hits, mean_p, observed, (observed + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} * sqrt(observed * (1 - observed) / n + {Z} * {Z} / (4.0 * n * n)) / (1 + {Z} * {Z} / n) AS lower,
  (observed + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + {Z} * sqrt(observed * (1 - observed) / n + {Z} * {Z} / (4.0 * n * n)) / (1 + {Z} * {Z} / n) AS upper FROM b""", "mean_p observed lower upper")
def _(spark, d):
    return S.score_bins(A.scores(spark, d), 10)


@query("calibration_brier_decomposition", _BINS + """, w AS (SELECT sum((p - y) * (p - y))::DOUBLE / count(*) AS brier, sum(y)::DOUBLE / count(*) AS base, count(*) AS total FROM s)
--select SELECT max(brier) AS brier, sum(n * (mean_p - observed) ^ 2) / max(total) AS reliability, sum(n * (observed - base) ^ 2) / max(total) AS resolution, max(base) * (1 - max(base)) AS uncertainty FROM b, w""", "brier reliability resolution uncertainty")
def _(spark, d):
    return S.brier_parts(A.scores(spark, d), 10)


_EQUAL = """WITH s AS (SELECT l_discount * 10 AS p, (l_returnflag = 'R')::INT AS y FROM lineitem), o AS (SELECT list(p ORDER BY p) AS ps FROM s),
e AS (SELECT list_append(list_sort(list_distinct(list_filter(list_transform(range(1, 10), lambda i: ps[1 + least(len(ps) - 1, round_even(i * len(ps) / 10, 0)::BIGINT)]), lambda x: x > 1e-12 AND x < 1 - 1e-12))), 1.0) AS es FROM (SELECT ps FROM o)),
b AS (SELECT least(len(list_filter(es, lambda x: x < p)) + 1, len(es))::INT AS bin, count(*) AS n, sum(p)::DOUBLE / count(*) AS mean_p, sum(y)::BIGINT AS hits, sum(y) / count(*) AS observed FROM s, e GROUP BY 1)"""


@query("calibration_reliability_equal_count", _EQUAL + f""" --select SELECT bin, n, hits, mean_p, observed, (observed + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} * sqrt(observed * (1 - observed) / n + {Z} * {Z} / (4.0 * n * n)) / (1 + {Z} * {Z} / n) AS lower,
  (observed + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) + {Z} * sqrt(observed * (1 - observed) / n + {Z} * {Z} / (4.0 * n * n)) / (1 + {Z} * {Z} / n) AS upper FROM b""", "mean_p observed lower upper")
def _(spark, d):
    return S.score_bins(A.scores(spark, d), 10, "equal_count")


@query("calibration_brier_equal_count", _EQUAL + """, w AS (SELECT sum((p - y) * (p - y))::DOUBLE / count(*) AS brier, sum(y)::DOUBLE / count(*) AS base, count(*) AS total FROM s)
--select SELECT max(brier) AS brier, sum(n * (mean_p - observed) ^ 2) / max(total) AS reliability, sum(n * (observed - base) ^ 2) / max(total) AS resolution, max(base) * (1 - max(base)) AS uncertainty FROM b, w""", "brier reliability resolution uncertainty")
def _(spark, d):
    return S.brier_parts(A.scores(spark, d), 10, "equal_count")


@query("calibration_auc", """WITH s AS (SELECT l_discount * 10 AS p, (l_returnflag = 'R')::INT AS y FROM lineitem), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM s)
--select SELECT ((sum(r) FILTER (y = 1)) - sum(y)::DOUBLE * (sum(y) + 1) / 2) / (sum(y)::DOUBLE * sum(1 - y)) AS auc, sum(y)::BIGINT AS positives, sum(1 - y)::BIGINT AS negatives FROM r""", "auc")
def _(spark, d):
    return S.auc(A.scores(spark, d))


@query("conformal_split_interval", """WITH r AS (SELECT abs(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag)) AS r FROM lineitem), o AS (SELECT round(r, 4) AS r, row_number() OVER (ORDER BY round(r, 4)) AS i, count(*) OVER () AS n FROM r), a AS (SELECT unnest([0.1, 0.05])::DOUBLE AS alpha)
--select SELECT alpha, max(n) AS n, max(ceil((n + 1) * (1 - alpha)))::BIGINT AS k, max(r) FILTER (i = ceil((n + 1) * (1 - alpha))) AS q FROM o, a GROUP BY alpha""", "q")
def _(spark, d):
    means = A.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.avg("l_extendedprice").alias("m"))
    r = A.table(spark, d, "lineitem").select("l_extendedprice", "l_returnflag").join(F.broadcast(means), F.col("l_returnflag") == F.col("f"))  # a row per flag
    return S.conformal_quantile(r.select(F.round(F.col("l_extendedprice") - F.col("m"), 4).alias("residual")), (0.1, 0.05))


def _two_years(spark, d, value):
    years = {1997: "ref", 1999: "cur"}
    x = A.table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'2000-01-01'")
    side = F.create_map(*[F.lit(v) for p in years.items() for v in p])[F.year("l_shipdate")]
    return x.select(side.alias("side"), value).where("side is not null")


_SIDES = "WITH v AS (SELECT CASE year(l_shipdate) WHEN 1997 THEN 'ref' WHEN 1999 THEN 'cur' END AS side, l_extendedprice AS x, (l_returnflag = 'R')::INT AS y FROM lineitem WHERE year(l_shipdate) IN (1997, 1999))"


@query("drift_psi", _SIDES + """, b AS (SELECT side, CASE WHEN x <= 10000 THEN 0 WHEN x <= 20000 THEN 1 WHEN x <= 40000 THEN 2 WHEN x <= 60000 THEN 3 ELSE 4 END AS bin FROM v), n AS (SELECT bin, count(*) FILTER (side = 'ref') AS ref, count(*) FILTER (side = 'cur') AS cur FROM b GROUP BY bin),
s AS (SELECT *, greatest(1e-6, ref / sum(ref) OVER ()) AS p, greatest(1e-6, cur / sum(cur) OVER ()) AS q FROM n) --select SELECT bin, ref, cur, (q - p) * ln(q / p) AS psi FROM s""", "psi")
def _(spark, d):
    return S.psi(_two_years(spark, d, F.col("l_extendedprice").alias("x")), [10000.0, 20000.0, 40000.0, 60000.0])


@query("drift_ks_test", _SIDES + """, c AS (SELECT DISTINCT x, count(*) FILTER (side = 'ref') OVER w / (count(*) FILTER (side = 'ref') OVER ()) AS a, count(*) FILTER (side = 'cur') OVER w / (count(*) FILTER (side = 'cur') OVER ()) AS b FROM v WINDOW w AS (ORDER BY x))
--select SELECT max(abs(a - b)) AS d, (SELECT count(*) FROM v WHERE side = 'ref') AS n_ref, (SELECT count(*) FROM v WHERE side = 'cur') AS n_cur FROM c""", "d")
def _(spark, d):
    return S.ks(_two_years(spark, d, F.col("l_extendedprice").alias("x")))


@query("drift_label_shift", _SIDES + f""", k AS (SELECT side, avg(y) AS p, count(*) AS n FROM v GROUP BY side), w AS (SELECT side, p, (p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) AS c, {Z} * sqrt(p * (1 - p) / n + {Z} * {Z} / (4.0 * n * n)) / (1 + {Z} * {Z} / n) AS h FROM k),
j AS (SELECT a.p AS pa, b.p AS pb, b.p - a.p - sqrt((b.p - (b.c - b.h)) ^ 2 + (a.c + a.h - a.p) ^ 2) AS lo, b.p - a.p + sqrt((b.c + b.h - b.p) ^ 2 + (a.p - (a.c - a.h)) ^ 2) AS hi FROM w a, w b WHERE a.side = 'ref' AND b.side = 'cur')
--select SELECT pa AS rate_ref, pb AS rate_cur, pb - pa AS difference, lo AS lower, hi AS upper, lo > 0 OR hi < 0 AS shifted FROM j""", "rate_ref rate_cur difference lower upper")
def _(spark, d):
    return S.label_shift(_two_years(spark, d, (F.col("l_returnflag") == "R").cast("int").alias("y")))


_LIKERT = "WITH r AS (SELECT n_name AS stratum, substr(o_orderpriority, 1, 1)::INT AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


def _responses(spark, d):
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("stratum"))
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return A.table(spark, d, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("value")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("stratum", "value")


@query("survey_likert_distribution", _LIKERT + " --select SELECT stratum, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, avg((value >= 4)::INT) AS top_box, avg((value <= 2)::INT) AS bottom_box FROM r GROUP BY 1", "q1 median q3 top_box bottom_box")
def _(spark, d):
    return S.likert(_responses(spark, d), "stratum", 4, 2)


@query("survey_cliffs_delta", _LIKERT + ", g AS (SELECT value, count(*) FILTER (right(stratum, 1) < '5') AS a, count(*) FILTER (right(stratum, 1) >= '5') AS b FROM r GROUP BY 1) --select SELECT sum(sign(x.value - y.value) * x.a * y.b) / ((SELECT sum(a) FROM g) * (SELECT sum(b) FROM g)) AS delta, (SELECT sum(a) FROM g)::BIGINT AS n_a, (SELECT sum(b) FROM g)::BIGINT AS n_b FROM g x, g y", "delta")
def _(spark, d):
    return S.cliffs_delta(_responses(spark, d).select(F.when(F.substring("stratum", -1, 1) < "5", "a").otherwise("b").alias("side"), "value"))


@query("survey_design_effect", " --select SELECT count(*) * sum(l_quantity * l_quantity) / (sum(l_quantity) * sum(l_quantity)) AS deff, count(*) AS n FROM lineitem", "deff")
def _(spark, d):
    return S.design_effect(A.table(spark, d, "lineitem").select(F.col("l_quantity").alias("w")))


@query("privacy_k_anonymity_suppress", "WITH t AS (SELECT n_name AS stratum, c_mktsegment AS segment, count(*) AS n, avg(c_acctbal) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2) --select SELECT stratum, segment, CASE WHEN n >= 10 THEN n END AS n, CASE WHEN n >= 10 THEN balance END AS balance, n < 10 AS suppressed FROM t", "balance")
def _(spark, d):
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("stratum"))
    c = A.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return S.suppress_small(c.groupBy("stratum", F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("balance")), "n", ("balance",), 10)


@query("audit_benford_digits", f"""WITH a AS (SELECT substr((round(l_extendedprice * 100)::BIGINT)::VARCHAR, 1, 1)::INT AS digit FROM lineitem WHERE l_extendedprice > 0), n AS (SELECT g::INT AS digit, (SELECT count(*) FROM a WHERE a.digit = g) AS n, (SELECT count(*) FROM a) AS total FROM range(1, 10) AS r(g)),
e AS (SELECT *, n / total AS p, log10(1 + 1.0 / digit) AS expected FROM n)
--select SELECT digit, n, p AS share, expected, (p + {Z} * {Z} / (2 * total)) / (1 + {Z} * {Z} / total) - {Z} * sqrt(p * (1 - p) / total + {Z} * {Z} / (4.0 * total * total)) / (1 + {Z} * {Z} / total) AS lower,
  (p + {Z} * {Z} / (2 * total)) / (1 + {Z} * {Z} / total) + {Z} * sqrt(p * (1 - p) / total + {Z} * {Z} / (4.0 * total * total)) / (1 + {Z} * {Z} / total) AS upper, (n - expected * total) ^ 2 / (expected * total) AS chi2_part FROM e""", "share expected lower upper chi2_part")
def _(spark, d):
    return S.benford(A.table(spark, d, "lineitem").select(F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount")))


@query("forecast_seasonal_naive", _SERIES + """, r AS (SELECT sqrt(avg((x - l) ^ 2)) AS rmse FROM (SELECT x, lag(x, 12) OVER (ORDER BY i) AS l FROM x))
--select SELECT h::INT AS h, x.x AS point, rmse * sqrt(1 + floor((h - 1) / 12)) AS sd FROM range(1, 19) AS g(h), b, r, x WHERE x.i = n + h - 12 * ceil(h / 12)""", "point sd")
def _(spark, d):
    return S.seasonal_naive(_arrivals(spark, d), 12, 18)


_ARMS = """WITH t AS (SELECT o_custkey AS member_ref, min(o_orderdate) AS dt, (o_custkey % 2)::INT AS arm, max((o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')::INT) AS y FROM orders GROUP BY o_custkey)"""


def _trials(spark, d):
    hit = ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")).cast("int")
    return A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("member_ref")).agg(F.min("o_orderdate").alias("at"), F.max(hit).alias("y")).withColumn("arm", (F.col("member_ref") % 2).cast("int"))


@query("experiments_arm_counts", _ARMS + " --select SELECT arm, count(*) AS exposures, sum(y)::BIGINT AS conversions, avg(y) AS rate, (count(*) - (SELECT count(*) FROM t) / 2) ^ 2 / ((SELECT count(*) FROM t) / 2) AS srm_chi2_part FROM t GROUP BY arm", "rate srm_chi2_part")
def _(spark, d):
    n = _trials(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("exposures"), F.sum("y").alias("conversions"), F.avg("y").alias("rate"))
    half = F.sum("exposures").over(Window.partitionBy()) / 2
    return n.withColumn("srm_chi2_part", (F.col("exposures") - half) ** 2 / half)


@query("experiments_sequential_e_process", _ARMS + """, s AS (SELECT member_ref, row_number() OVER w AS t, sum(CASE WHEN arm = 1 THEN 2.0 * y ELSE -2.0 * y END) OVER w AS s FROM t WINDOW w AS (ORDER BY dt, member_ref)), e AS (SELECT *, sqrt(50.0 / (4.0 * t + 50)) * exp(least(700, s * s / (2 * (4.0 * t + 50)))) AS e FROM s)
--select SELECT member_ref, t, s, e, e >= 20 AS stop FROM e""", "s e")
def _(spark, d):
    return S.e_process(_trials(spark, d), 50.0)


@query("segmentation_rfm", "WITH d AS (SELECT max(o_orderdate)::DATE AS now FROM orders) --select SELECT o_custkey AS member_ref, date_diff('day', max(o_orderdate)::DATE, max(now)) AS recency, count(*) AS frequency, (sum(round(o_totalprice * 100)))::BIGINT AS monetary_minor FROM orders, d GROUP BY 1")
def _(spark, d):
    o = A.table(spark, d, "orders")
    now = o.agg(F.max(F.to_date("o_orderdate")).alias("now"))
    m = o.groupBy(F.col("o_custkey").alias("member_ref")).agg(F.max(F.to_date("o_orderdate")).alias("last"), F.count(F.lit(1)).alias("frequency"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("monetary_minor"))
    return m.crossJoin(F.broadcast(now)).select("member_ref", F.date_diff("now", "last").alias("recency"), "frequency", "monetary_minor")  # one row


@query("text_near_duplicate_candidates", r"""WITH q AS (SELECT item_id AS q, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM benchmark), dd AS (SELECT doc_id AS d, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS w FROM documents),
a AS (SELECT q, len(w) AS n, unnest(w) AS t FROM q), b AS (SELECT d, len(w) AS n, unnest(w) AS t FROM dd), c AS (SELECT q, d, count(*) AS k, max(a.n) AS na, max(b.n) AS nb FROM a JOIN b USING (t) GROUP BY 1, 2)
--select SELECT q, d, k / (na + nb - k) AS jaccard FROM c WHERE k / (na + nb - k) >= 0.2""", "jaccard")
def _(spark, d):
    return S.jaccard_candidates(A.table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text"), A.table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text"), 0.2)


@query("relational_trending_groups", " --select SELECT * FROM (SELECT n_name AS group_ref, count(*) AS members, max(c_custkey) AS newest FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY members DESC, newest DESC, group_ref LIMIT 8)")
def _(spark, d):
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("group_ref"))
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("group_ref").agg(F.count(F.lit(1)).alias("members"), F.max("c_custkey").alias("newest")).orderBy(F.desc("members"), F.desc("newest"), "group_ref").limit(8)


@query("relational_groups_with_member_counts", " --select SELECT n_nationkey AS group_ref, n_name AS name, count(c_custkey) AS approved FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1, 2")
def _(spark, d):
    c = A.table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    n = A.table(spark, d, "nation")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy(F.col("n_nationkey").alias("group_ref"), F.col("n_name").alias("name")).agg(F.count("c_custkey").alias("approved"))


@query("relational_events_with_registrations", " --select SELECT o_orderkey AS event_ref, count(l_orderkey) AS registrations, coalesce(bool_or(l_returnflag IN ('A', 'R')), false) AS declared FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    l = A.table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")  # noqa: E741
    o = A.table(spark, d, "orders").select("o_orderkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.groupBy(F.col("o_orderkey").alias("event_ref")).agg(F.count("l_orderkey").alias("registrations"), F.coalesce(F.bool_or(F.col("l_returnflag").isin("A", "R")), F.lit(False)).alias("declared"))


@query("relational_member_feed", " --select SELECT * FROM (SELECT o_orderkey AS item_ref, c_name AS member, n_name AS group_name, o_totalprice AS price FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 AND (o_orderpriority ILIKE '%urgent%' OR o_orderpriority ILIKE '%high%') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20)", "price")
def _(spark, d):
    n = A.table(spark, d, "nation").where("n_regionkey = 1").select("n_nationkey", F.col("n_name").alias("group_name"))
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("member"), "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = A.table(spark, d, "orders").where(F.col("o_orderpriority").ilike("%urgent%") | F.col("o_orderpriority").ilike("%high%")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50).select(F.col("o_orderkey").alias("item_ref"), "member", "group_name", F.col("o_totalprice").alias("price"))


@query("relational_leaderboard", """WITH m AS (SELECT c_nationkey AS k, count(*) AS members FROM customer WHERE c_acctbal > 0 GROUP BY 1), e AS (SELECT c_nationkey AS k, count(*) AS events, count(*) FILTER (o_orderstatus = 'F') AS solved, avg((o_orderstatus <> 'O')::INT) AS rate
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), s AS (SELECT n_name AS name, coalesce(members, 0) AS members, 40 * coalesce(events, 0) + 5 * coalesce(members, 0) + 10 * coalesce(solved, 0) + round(coalesce(rate, 0) * 200)::BIGINT AS score FROM nation LEFT JOIN m ON m.k = n_nationkey LEFT JOIN e ON e.k = n_nationkey)
--select SELECT name, members, score, row_number() OVER (ORDER BY score DESC, members DESC, name) AS rank FROM s""")
def _(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    m = c.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k1")).agg(F.count(F.lit(1)).alias("members"))
    e = A.table(spark, d, "orders").select("o_custkey", "o_orderstatus").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("k2")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("o_orderstatus") == "F").alias("solved"), F.avg((F.col("o_orderstatus") != "O").cast("int")).alias("rate")
    )
    s = A.table(spark, d, "nation").join(m, F.col("n_nationkey") == F.col("k1"), "left").join(e, F.col("n_nationkey") == F.col("k2"), "left")
    z = lambda x: F.coalesce(x, F.lit(0))
    s = s.select(F.col("n_name").alias("name"), z("members").alias("members"), (40 * z("events") + 5 * z("members") + 10 * z("solved") + F.round(z("rate") * 200).cast("long")).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("members"), "name")))


@query("relational_latest_runs", " --select SELECT o_custkey AS scope, o_orderkey AS run_ref, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate").withColumn("i", F.row_number().over(w)).where("i = 1")
    return o.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("run_ref"), F.col("o_orderstatus").alias("status"))


@query("queueing_erlang_c_staffing", _FLOW.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + """, a AS (SELECT avg(arrivals / date_diff('day', period_start, (period_start + INTERVAL 1 MONTH)::DATE)) * 2.5 AS load FROM flow),
b AS (SELECT 0 AS c, 1.0::DOUBLE AS b, load FROM a UNION ALL SELECT c + 1, load * b / (c + 1 + load * b), load FROM b WHERE c < 20),
w AS (SELECT c, load, CASE WHEN load < c THEN b / (1 - load / c * (1 - b)) ELSE 1 END AS p FROM b WHERE c > 0), s AS (SELECT *, CASE WHEN load < c THEN 1 - p * exp(-(c - load) * 0.5 / 2.5) ELSE 0 END AS served FROM w)
--select SELECT load, c::INT AS servers, load / c AS utilisation, p AS p_wait, served, (SELECT min(c) FROM s WHERE served >= 0.8)::INT AS required FROM s""", "load utilisation p_wait served")
def _(spark, d):
    rate = S.little_law(_flow(spark, d)).select((F.col("rate") * 2.5).alias("load"))
    return K.staffing(rate, 20, 0.5, 0.8, 2.5)


@query("calibration_isotonic", """WITH s AS (SELECT l_linestatus AS model, round(l_discount * 10, 6) AS p, count(*) AS n, sum((l_returnflag = 'R')::INT)::BIGINT AS hits FROM lineitem GROUP BY 1, 2),
m AS (SELECT a.model, a.p AS i, b.p AS j, c.p AS k, sum(d.hits) / sum(d.n) AS v FROM s a JOIN s b ON b.model = a.model AND b.p <= a.p JOIN s c ON c.model = a.model AND c.p >= a.p JOIN s d ON d.model = a.model AND d.p BETWEEN b.p AND c.p GROUP BY 1, 2, 3, 4), lo AS (SELECT model, i, j, min(v) AS v FROM m GROUP BY 1, 2, 3)
--select SELECT model, p, n, hits, (SELECT max(v) FROM lo WHERE lo.model = s.model AND i = p) AS fitted FROM s""", "p fitted")
def _(spark, d):
    x = A.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("model"), F.round(F.col("l_discount") * 10, 6).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return K.isotonic(x, "model")


@query("pairwise_elo_update")
def elo_update(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("league"))
    l = A.table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))  # noqa: E741
    two = l.groupBy("l_orderkey").agg(F.max_by("l_suppkey", F.struct("q", "l_suppkey")).alias("winner_ref"), F.min_by("l_suppkey", F.struct("q", "l_suppkey")).alias("loser_ref"), (F.max("q") == F.min("q")).alias("drawn"))
    g = two.where("winner_ref <> loser_ref").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return K.elo(g.select("league", F.col("o_orderkey").alias("game"), F.to_date("o_orderdate").alias("at"), "winner_ref", "loser_ref", "drawn"))


@query("text_tfidf_similarity", r"""WITH qw AS (SELECT item_id AS q, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS t FROM benchmark), dw AS (SELECT doc_id AS d, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS t FROM documents),
qc AS (SELECT q, t, count(*) AS c FROM qw GROUP BY 1, 2), dc AS (SELECT d, t, count(*) AS c FROM dw GROUP BY 1, 2), f AS (SELECT t, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY t),
qv AS (SELECT q, t, (1 + ln(c)) * idf AS w FROM qc JOIN f USING (t)), dv AS (SELECT d, t, (1 + ln(c)) * idf AS w FROM dc JOIN f USING (t)), qn AS (SELECT q, sqrt(sum(w * w)) AS n FROM qv GROUP BY 1), dn AS (SELECT d, sqrt(sum(w * w)) AS n FROM dv GROUP BY 1),
s AS (SELECT qv.q, dv.d, sum(qv.w * dv.w) / (any_value(qn.n) * any_value(dn.n)) AS score FROM qv JOIN dv USING (t) JOIN qn ON qn.q = qv.q JOIN dn ON dn.d = dv.d GROUP BY 1, 2), r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, d) AS rank, d, score FROM s)
--select SELECT * FROM r WHERE rank <= 5""", "score")
def _(spark, d):
    return K.tfidf_similarity(A.table(spark, d, "benchmark").select(F.col("item_id").alias("q"), "text"), A.table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text"), 5)


@query("relational_request_queue", " --select SELECT o_orderkey AS request_ref, c_name AS member, status_rank FROM (SELECT o_orderkey, o_custkey, o_orderdate, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status_rank FROM orders) LEFT JOIN customer ON c_custkey = o_custkey WHERE status_rank < 2 ORDER BY status_rank, o_orderdate, o_orderkey LIMIT 100")
def _(spark, d):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)  # the enum's order, not the text's
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", rank.alias("status_rank")).where("status_rank < 2")
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("member"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").orderBy("status_rank", "o_orderdate", "o_orderkey").limit(100).select(F.col("o_orderkey").alias("request_ref"), "member", "status_rank")


@query("relational_memberships_with_counts", " --select SELECT c_custkey AS member_ref, n_name AS group_name, (SELECT count(*) FROM customer x WHERE x.c_nationkey = customer.c_nationkey AND x.c_acctbal > 0) AS members FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'")
def _(spark, d):
    c = A.table(spark, d, "customer")
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("group_name"))
    sizes = c.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    mine = c.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(sizes, F.col("c_nationkey") == F.col("k"), "left")
    return mine.select(F.col("c_custkey").alias("member_ref"), "group_name", F.coalesce("m", F.lit(0)).alias("members"))


@query("relational_members_without_requests", " --select SELECT c_custkey AS member_ref FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def _(spark, d):
    return A.table(spark, d, "customer").select(F.col("c_custkey").alias("member_ref")).join(A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("member_ref")), "member_ref", "left_anti")


@query("relational_health_by_status", " --select SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*) AS runs FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority), ())")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"))
    return o.groupingSets([["status"], ["status", "kind"], []], "status", "kind").agg(F.count(F.lit(1)).alias("runs"))


@query("reducer_due_spells", """ --select SELECT o_orderkey AS due_ref, o_orderdate::DATE AS due_at, CASE WHEN s < DATE '2000-01-01' THEN s - o_orderdate::DATE ELSE DATE '2000-01-01' - o_orderdate::DATE END AS duration_days, coalesce(s < DATE '2000-01-01', false) AS event_observed,
  CASE WHEN s < DATE '2000-01-01' THEN 'none' WHEN o_orderstatus = 'P' THEN 'competing' ELSE 'administrative' END AS censoring FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate::DATE) AS s FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '2000-01-01'""")
def _(spark, d):
    s = A.table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("s"))
    end, due = F.lit(A.END).cast("date"), F.to_date("o_orderdate")
    paid = F.coalesce(F.col("s") < end, F.lit(False))
    o = A.table(spark, d, "orders").where(F.col("o_orderdate") < F.lit(A.END).cast("timestamp_ntz")).join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("due_ref"), due.alias("due_at"), F.date_diff(F.when(paid, F.col("s")).otherwise(end), due).alias("duration_days"), paid.alias("event_observed"),
        F.when(paid, "none").when(F.col("o_orderstatus") == "P", "competing").otherwise("administrative").alias("censoring"),
    )


def _by_nation(spark, d, votes):
    """Each nation decides for itself: decision_ref of a vote is its voter's nation."""
    c = A.table(spark, d, "customer").select(F.col("c_custkey").alias("voter_ref"), F.col("c_nationkey").cast("string").alias("decision_ref"))
    return votes.join(c, "voter_ref")


@query("voting_stv")
def single_transferable_vote(spark, d):
    return K.stv(_by_nation(spark, d, A.ballots(spark, d)), 2, "decision_ref")


@query("pairwise_bradley_terry")
def bradley_terry(spark, d):
    return K.bradley_terry(_by_nation(spark, d, R.pairwise_results(A.ballots(spark, d))), "decision_ref")


@query("changepoint_detect_level_shifts")
def level_shifts(spark, d):
    months = _spells(spark, d).groupBy(F.col("category").alias("series"), F.trunc(F.date_from_unix_date(F.col("opened").cast("int")), "month").alias("period_start")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return K.level_shifts(months, "series")
