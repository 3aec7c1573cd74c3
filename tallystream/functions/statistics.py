"""Control charts, queues, shrinkage, experiments, calibration, drift, voting, surveys, text, disclosure and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z = 1.959963984540054


def _all():
    """One frame over all rows; used on tables bounded by periods, bins, groups or options only."""
    return Window.partitionBy()


def position(edges: Column, value: Column, most: int) -> Column:
    """How many of the sorted edges (most at most) are below a value, by halving."""
    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s.lo + s.hi) / 2).cast("int")
        return F.when(s.lo >= s.hi, s).when(F.get(edges, middle) < value, F.struct((middle + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), middle.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.coalesce(F.size(edges), F.lit(0)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(most.bit_length())), start, step).lo


def running_sums(rows: DataFrame, key: str, order: tuple[str, ...], sums: dict[str, Column], parts: int = 512) -> DataFrame:
    """rows with running sums (name: value) in the order of the number key and then of order, the row itself included.

    Rows are dealt into buckets at approximate quantiles of key; sums run within buckets and are shifted by the totals of the buckets
    before.  Equal keys share a bucket.  Only the table of buckets, `parts` rows at most, is seen by one task.
    """
    edges = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("edges"))
    dealt = rows.crossJoin(F.broadcast(edges)).withColumn("_bucket", position(F.col("edges"), F.col(key), parts)).drop("edges")  # one row
    totals = dealt.groupBy("_bucket").agg(*[F.sum(v).alias(f"_{k}") for k, v in sums.items()])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(F.col("_bucket"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums])
    within = Window.partitionBy("_bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(shift), "_bucket")
    return out.select(*rows.columns, *[(F.sum(v).over(within) + F.col(f"_{k}")).alias(k) for k, v in sums.items()])


def order_statistics(values: DataFrame, by: str, probs: tuple[float, ...], parts: int = 256) -> DataFrame:
    """(by, n, quantiles): exact quantiles of x in each group, with linear interpolation between neighbours; a null x takes no part.

    Distinct values are counted and dealt into buckets at approximate quantiles of their group; only the buckets that hold a wanted rank are put in order, each in its own task.
    """
    counts = values.where("x is not null").groupBy(by, "x").agg(F.count(F.lit(1)).alias("m"))
    whole = values.where("x is not null").groupBy(by).agg(F.percentile_approx("x", [i / parts for i in range(1, parts)], 20 * parts).alias("edges"), F.count(F.lit(1)).alias("n"))
    dealt = counts.join(whole, by).withColumn("bucket", position(F.col("edges"), F.col("x"), parts)).select(by, "x", "m", "n", "bucket")
    totals = dealt.groupBy(by, "bucket").agg(F.sum("m").alias("held"), F.max("n").alias("n"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # parts rows a group
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), place(p).alias("at"), e(place(p)).cast("long").alias("rank")) for i, p in enumerate(probs) for e in (F.floor, F.ceil)])
    wanted = totals.withColumn("before", before).select(by, "bucket", "before", "held", F.explode(ranks).alias("r")).where((F.col("r.rank") >= F.col("before")) & (F.col("r.rank") < F.col("before") + F.col("held")))
    wanted = wanted.groupBy(by, "bucket", "before").agg(F.collect_list("r").alias("rs"))
    run = Window.partitionBy(by, "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = dealt.join(wanted, [by, "bucket"]).withColumn("upto", F.col("before") + F.sum("m").over(run))
    hit = held.select(by, "n", "x", F.explode(F.filter("rs", lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("m")))).alias("r"))
    mixed = hit.groupBy(by, "r.i").agg(F.max("n").alias("n"), F.max("r.at").alias("at"), F.min_by("x", "r.rank").alias("lo"), F.max_by("x", "r.rank").alias("hi"), F.min("r.rank").alias("rank"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.col("rank"))
    return mixed.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda q: q["v"]).alias("quantiles"))


def wilson(x: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's 95 % interval of a proportion."""
    p, z2 = x / n, Z * Z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return centre - half, centre + half


# --- Control charts (series: period_start, x; bounded by the number of periods) --------------------


def ewma(series: DataFrame, lam: float = 0.2, limit: float = 2.962) -> DataFrame:
    """z_t = lam x_t + (1 - lam) z_(t-1) from the mean, with limits from the mean moving range."""
    w = Window.orderBy("period_start")
    s = series.withColumn("i", F.row_number().over(w)).withColumn("mr", F.abs(F.col("x") - F.lag("x").over(w)))
    s = s.withColumn("mean", F.avg("x").over(_all())).withColumn("sigma", F.avg("mr").over(_all()) / 1.128)
    past = F.collect_list("x").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    z = F.aggregate(past, F.col("mean"), lambda z, x: lam * x + (1 - lam) * z)
    half = limit * F.col("sigma") * (lam / (2 - lam)) ** 0.5
    return s.withColumn("z", z).select("period_start", "x", "z", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"), (F.abs(F.col("z") - F.col("mean")) > half).alias("signal"))


def cusum(series: DataFrame, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Two-sided tabular CUSUM of standardised values; C_t = T_t - min(0, min T_s) with running sums T."""
    w = Window.orderBy("period_start")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = series.withColumn("mr", F.abs(F.col("x") - F.lag("x").over(w)))
    s = s.withColumn("u", (F.col("x") - F.avg("x").over(_all())) / (F.avg("mr").over(_all()) / 1.128))
    for side, v in (("high", F.col("u") - k), ("low", -F.col("u") - k)):
        s = s.withColumn("t", F.sum(v).over(run)).withColumn(side, F.col("t") - F.least(F.lit(0.0), F.min("t").over(run)))
    return s.select("period_start", "x", "u", "high", "low", (F.greatest("high", "low") > h).alias("signal"))


def backlog_projection(periods: DataFrame, arrivals: float, capacity: float, horizon: int) -> DataFrame:
    """b_h = max(0, b_(h-1) + arrivals - capacity) from the last backlog."""
    last = periods.agg(F.max_by("backlog_end", "period_start").alias("b0"))
    steps = last.select("b0", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    return steps.select("h", F.greatest(F.lit(0.0), F.col("b0") + F.col("h") * (arrivals - capacity)).alias("backlog"))


def little_law(periods: DataFrame) -> DataFrame:
    days = F.date_diff(F.add_months("period_start", 1), F.col("period_start"))
    return periods.agg(F.avg("backlog_end").alias("l"), F.avg(F.col("arrivals") / days).alias("rate"), F.count(F.lit(1)).alias("n")).withColumn("wait_days", F.col("l") / F.col("rate"))


def pollaczek_khinchine(spells: DataFrame, rate: float) -> DataFrame:
    """M/G/1 wait from the service times of closed spells and an arrival rate."""
    m = spells.agg(F.avg("exit").alias("mean"), F.var_samp("exit").alias("var"), F.count(F.lit(1)).alias("n")).withColumn("rho", rate * F.col("mean"))
    return m.withColumn("wait", F.when(F.col("rho") < 1, rate * (F.col("var") + F.col("mean") * F.col("mean")) / (2 * (1 - F.col("rho")))))


def gini(loads: DataFrame) -> DataFrame:
    """Gini of (group_ref, load), and the share of the top tenth."""
    w = Window.orderBy("load", "group_ref")
    r = loads.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(_all()))
    top = F.sum(F.when(F.col("i") > F.col("n") - F.ceil(F.col("n") * 0.1), F.col("load")))
    return r.groupBy("n").agg((2 * F.sum(F.col("i") * F.col("load")) / (F.max("n") * F.sum("load")) - (F.max("n") + 1) / F.max("n")).alias("gini"), (top / F.sum("load")).alias("top_share"), F.sum("load").alias("total"))


# --- Rates ----------------------------------------------------------------------------------------


def beta_shrink(rates: DataFrame) -> DataFrame:
    """Beta-binomial shrinkage of (group_ref, successes, trials) towards the moments prior."""
    r = rates.where("trials > 0").withColumn("raw", F.col("successes") / F.col("trials"))
    prior = r.agg(F.avg("raw").alias("mu"), F.var_samp("raw").alias("v"), F.avg(1 / F.col("trials")).alias("inv"))
    prior = prior.withColumn("between", F.col("v") - F.col("mu") * (1 - F.col("mu")) * F.col("inv")).withColumn(
        "strength", F.when(F.col("between") > 0, F.greatest(F.lit(0.001), F.col("mu") * (1 - F.col("mu")) / F.col("between") - 1)).otherwise(F.lit(1e6))
    )
    j = r.crossJoin(F.broadcast(prior))  # one row
    return j.select("group_ref", "successes", "trials", "raw", ((F.col("successes") + F.col("mu") * F.col("strength")) / (F.col("trials") + F.col("strength"))).alias("shrunk"), (F.col("trials") / (F.col("trials") + F.col("strength"))).alias("weight"))


def gamma_shrink(counts: DataFrame, posterior: bool = False) -> DataFrame:
    """Gamma-Poisson shrinkage of (group_ref, events, exposure_days) towards the moments prior; with posterior also its parameters shape and rate."""
    r = counts.where("exposure_days > 0").withColumn("raw", F.col("events") / F.col("exposure_days"))
    prior = r.agg((F.sum("events") / F.sum("exposure_days")).alias("mu"), F.var_samp("raw").alias("v"), F.avg(1 / F.col("exposure_days")).alias("inv"))
    prior = prior.withColumn("rate", F.col("mu") / F.greatest(F.lit(1e-9), F.col("v") - F.col("mu") * F.col("inv"))).withColumn("shape", F.col("mu") * F.col("rate"))
    shape, rate = F.col("shape") + F.col("events"), F.col("rate") + F.col("exposure_days")
    more = [shape.alias("shape"), rate.alias("rate")] if posterior else []
    return r.crossJoin(F.broadcast(prior)).select("group_ref", "events", "exposure_days", "raw", (shape / rate).alias("shrunk"), *more)  # one row


def e_process(trials: DataFrame, rho: float, alpha: float = 0.05) -> DataFrame:
    """Normal-mixture e-process over trials (member_ref, at, arm, y) in the order of first exposure, halves per arm."""
    psi = F.when(F.col("arm") == 1, F.col("y") / 0.5).otherwise(-F.col("y") / 0.5)
    proxy = ((1 / 0.5 + 1 / 0.5) / 2) ** 2
    t = running_sums(trials.withColumn("_at", F.unix_micros(F.col("at").cast("timestamp"))), "_at", ("member_ref",), {"s": psi, "t": F.lit(1)}).withColumn("v", F.col("t") * proxy)
    e = F.sqrt(rho / (F.col("v") + rho)) * F.exp(F.least(F.lit(700.0), F.col("s") * F.col("s") / (2 * (F.col("v") + rho))))
    return t.withColumn("e", e).select("member_ref", "t", "s", "e", (F.col("e") >= 1 / alpha).alias("stop"))


# --- Calibration, conformal, drift ----------------------------------------------------------------


def equal_count_edges(scores: DataFrame, bins: int) -> DataFrame:
    """One row (edges): the upper edges of bins with equally many scores, the last one 1: of n scores in order, those at place round(i * n / bins) from 0, equal ones once.

    Counts per distinct score come first, in buckets.
    """
    c = running_sums(scores.groupBy("p").agg(F.count(F.lit(1)).alias("m")), "p", (), {"upto": F.col("m")})
    c = c.crossJoin(F.broadcast(scores.agg(F.count(F.lit(1)).alias("n"))))  # one row
    place = lambda i: F.least(F.col("n") - 1, F.bround(F.col("n") * i / bins))
    at = c.agg(F.array(*[F.min(F.when(F.col("upto") > place(i), F.col("p"))) for i in range(1, bins)]).alias("edges"))
    inner = F.filter(F.array_distinct("edges"), lambda e: (e > 1e-12) & (e < 1 - 1e-12))
    return at.select(F.concat(inner, F.array(F.lit(1.0))).alias("edges"))


def score_bins(scores: DataFrame, bins: int, binning: str = "equal_width") -> DataFrame:
    """Per bin over 0..1 (upper edges in; equal_width, or equal_count with edges from equal_count_edges): n, mean score, observed rate with Wilson bounds."""
    if binning == "equal_count":
        edges = equal_count_edges(scores, bins)
        dealt = scores.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(position(F.col("edges"), F.col("p"), bins) + 1, F.size("edges")).cast("int"))  # one row
    elif binning == "equal_width":
        dealt = scores.withColumn("bin", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * bins, 9))).cast("int"))
    else:
        raise ValueError("binning is equal_width or equal_count")
    b = dealt.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("p").cast("decimal(12,9)")).cast("double") / F.count(F.lit(1))).alias("mean_p"), F.sum("y").alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return b.select("bin", "n", "hits", "mean_p", (F.col("hits") / F.col("n")).alias("observed"), lo.alias("lower"), hi.alias("upper"))


def brier_parts(scores: DataFrame, bins: int, binning: str = "equal_width") -> DataFrame:
    """Brier score with Murphy's reliability, resolution and uncertainty over the bins; sums of scores are exact decimals (nine places)."""
    b = score_bins(scores, bins, binning)
    miss = F.col("p").cast("decimal(12,9)") - F.col("y")
    n = F.count(F.lit(1))
    whole = scores.agg((F.sum(miss * miss).cast("double") / n).alias("brier"), (F.sum("y") / n).alias("base"), n.alias("total"))
    j = b.crossJoin(F.broadcast(whole))  # one row
    part = lambda d: F.sum(F.col("n") * d * d) / F.max("total")
    return j.agg(F.max("brier").alias("brier"), part(F.col("mean_p") - F.col("observed")).alias("reliability"), part(F.col("observed") - F.col("base")).alias("resolution"), (F.max("base") * (1 - F.max("base"))).alias("uncertainty"))


def auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve by average ranks; counts per distinct score come first, so the running sum is over distinct scores."""
    c = scores.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    c = running_sums(c, "p", (), {"upto": F.col("n")}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    np_, nn = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return c.agg(F.try_divide(F.sum(F.col("pos") * F.col("rank")) - np_ * (np_ + 1) / 2, np_ * nn).alias("auc"), np_.alias("positives"), nn.alias("negatives"))


def conformal_quantile(residuals: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """For each alpha the ceil((n + 1)(1 - alpha))-th smallest |residual|, null when it exceeds n; by counts per distinct value."""
    c = residuals.where("residual is not null").groupBy(F.abs("residual").alias("r")).agg(F.count(F.lit(1)).alias("m"))
    c = running_sums(c, "r", (), {"upto": F.col("m")}).crossJoin(F.broadcast(c.agg(F.sum("m").alias("n"))))  # one row
    at = c.select("r", "upto", "n", F.explode(F.array(*map(F.lit, alphas))).alias("alpha")).withColumn("k", F.ceil((F.col("n") + 1) * (1 - F.col("alpha"))))
    return at.groupBy("alpha").agg(F.max("n").alias("n"), F.max("k").alias("k"), F.min(F.when(F.col("upto") >= F.col("k"), F.col("r"))).alias("q"))


def psi(values: DataFrame, edges: list[float]) -> DataFrame:
    """Population stability of (side: ref or cur, x) over given upper edges; shares are floored at 1e-6."""
    b = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        b = F.when(F.col("x") <= edges[i], i).otherwise(b)
    n = values.withColumn("bin", b).groupBy("bin").agg(F.count_if(F.col("side") == "ref").alias("ref"), F.count_if(F.col("side") == "cur").alias("cur"))
    share = lambda c: F.greatest(F.lit(1e-6), F.col(c) / F.sum(c).over(_all()))
    return n.select("bin", "ref", "cur", ((share("cur") - share("ref")) * F.log(share("cur") / share("ref"))).alias("psi"))


def ks(values: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of (side, x)."""
    c = values.groupBy("x").agg(F.count_if(F.col("side") == "ref").alias("a"), F.count_if(F.col("side") == "cur").alias("b"))
    n = c.agg(F.sum("a").alias("n_ref"), F.sum("b").alias("n_cur"))
    d = running_sums(c, "x", (), {"sa": F.col("a"), "sb": F.col("b")}).crossJoin(F.broadcast(n))  # one row
    return d.agg(F.max(F.abs(F.col("sa") / F.col("n_ref") - F.col("sb") / F.col("n_cur"))).alias("d"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))


def label_shift(values: DataFrame) -> DataFrame:
    """Base rates of (side, y), Wilson each, and Newcombe's interval of their difference."""
    v = values.agg(*[f(F.when(F.col("side") == s, F.col("y"))).alias(f"{k}_{s}") for s in ("ref", "cur") for f, k in ((F.sum, "x"), (F.count, "n"))])
    (la, ua), (lb, ub) = (wilson(F.col(f"x_{s}"), F.col(f"n_{s}")) for s in ("ref", "cur"))
    pa, pb = F.col("x_ref") / F.col("n_ref"), F.col("x_cur") / F.col("n_cur")
    lo = pb - pa - F.sqrt((pb - lb) ** 2 + (ua - pa) ** 2)
    hi = pb - pa + F.sqrt((ub - pb) ** 2 + (pa - la) ** 2)
    return v.select(pa.alias("rate_ref"), pb.alias("rate_cur"), (pb - pa).alias("difference"), lo.alias("lower"), hi.alias("upper"), ((lo > 0) | (hi < 0)).alias("shifted"))


# --- Votes ----------------------------------------------------------------------------------------


def pairwise_matrix(ballots: DataFrame, options: tuple[str, ...]) -> DataFrame:
    """d(a, b): ballots that rank a strictly above b; unranked options come last together."""
    last = len(options) + 1
    known = F.when(F.col("option_ref").isin(*options), F.col("option_ref")).otherwise(F.raise_error(F.concat(F.lit("no such option: "), F.col("option_ref"))))
    ballots = ballots.withColumn("option_ref", known)
    full = ballots.groupBy("voter_ref").agg(F.map_from_entries(F.collect_list(F.struct("option_ref", "tier"))).alias("tiers"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a_ref"), F.lit(b).alias("b_ref")) for a in options for b in options if a != b])
    tier = lambda c: F.coalesce(F.element_at("tiers", c), F.lit(last))
    p = full.select("tiers", F.explode(pairs).alias("x")).select("x.a_ref", "x.b_ref", (tier(F.col("x.a_ref")) < tier(F.col("x.b_ref"))).alias("above"))
    return p.groupBy("a_ref", "b_ref").agg(F.count_if("above").alias("votes"))


def condorcet(matrix: DataFrame, options: int) -> DataFrame:
    """Wins, ties and whether the option beats all others."""
    other = matrix.select(F.col("b_ref").alias("a_ref"), F.col("a_ref").alias("b_ref"), F.col("votes").alias("against"))
    r = matrix.join(other, ["a_ref", "b_ref"]).groupBy(F.col("a_ref").alias("option_ref")).agg(F.count_if(F.col("votes") > F.col("against")).alias("wins"), F.count_if(F.col("votes") == F.col("against")).alias("ties"))
    return r.withColumn("condorcet", F.col("wins") == options - 1)


def schulze(matrix: DataFrame, options: tuple[str, ...]) -> DataFrame:
    """Widest paths over winning votes, one intermediate option after the other; wins per option."""
    other = matrix.select(F.col("b_ref").alias("a_ref"), F.col("a_ref").alias("b_ref"), F.col("votes").alias("against"))
    links = matrix.join(other, ["a_ref", "b_ref"]).agg(*[
        F.max(F.when((F.col("a_ref") == a) & (F.col("b_ref") == b), F.when(F.col("votes") > F.col("against"), F.col("votes")).otherwise(0))).alias(f"p{i}_{j}")
        for i, a in enumerate(options) for j, b in enumerate(options) if i != j
    ])
    n = range(len(options))
    for k in n:
        links = links.select(*[
            (F.col(f"p{i}_{j}") if k in (i, j) else F.greatest(f"p{i}_{j}", F.least(f"p{i}_{k}", f"p{k}_{j}"))).alias(f"p{i}_{j}") for i in n for j in n if i != j
        ])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("option_ref"), sum(((F.col(f"p{i}_{j}") > F.col(f"p{j}_{i}")).cast("int") for j in n if j != i), F.lit(0)).alias("wins")) for i, a in enumerate(options)]))
    return links.select(rows.alias("r")).select("r.*")


def borda(matrix: DataFrame, voters: int | Column, other: DataFrame | None = None) -> DataFrame:
    """1 for each option ranked below, 0.5 for each tie, over all ballots."""
    rev = matrix.select(F.col("b_ref").alias("a_ref"), F.col("a_ref").alias("b_ref"), F.col("votes").alias("against"))
    v = F.lit(voters) if isinstance(voters, int) else voters
    r = matrix.join(rev, ["a_ref", "b_ref"]).withColumn("points", F.col("votes") + 0.5 * (v - F.col("votes") - F.col("against")))
    return r.groupBy(F.col("a_ref").alias("option_ref")).agg(F.sum("points").alias("points"))


def approval(ballots: DataFrame, voters: DataFrame) -> DataFrame:
    """Approvals of each option and their share of the voters (a table of one row)."""
    r = ballots.groupBy("option_ref").agg(F.countDistinct("voter_ref").alias("approvals")).crossJoin(F.broadcast(voters.select("voters")))
    lo, hi = wilson(F.col("approvals"), F.col("voters"))
    return r.select("option_ref", "approvals", (F.col("approvals") / F.col("voters")).alias("share"), lo.alias("lower"), hi.alias("upper"))


# --- Surveys, segments, disclosure, audit ----------------------------------------------------------


def likert(responses: DataFrame, by: str, top: int, bottom: int) -> DataFrame:
    """Counts, exact median and quartiles, top- and bottom-box shares of ordinal values per group; no means."""
    q = lambda p: F.percentile("value", F.lit(p))
    return responses.groupBy(by).agg(F.count(F.lit(1)).alias("n"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.avg((F.col("value") >= top).cast("int")).alias("top_box"), F.avg((F.col("value") <= bottom).cast("int")).alias("bottom_box"))


def cliffs_delta(values: DataFrame) -> DataFrame:
    """P(a > b) - P(a < b) of (side: a or b, value), from counts per distinct value and running sums."""
    c = values.groupBy("value").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))
    below = F.coalesce(F.sum("b").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("below", below).withColumn("above", F.sum("b").over(_all()) - F.col("below") - F.col("b"))
    return c.agg(F.try_divide(F.sum(F.col("a") * (F.col("below") - F.col("above"))), F.sum("a") * F.sum("b")).alias("delta"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def design_effect(weights: DataFrame) -> DataFrame:
    return weights.agg((F.count(F.lit(1)) * F.sum(F.col("w") * F.col("w")) / (F.sum("w") * F.sum("w"))).alias("deff"), F.count(F.lit(1)).alias("n"))


def suppress_small(table: DataFrame, count: str, measures: tuple[str, ...], k: int) -> DataFrame:
    """Primary suppression: rows under k keep their labels, lose their measures, and say so."""
    small = F.col(count) < k
    keep = [c for c in table.columns if c not in (*measures, count)]
    return table.select(*keep, *[F.when(~small, F.col(c)).alias(c) for c in (count, *measures)], small.alias("suppressed"))


def benford(amounts: DataFrame) -> DataFrame:
    """First digits of positive amounts against Benford's law: counts, share, expected, Wilson bounds and the chi-square part of each digit."""
    digit = F.substring(F.col("amount").cast("string"), 1, 1).cast("int")
    n = amounts.where("amount > 0").select(digit.alias("digit")).groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    nine = amounts.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    r = nine.join(n, "digit", "left").select("digit", F.coalesce("n", F.lit(0)).alias("n")).withColumn("total", F.sum("n").over(_all())).withColumn("expected", F.log10(1 + 1 / F.col("digit")))
    lo, hi = wilson(F.col("n"), F.col("total"))
    e = F.col("expected") * F.col("total")
    return r.select("digit", "n", (F.col("n") / F.col("total")).alias("share"), "expected", lo.alias("lower"), hi.alias("upper"), ((F.col("n") - e) ** 2 / e).alias("chi2_part"))


def seasonal_naive(series: DataFrame, m: int, horizon: int) -> DataFrame:
    """y[T+h] = y[T+h-m*ceil(h/m)] with sd = rmse * sqrt(1 + floor((h-1)/m)) from in-sample seasonal differences."""
    w = Window.orderBy("period_start")
    s = series.withColumn("i", F.row_number().over(w)).withColumn("t", F.count(F.lit(1)).over(_all())).withColumn("r", F.col("x") - F.lag("x", m).over(w))
    s = s.withColumn("rmse", F.sqrt(F.avg(F.col("r") * F.col("r")).over(_all()))).where(F.col("i") > F.col("t") - m)
    steps = F.transform(F.sequence(F.lit(0), F.lit((horizon - 1) // m)), lambda c: F.col("i") - F.col("t") + m + c * m)
    out = s.select("x", "rmse", F.explode(steps).alias("h")).where((F.col("h") >= 1) & (F.col("h") <= horizon))
    return out.select(F.col("h").cast("int").alias("h"), F.col("x").alias("point"), (F.col("rmse") * F.sqrt(1 + F.floor((F.col("h") - 1) / m))).alias("sd"))


#: Rows of a query set's tokens that are broadcast at once; longer sets are taken in blocks of about so many.
BLOCK = 500_000


def query_blocks(tokens: DataFrame, rows: int = BLOCK) -> list[DataFrame]:
    """A query set's tokens (q, token, ...) in blocks of whole queries, of about `rows` rows each, marked for broadcast."""
    blocks = max(1, -(-tokens.count() // rows))
    return [F.broadcast(tokens if blocks == 1 else tokens.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)) for b in range(blocks)]


def spread(left: DataFrame, right: DataFrame, key: str, heaviest: int = 2048, salts: int = 64) -> tuple[DataFrame, DataFrame, list[str]]:
    """left, right and the keys of their join on key: rows of left with a key that holds more than 1/heaviest of them are dealt over salts.

    right has a row per key and the number of left's rows with it as df; so no more than heaviest keys are broadcast.
    """
    total = right.agg(F.sum("df").alias("total"))
    heavy = F.broadcast(right.crossJoin(F.broadcast(total)).where(F.col("df") * heaviest > F.col("total")).select(F.col(key).alias("heavy")))  # total is one row
    own = F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("heavy").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    mark = lambda x: x.join(heavy, F.col(key) == F.col("heavy"), "left")
    return mark(left).withColumn("salt", own).drop("heavy"), mark(right).withColumn("salt", F.explode(every)).drop("heavy"), [key, "salt"]


def jaccard_candidates(queries: DataFrame, docs: DataFrame, least: float, rows: int = BLOCK) -> DataFrame:
    """Jaccard similarity of distinct lower-cased tokens of a stated query set (q, text) against all documents (d, text).

    Blocks of the query set go to the documents, so no token is a shuffle key and a document's hits are counted where it is read.
    Documents that are too long or too short for every query of a block, as an overlap is no more than the smaller set, meet none of it.
    """
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda x: x != ""))
    a = queries.select("q", words(F.col("text")).alias("w")).select("q", F.size("w").alias("na"), F.explode("w").alias("token"))
    b = docs.select("d", words(F.col("text")).alias("w")).select("d", F.size("w").alias("nb"), F.explode("w").alias("token"))
    fits = F.least("na", "nb") >= least * F.greatest("na", "nb")
    out = None
    for block in query_blocks(a, rows):
        both = b.join(block, "token").where(fits).groupBy("q", "d").agg(F.count(F.lit(1)).alias("both"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        r = both.withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("jaccard") >= least).select("q", "d", "jaccard")
        out = r if out is None else out.unionByName(r)
    return out


# --- More services -----------------------------------------------------------------------------------


def autocorrelations(series: DataFrame, lags: int) -> DataFrame:
    """Autocorrelation of (period_start, x) at lags 1 .. lags and the Ljung-Box statistic over them."""
    w = Window.orderBy("period_start")  # a row per period
    s = series.withColumn("u", F.col("x") - F.avg("x").over(_all())).withColumn("n", F.count(F.lit(1)).over(_all()))
    rho = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col("u") * F.lag("u", k).over(w)).alias("c")) for k in range(1, lags + 1)])
    p = s.withColumn("p", rho).select("u", "n", F.explode("p").alias("p")).groupBy("p.lag").agg((F.sum("p.c") / F.sum(F.col("u") * F.col("u"))).alias("rho"), F.max("n").alias("n"))
    return p.withColumn("ljung_box", F.col("n") * (F.col("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))).over(_all())).select("lag", "rho", "ljung_box")


def seasonal_backtest(series: DataFrame, m: int, origins: int, horizon: int) -> DataFrame:
    """Rolling-origin errors of the seasonal naive forecast by horizon (up to m): scaled by the in-sample seasonal error at each origin (MASE), sMAPE and RMSE."""
    w = Window.orderBy("period_start")  # a row per period
    s = series.withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(_all())).withColumn("point", F.lag("x", m).over(w))
    s = s.withColumn("scale", F.avg(F.abs(F.col("x") - F.col("point"))).over(w))
    at = s.select("scale", "n", F.col("i").alias("origin"), F.explode(F.sequence(F.lit(1), F.lit(min(m, horizon)))).alias("h"))
    at = at.where((F.col("origin") <= F.col("n") - horizon) & (F.col("origin") > F.col("n") - horizon - origins))
    f = at.join(s.select(F.col("i").alias("j"), "x", "point"), F.col("j") == F.col("origin") + F.col("h"))
    off = F.abs(F.col("x") - F.col("point"))
    size = (F.abs("x") + F.abs("point")) / 2
    return f.groupBy("h").agg(F.count(F.lit(1)).alias("origins"), F.avg(off / F.col("scale")).alias("mase"), (100 * F.avg(F.when(size == 0, 0.0).otherwise(off / size))).alias("smape"), F.sqrt(F.avg(off * off)).alias("rmse"))


def score_vote(scores: DataFrame) -> DataFrame:
    """Totals of (voter_ref, option_ref, score); an option left unscored is unscored, not zero, and both means are given."""
    voters = scores.agg(F.countDistinct("voter_ref").alias("voters"))
    r = scores.groupBy("option_ref").agg(F.sum("score").alias("total"), F.count("score").alias("scored"), F.avg("score").alias("mean_of_scorers")).crossJoin(F.broadcast(voters))  # one row
    rank = F.row_number().over(Window.orderBy(F.desc("total"), "option_ref"))  # a row per option
    return r.select("option_ref", "total", "scored", "mean_of_scorers", (F.col("total") / F.col("voters")).alias("mean_of_all"), rank.alias("rank"))


def smith_set(matrix: DataFrame, options: tuple[str, ...]) -> DataFrame:
    """Whether each option is in the smallest set whose members beat all others: it reaches every option over ties and wins."""
    other = matrix.select(F.col("b_ref").alias("a_ref"), F.col("a_ref").alias("b_ref"), F.col("votes").alias("against"))
    n = range(len(options))
    reach = matrix.join(other, ["a_ref", "b_ref"]).agg(*[
        F.coalesce(F.bool_or((F.col("a_ref") == a) & (F.col("b_ref") == b) & (F.col("votes") >= F.col("against"))), F.lit(False)).alias(f"r{i}_{j}") for i, a in enumerate(options) for j, b in enumerate(options) if i != j
    ])
    for k in n:
        reach = reach.select(*[(F.col(f"r{i}_{j}") if k in (i, j) else F.col(f"r{i}_{j}") | (F.col(f"r{i}_{k}") & F.col(f"r{k}_{j}"))).alias(f"r{i}_{j}") for i in n for j in n if i != j])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("option_ref"), F.forall(F.array(*[F.col(f"r{i}_{j}") for j in n if j != i]), lambda x: x).alias("in_smith_set")) for i, a in enumerate(options)]))
    return reach.select(rows.alias("r")).select("r.*")


def psi_quantile(values: DataFrame, bins: int) -> DataFrame:
    """Population stability over bins at the reference side's exact quantiles."""
    edges = order_statistics(values.where("side = 'ref'"), "side", tuple(i / bins for i in range(1, bins))).select(F.col("quantiles").alias("edges"))
    b = values.crossJoin(F.broadcast(edges)).withColumn("bin", position(F.col("edges"), F.col("x"), bins))  # one row
    n = b.groupBy("bin").agg(F.count_if(F.col("side") == "ref").alias("ref"), F.count_if(F.col("side") == "cur").alias("cur"))
    share = lambda c: F.greatest(F.lit(1e-6), F.col(c) / F.sum(c).over(_all()))
    return n.select("bin", "ref", "cur", ((share("cur") - share("ref")) * F.log(share("cur") / share("ref"))).alias("psi"))


def lorenz(loads: DataFrame) -> DataFrame:
    """Points of the Lorenz curve of (group_ref, load)."""
    w = Window.orderBy("load", "group_ref")  # a row per worker
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return loads.select("group_ref", "load", (F.row_number().over(w) / F.count(F.lit(1)).over(_all())).alias("share_of_workers"), (F.sum("load").over(run) / F.sum("load").over(_all())).alias("share_of_load"))


def adjusted_rand(labels: DataFrame) -> DataFrame:
    """The adjusted Rand index of two labellings (a, b)."""
    t = labels.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda d, c: d.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(c), *([F.sum("n").alias("total")] if c == "ij" else []))
    r = pairs(t, "ij").crossJoin(F.broadcast(pairs(t.groupBy("a").agg(F.sum("n").alias("n")), "i"))).crossJoin(F.broadcast(pairs(t.groupBy("b").agg(F.sum("n").alias("n")), "j")))  # one row each
    chance = F.col("i") * F.col("j") / (F.col("total") * (F.col("total") - 1) / 2)
    return r.select(F.try_divide(F.col("ij") - chance, (F.col("i") + F.col("j")) / 2 - chance).alias("adjusted_rand"))


def robust_scale(values: DataFrame, by: str) -> DataFrame:
    """(x - median) / interquartile range within each group."""
    q = order_statistics(values, by, (0.25, 0.5, 0.75)).select(F.col(by).alias("_g"), F.col("quantiles").alias("_q"))
    return values.join(q, F.col(by) == F.col("_g")).withColumn("scaled", F.try_divide(F.col("x") - F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0])).drop("_g", "_q")


def benford_digits(amounts: DataFrame, k: int) -> DataFrame:
    """Counts of the first k digits of amounts of at least k digits against Benford's law."""
    n = amounts.where(F.col("amount") >= 10 ** (k - 1)).select(F.substring(F.col("amount").cast("string"), 1, k).cast("int").alias("digits")).groupBy("digits").agg(F.count(F.lit(1)).alias("n"))
    every = amounts.sparkSession.range(10 ** (k - 1), 10**k).select(F.col("id").cast("int").alias("digits"))
    r = every.join(n, "digits", "left").select("digits", F.coalesce("n", F.lit(0)).alias("n")).withColumn("t", F.sum("n").over(_all())).withColumn("expected", F.log10(1 + 1 / F.col("digits")))
    e = F.col("expected") * F.col("t")
    return r.select("digits", "n", (F.col("n") / F.col("t")).alias("share"), "expected", ((F.col("n") - e) ** 2 / e).alias("chi2_part"))
