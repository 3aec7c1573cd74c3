"""Inference services against plain loops; adapters and readers."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallystream.functions import inference as I  # noqa: E741
from tallystream.functions import statistics as S
from tallystream.sources import adapters as D


def efron(x, entry, out, event):
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        g, h = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
        for t in np.unique(out[event]):
            r = ((entry < t) | ((t <= 0) & (entry <= 0))) & (out >= t)
            d = event & (out == t)
            for part in range(d.sum()):
                w = np.exp(x @ beta) * (r - d * (part / d.sum()))
                s, s1, s2 = w.sum(), w @ x, (x.T * w) @ x
                g -= s1 / s
                h += s2 / s - np.outer(s1, s1) / s**2
            g += x[d].sum(0)
        beta = beta + np.linalg.solve(h, g)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_cox_equals_newton_by_hand(spark, monkeypatch):
    monkeypatch.setattr(I, "TIES", 7)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (250, 2)).astype(float)
    out = np.ceil(rng.exponential(10 / np.exp(0.5 * x[:, 0] - 0.3 * x[:, 1]))).astype(int)
    event, entry = rng.random(250) < 0.7, np.where(rng.random(250) < 0.3, rng.integers(0, 4, 250), 0)
    keep = out > entry
    x, out, event, entry = x[keep], out[keep], event[keep], entry[keep]
    beta, se = efron(x, entry, out, event)
    # Years stand for a covariate far from zero; a null covariate and a spell that is never at risk take no part.
    rows = [(float(a), float(b) + 2000, int(i), int(o), bool(e)) for (a, b), i, o, e in zip(x, entry, out, event, strict=True)] + [(None, 2000.0, 0, 3, True), (1.0, 2000.0, 5, 5, True)]
    d = spark.createDataFrame(rows, "a double, b double, entry int, exit int, ev boolean")
    got = I.cox(d, ("a", "b"), "ev").collect()
    assert np.allclose([r.coefficient for r in got], beta, atol=1e-6) and np.allclose([r.se for r in got], se, atol=1e-6)
    assert all(r.converged and r.n == len(x) and r.events == event.sum() and r.lower < r.hazard_ratio < r.upper for r in got)
    zph = {r.covariate: r for r in I.schoenfeld(d, ("a", "b"), "ev", tuple(beta)).collect()}
    assert all(r.p_value > 0.01 and r.events == event.sum() for r in zph.values())


def test_cox_without_events_or_variation(spark):
    schema = "a double, entry int, exit int, ev boolean"
    none = I.cox(spark.createDataFrame([(1.0, 0, 3, False), (2.0, 0, 4, False)], schema), ("a",), "ev").first()
    assert (none.coefficient, none.se, none.events, none.converged) == (0.0, None, 0, False)
    flat = I.cox(spark.createDataFrame([(5.0, 0, 3, True), (5.0, 0, 4, True)], schema), ("a",), "ev").first()
    assert flat.coefficient == 0.0 and flat.se is None
    assert I.cox(spark.createDataFrame([], schema), ("a",), "ev").first().n == 0


def test_an_effect_that_fades_fails_the_schoenfeld_check(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, 800)
    # The hazard of x = 1 is four times that of the others before day 10 and a fourth after it.
    early = rng.exponential(np.where(x == 1, 5, 20))
    out = np.ceil(np.where(early < 10, early, 10 + rng.exponential(np.where(x == 1, 80, 20)))).astype(int)
    d = spark.createDataFrame([(float(a), 0, int(t), True) for a, t in zip(x, out, strict=True)], "a double, entry int, exit int, ev boolean")
    beta = I.cox(d, ("a",), "ev").first().coefficient
    assert I.schoenfeld(d, ("a",), "ev", (beta,)).first().p_value < 1e-4


def test_platt_solves_its_score_equations(spark):
    rng = np.random.default_rng(1)
    p = rng.random(400).round(2)
    y = (rng.random(400) < p * p).astype(int)
    a, b = I.platt(spark.createDataFrame([(float(q), int(k)) for q, k in zip(p, y, strict=True)], "p double, y int"))
    hits = y.sum()
    aim = np.where(y == 1, (hits + 1) / (hits + 2), 1 / (400 - hits + 2))
    off = aim - 1 / (1 + np.exp(-(a * p + b)))
    assert abs(off.sum()) < 1e-8 and abs((off * p).sum()) < 1e-8


def test_two_group_logrank(spark):
    rows = [(0, t, g, e) for g, ts in (("a", [(6, 1), (6, 1), (7, 1), (10, 0), (13, 1)]), ("b", [(1, 1), (2, 1), (3, 1), (8, 1), (11, 0)])) for t, e in ts]
    r = I.logrank_test(spark.createDataFrame(rows, "entry int, exit int, g string, e int").withColumn("e", F.col("e") == 1), "g", ("a", "b"), "e").first()
    times, o, ex, v = sorted({t for _, t, _, e in rows if e}), 0, 0.0, 0.0
    for t in times:
        n, na = sum(x >= t for _, x, _, _ in rows), sum(x >= t and g == "a" for _, x, g, _ in rows)
        d, da = sum(x == t and e for _, x, _, e in rows), sum(x == t and e and g == "a" for _, x, g, e in rows)
        o, ex = o + da, ex + d * na / n
        v += d * (n - d) / (n - 1) * na / n * (1 - na / n) if n > 1 else 0
    assert math.isclose(r.chi2, (o - ex) ** 2 / v, rel_tol=1e-9) and math.isclose(r.p_value, math.erfc(math.sqrt(r.chi2 / 2)), rel_tol=1e-8)


def test_envelope_holds_back_what_must_not_be_read(spark):
    d = spark.createDataFrame([("a", 40, 3.0, 0.05), ("b", 5, 4.0, 0.05), ("c", 40, 5.0, 0.5), ("d", 40, 6.0, None)], "k string, m int, x double, q double")
    params = {"b": 2, "a": [1, 2]}
    out = {r.k: r for r in I.envelope(d, "s.m", n=F.col("m"), least=30, params=params, values=("x",), checks={"few": F.col("q") <= 0.1}, blocking=("few",)).collect()}
    assert [out[k].x for k in "abcd"] == [3.0, None, None, 6.0]
    assert [(out[k].insufficient_data, out[k].blocked, out[k].check_few) for k in "abcd"] == [(False, False, "PASS"), (True, False, "PASS"), (False, True, "FAIL"), (False, False, "SKIPPED")]
    assert out["a"].params_hash == I.params_hash("s.m", 1, {"a": [1, 2], "b": 2}) != I.params_hash("s.m", 2, params)


def test_ranks_and_bands(spark):
    d = spark.createDataFrame([("a", 90, 100), ("b", 88, 100), ("c", 10, 100), ("d", 1, 1)], "group_ref string, successes int, trials int")
    got = I.rank_by_lower_bound(d).orderBy("rank").collect()
    assert [(r.group_ref, r.band) for r in got] == [("a", 0), ("b", 0), ("d", 0), ("c", 1)] or [r.group_ref for r in got] == ["a", "b", "d", "c"]


def test_holm_and_smith(spark):
    got = {r.feature: r.adjusted for r in I.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "feature string, p_value double")).collect()}
    assert all(math.isclose(got[k], v) for k, v in {"a": 0.03, "c": 0.06, "b": 0.06}.items())
    beats = {("a", "b"): 6, ("b", "c"): 6, ("c", "a"): 6, ("a", "d"): 9, ("b", "d"): 9, ("c", "d"): 9}
    m = [(x, y, beats.get((x, y), 10 - beats.get((y, x), 5))) for x in "abcd" for y in "abcd" if x != y]
    out = {r.option_ref: r.in_smith_set for r in S.smith_set(spark.createDataFrame(m, "a_ref string, b_ref string, votes int"), tuple("abcd")).collect()}
    assert out == {"a": True, "b": True, "c": True, "d": False}


def test_adapters_count_what_they_do_not_know(spark, tmp_path):
    rows = D.mapped(spark.createDataFrame([("x",), ("y",), (None,)], "w string"), "w", {"x": "known"}, "kind").collect()
    assert [(r.kind, r.unmapped) for r in rows] == [("known", False), ("other", True), ("other", True)]
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,\n")
    (tmp_path / "m.json").write_text('{"name": "v", "packs": ["a", "b"]}')
    assert [tuple(r) for r in D.csv(spark, f"file://{tmp_path}/a.csv", "k int, v string").collect()] == [(1, "x"), (2, None)]
    assert D.manifest(spark, f"file://{tmp_path}/m.json", "name string, packs array<string>").first().packs == ["a", "b"]
    a, b = spark.range(1).select(D.pseudonym(F.lit(5), "member", "k"), D.pseudonym(F.lit(5), "asset", "k")).first()
    assert a[0] == "m" and a[2:] != b[2:] and len(a) == 18


def test_logrank_of_groups_equals_plain_sums(spark):
    rng = np.random.default_rng(11)
    g, entry = rng.integers(0, 4, 400), np.where(rng.random(400) < 0.2, rng.integers(1, 4, 400), 0)
    out = entry + 1 + rng.exponential(6 + g, 400).astype(int)
    event = rng.random(400) < 0.7
    u, v = np.zeros(4), np.zeros((4, 4))
    for t in np.unique(out[event]):
        risk = ((entry < t) | ((t <= 0) & (entry <= 0))) & (out >= t)
        n, d = risk.sum(), (event & (out == t)).sum()
        share = np.array([(risk & (g == i)).sum() / n for i in range(4)])
        u += [(event & (out == t) & (g == i)).sum() - d * share[i] for i in range(4)]
        v += (d * (n - d) / (n - 1) if n > 1 else 0) * (np.diag(share) - np.outer(share, share))
    want = u[:3] @ np.linalg.solve(v[:3, :3], u[:3])
    rows = [(None if i == 3 else str(i), int(a), int(b), bool(e)) for i, a, b, e in zip(g, entry, out, event, strict=True)]
    d = spark.createDataFrame(rows, "g string, entry int, exit int, ev boolean")
    r = I.logrank_groups(d, "g", "ev").first()
    assert abs(r.chi2 - want) < 1e-8 and (r.df, r.groups, r.n, r.events) == (3, 4, 400, event.sum()) and 0 < r.p_value < 1
    two = I.logrank_groups(d.where("g in ('0', '1')"), "g", "ev").first()
    assert abs(two.chi2 - I.logrank_test(d.where("g in ('0', '1')"), "g", ("0", "1"), "ev").first().chi2) < 1e-8
    one = I.logrank_groups(d.where("g = '0'"), "g", "ev").first()
    assert (one.chi2, one.df, one.p_value) == (0.0, 0, None) and I.logrank_groups(d.limit(0), "g", "ev").first().groups == 0


def test_credible_intervals_hold_their_mass(spark):
    rng = np.random.default_rng(2)
    rates = [(str(i), int(rng.binomial(n, p)), int(n)) for i, (n, p) in enumerate(zip(rng.integers(5, 80, 12), rng.beta(3, 7, 12), strict=True))]
    x = np.linspace(0, 1, 400_001)[1:-1]
    for r in I.beta_credible(spark.createDataFrame(rates, "group_ref string, successes long, trials long")).collect():
        size = r.trials / r.weight
        log = (r.shrunk * size - 1) * np.log(x) + ((1 - r.shrunk) * size - 1) * np.log(1 - x)
        w = np.exp(log - log.max())
        w /= w.sum()
        assert abs(w[x < r.lower].sum() - 0.025) < 1e-4 and abs(w[x > r.upper].sum() - 0.025) < 1e-4 and r.lower < r.shrunk < r.upper
    counts = [(str(i), int(rng.poisson(t * lam)), float(t)) for i, (t, lam) in enumerate(zip(rng.integers(20, 400, 10), rng.gamma(4, 0.05, 10), strict=True))]
    d = spark.createDataFrame(counts, "group_ref string, events long, exposure_days double")
    full = {r.group_ref: r for r in S.gamma_shrink(d, posterior=True).collect()}
    for r in I.gamma_credible(d).collect():
        f = full[r.group_ref]
        y = np.linspace(0, f['shape'] / f.rate * 6, 400_001)[1:]
        log = (f["shape"] - 1) * np.log(y) - f.rate * y
        w = np.exp(log - log.max())
        w /= w.sum()
        assert abs(w[y < r.lower].sum() - 0.025) < 1e-4 and abs(w[y > r.upper].sum() - 0.025) < 1e-4 and r.lower < r.shrunk < r.upper


def test_narrow_posteriors_agree_with_exact_quantiles(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(*[f(q, F.lit(1500.0), F.lit(x)) for q in (0.025, 0.975) for f, x in ((I._gamma_quantile, 3.0), (I._beta_quantile, 4000.0))]).first()
    draws = np.random.default_rng(1)
    g, b = draws.gamma(1500, 1 / 3, 2_000_000), draws.beta(1500, 4000, 2_000_000)
    assert np.allclose(row, [np.quantile(g, 0.025), np.quantile(b, 0.025), np.quantile(g, 0.975), np.quantile(b, 0.975)], rtol=4e-4)
