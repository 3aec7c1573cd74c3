"""Budgets: hand-worked cases, guarantees on random instances, the exact optimum."""

import itertools
import random

import pytest

from tallystream.functions import budgeting as B

PAPER = "decision_ref string, option_ref string, cost double, budget double"
BALLOT = "decision_ref string, stratum string, approvals array<string>"


def minority(spark):
    ps = [f"p{i}" for i in range(1, 11)]
    ballots = spark.createDataFrame([("d", "many", ps)] * 16 + [("d", "few", ["q", "q"])] * 4 + [("d", "few", ["nowhere"])], BALLOT)
    return ballots, spark.createDataFrame([("d", o, 10.0, 100.0) for o in [*ps, "q"]], PAPER)


def test_a_minority_pays_for_its_project_and_greedy_passes_it_over(spark):
    ballots, paper = minority(spark)
    rounds = B.equal_shares(ballots, paper, completion="none").orderBy("round").collect()
    assert abs(rounds[0].rho - 0.625) < 1e-12 and rounds[0].supporters == 16 and len(rounds) == 9
    q = next(r for r in rounds if r.option_ref == "q")
    assert abs(q.rho - 2.5) < 1e-12 and q.supporters == 4 and abs(q.charged - 10) < 1e-9
    assert B.ejr_violations(ballots, paper, B.equal_shares(ballots, paper)).collect() == []
    greedy = B.greedy_knapsack(ballots, paper)
    assert "q" not in {r.option_ref for r in greedy.collect()} and greedy.count() == 10
    bad = B.ejr_violations(ballots, paper, greedy).collect()
    assert [(r.options, r.voters, r.best, r.required, r.exhaustive) for r in bad] == [("q", 4.0, 0, 1, True)]
    fair = {r.stratum: r for r in B.fairness_report(ballots, paper, greedy, k=3).collect()}
    assert (fair["many"].share_won, fair["few"].won, fair["few"].voters) == (1.0, 0.0, 4) and abs(fair["many"].utilisation - 1.25) < 1e-12


def test_equal_shares_never_leaves_a_cohesive_group_short(spark):
    rng = random.Random(8)
    votes, paper = [], []
    for d in map(str, range(12)):
        options = [f"o{i}" for i in range(rng.randint(3, 7))]
        paper += [(d, o, float(rng.randint(5, 40)), 60.0) for o in options]
        votes += [(d, None, rng.sample(options, rng.randint(0, len(options)))) for _ in range(25)]
    ballots, options = spark.createDataFrame(votes, BALLOT), spark.createDataFrame(paper, PAPER)
    for completion in ("add1", "none"):
        funded = B.equal_shares(ballots, options, completion=completion)
        assert B.ejr_violations(ballots, options, funded).collect() == []
        spent = {r.decision_ref: r.s for r in funded.groupBy("decision_ref").agg({"cost": "sum"}).withColumnRenamed("sum(cost)", "s").collect()}
        assert max(spent.values()) <= 60
    got = {r.decision_ref: r for r in B.greedy_knapsack(ballots, options).collect()}
    for d, r in got.items():
        cost = {o: c for x, o, c, _ in paper if x == d}
        support = {o: sum(o in a for x, _, a in votes if x == d) for o in cost}
        best = max(sum(support[o] for o in t) for n in range(len(cost) + 1) for t in itertools.combinations(cost, n) if sum(cost[o] for o in t) <= 60)
        assert r.optimum == best and best / 2 <= r.total <= best


def test_one_large_project_beats_a_cheap_popular_one(spark):
    ballots = spark.createDataFrame([("d", None, ["big"])] * 9 + [("d", None, ["small"])] * 1 + [("e", None, None)], BALLOT)
    paper = spark.createDataFrame([("d", "big", 100.0, 100.0), ("d", "small", 1.0, 100.0), ("e", "x", 5.0, 10.0)], PAPER)
    got = B.greedy_knapsack(ballots, paper).collect()
    assert [(r.option_ref, r.variant, r.total, r.optimum) for r in got if r.decision_ref == "d"] == [("big", "best single option", 9.0, 9.0)]
    assert B.equal_shares(ballots.where("decision_ref = 'e'"), paper).collect() == []
    assert B.equal_shares(ballots.limit(0), paper).collect() == []
    with pytest.raises(ValueError):
        B.equal_shares(ballots, paper, completion="other")
