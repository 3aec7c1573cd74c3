"""Participatory budgets: equal shares, greedy with its optimum, groups that got less than their share, and who won how much.

Ballots are counted by decision and set of approvals first.  Voters with equal approvals have equal purses throughout, so a decision's kernel sees distinct approval sets, not voters; decisions run in parallel.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many options every set of options is searched for groups that are entitled to it; beyond, sets of up to PARTIAL options.
EXHAUSTIVE, PARTIAL = 12, 3


def counted(ballots: DataFrame, options: DataFrame) -> DataFrame:
    """(decision_ref, approvals, n): valid ballots by their set of approvals; a ballot is (decision_ref, approvals), an option (decision_ref, option_ref, cost).

    A ballot that approves an option not on its decision's paper is left out; null approvals count as none.
    """
    paper = options.groupBy("decision_ref").agg(F.collect_set("option_ref").alias("paper"))  # a decision's options
    named = ballots.select("decision_ref", F.array_sort(F.array_distinct(F.coalesce("approvals", F.array().cast("array<string>")))).alias("approvals"))
    n = named.groupBy("decision_ref", "approvals").agg(F.count(F.lit(1)).alias("n"))
    return n.join(paper, "decision_ref").where(F.size(F.array_except("approvals", "paper")) == 0).drop("paper")


class _Instance:
    """One decision: options in order of name, costs, a row of approvals for each distinct ballot and their numbers of voters."""

    def __init__(self, ballots: pd.DataFrame, options: pd.DataFrame) -> None:
        options = options.sort_values("option_ref")
        self.names, self.cost, self.budget = list(options.option_ref), options.cost.to_numpy(float), float(options.budget.iloc[0])
        at = {o: i for i, o in enumerate(self.names)}
        ballots = ballots.assign(key=[",".join(a) for a in ballots.approvals]).sort_values("key")
        self.n = ballots.n.to_numpy(float)
        self.likes = np.zeros((len(ballots), len(self.names)), bool)
        for i, a in enumerate(ballots.approvals):
            self.likes[i, np.array([at[o] for o in a], int)] = True
        self.support = self.n @ self.likes

    def shares(self, purse: float) -> list[tuple[int, float, float, float]]:
        """Rounds of equal shares from equal purses: (option, rho, supporters, charged), the cheapest rho first, ties by name."""
        purses, left, rounds = np.full(len(self.n), purse), set(range(len(self.names))), []
        while left:
            best: tuple[float, int] | None = None
            for o in sorted(left):
                rho = self._rho(purses[self.likes[:, o]], self.n[self.likes[:, o]], self.cost[o])
                if rho is not None and (best is None or rho < best[0] - 1e-12):
                    best = (rho, o)
            if best is None:
                return rounds
            rho, o = best
            pay = np.where(self.likes[:, o], np.minimum(purses, rho), 0.0)
            purses = purses - pay
            left.discard(o)
            rounds.append((o, rho, float(self.support[o]), float(pay @ self.n)))
        return rounds

    @staticmethod
    def _rho(purses: np.ndarray, n: np.ndarray, cost: float) -> float | None:
        """The smallest payment a head with which the supporters cover the cost; None if all their purses don't."""
        if not len(n) or purses @ n < cost - 1e-9:
            return None
        order = np.argsort(purses, kind="stable")
        purses, n = purses[order], n[order]
        emptied = np.concatenate([[0.0], np.cumsum(purses * n)[:-1]])  # paid by those with less
        payers = n[::-1].cumsum()[::-1]
        enough = np.nonzero(emptied + purses * payers >= cost - 1e-12)[0]
        return float((cost - emptied[enough[0]]) / payers[enough[0]]) if len(enough) else float(purses[-1])

    def greedy(self) -> tuple[list[int], str]:
        """By approvals per unit of cost (ties by name), or the single most approved option that is affordable if that alone has more approvals."""
        chosen, spent = [], 0.0
        for o in sorted(range(len(self.names)), key=lambda o: (-(self.support[o] / self.cost[o]) if self.cost[o] else 0.0, o)):
            if spent + self.cost[o] <= self.budget:
                chosen.append(o)
                spent += self.cost[o]
        single = max((o for o in range(len(self.names)) if self.cost[o] <= self.budget), key=lambda o: (self.support[o], o), default=None)
        if single is not None and self.support[single] > self.support[chosen].sum():
            return [single], "best single option"
        return chosen, "density"

    def optimum(self) -> float:
        """The most approvals that the budget can buy: states (cost, approvals) that no cheaper one reaches, option by option."""
        states = [(0.0, 0.0)]
        for o in range(len(self.names)):
            more = [(c + self.cost[o], v + self.support[o]) for c, v in states if c + self.cost[o] <= self.budget]
            kept: list[tuple[float, float]] = []
            for c, v in sorted(states + more, key=lambda s: (s[0], -s[1])):
                if not kept or v > kept[-1][1]:
                    kept.append((c, v))
            states = kept
        return states[-1][1]

    def violations(self, funded: list[int]) -> list[tuple[str, float, float, int, int]]:
        """Sets of options whose common approvers could pay for them out of their share of the budget, while none of them got as many options they approve."""
        got = self.likes[:, funded].sum(1) if funded else np.zeros(len(self.n), int)
        found, total = [], self.n.sum()
        for size in range(1, (len(self.names) if len(self.names) <= EXHAUSTIVE else PARTIAL) + 1):
            for t in itertools.combinations(range(len(self.names)), size):
                group = self.likes[:, t].all(1)
                n = self.n[group].sum()
                if n and n * self.budget >= self.cost[list(t)].sum() * total and got[group].max() < size:
                    found.append((",".join(self.names[o] for o in t), float(self.cost[list(t)].sum()), float(n), int(got[group].max()), size))
        return found


def _by_decision(ballots: DataFrame, options: DataFrame, run: Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run on the counted ballots and the options of each decision that has both."""
    votes = counted(ballots, options)
    held = votes.select(F.col("decision_ref").alias("paper_of")).distinct()
    paper = options.withColumnRenamed("decision_ref", "paper_of").join(held, "paper_of", "left_semi")
    return votes.groupBy("decision_ref").cogroup(paper.groupBy("paper_of")).applyInPandas(run, f"decision_ref string, {schema}")


def _decisions(ballots: DataFrame, options: DataFrame, kernel: Callable[[_Instance], pd.DataFrame], schema: str) -> DataFrame:
    run = lambda key, votes, paper: kernel(_Instance(votes, paper)).assign(decision_ref=key[0])
    return _by_decision(ballots, options.select("decision_ref", "option_ref", "cost", "budget"), run, schema)


_ROUNDS = "round int, option_ref string, cost double, rho double, supporters double, charged double"


def equal_shares(ballots: DataFrame, options: DataFrame, *, completion: str = "add1") -> DataFrame:
    """The method of equal shares: a row per funded option in the order of funding; ballots (decision_ref, approvals), options (decision_ref, option_ref, cost, budget).

    Every voter has budget / voters.  In a round each option costs its supporters rho, the least payment a head that covers it (those with less give all they have); the option with the least rho is
    funded (ties by name).  With completion 'add1' purses are raised evenly, by 2 % of the share or 1 if that is more, and the rounds run anew as long as the result fits the budget (500 times at most); with 'none' what is left is left.  Decisions
    without ballots or options give no rows.
    """
    if completion not in ("add1", "none"):
        raise ValueError("completion is add1 or none")

    def kernel(x: _Instance) -> pd.DataFrame:
        share = x.budget / x.n.sum()
        rounds = x.shares(share)
        spend = lambda rs: sum(x.cost[r[0]] for r in rs)
        purse = share
        for _ in range(500 if completion == "add1" else 0):
            purse += max(share * 0.02, 1.0)
            more = x.shares(purse)
            if spend(more) > x.budget:
                break
            if len(more) > len(rounds) or spend(more) > spend(rounds):
                rounds = more
            if spend(more) == x.budget or len(more) == len(x.names):
                break
        return pd.DataFrame([(i + 1, x.names[o], x.cost[o], rho, n, paid) for i, (o, rho, n, paid) in enumerate(rounds)], columns=["round", "option_ref", "cost", "rho", "supporters", "charged"])

    return _decisions(ballots, options, kernel, _ROUNDS)


def greedy_knapsack(ballots: DataFrame, options: DataFrame) -> DataFrame:
    """A row per funded option of the greedy rule: option_ref, cost, approvals, variant (density or best single option), total approvals of the decision and the most that the budget could buy."""

    def kernel(x: _Instance) -> pd.DataFrame:
        chosen, variant = x.greedy()
        total, best = float(x.support[chosen].sum()), x.optimum()
        return pd.DataFrame([(i + 1, x.names[o], x.cost[o], float(x.support[o]), variant, total, best) for i, o in enumerate(chosen)], columns=["round", "option_ref", "cost", "approvals", "variant", "total", "optimum"])

    return _decisions(ballots, options, kernel, "round int, option_ref string, cost double, approvals double, variant string, total double, optimum double")


def ejr_violations(ballots: DataFrame, options: DataFrame, funded: DataFrame) -> DataFrame:
    """Groups that extended justified representation entitles to more than funded (decision_ref, option_ref) gives them: options, cost, voters, best (of the group's voters), required, exhaustive.

    All sets of options are searched up to EXHAUSTIVE options of a decision, sets of up to PARTIAL beyond (exhaustive is false then: finding nothing proves nothing).
    """
    chosen = options.join(funded.select("decision_ref", "option_ref", F.lit(True).alias("funded")), ["decision_ref", "option_ref"], "left")

    def run(key: tuple, votes: pd.DataFrame, paper: pd.DataFrame) -> pd.DataFrame:
        x = _Instance(votes, paper)
        have = set(paper.option_ref[paper.funded.notna()])
        rows = [(key[0], *v, len(x.names) <= EXHAUSTIVE) for v in x.violations([i for i, o in enumerate(x.names) if o in have])]
        return pd.DataFrame(rows, columns=["decision_ref", "options", "cost", "voters", "best", "required", "exhaustive"])

    schema = "options string, cost double, voters double, best int, required int, exhaustive boolean"
    return _by_decision(ballots, chosen.select("decision_ref", "option_ref", "cost", "budget", "funded"), run, schema)


def fairness_report(ballots: DataFrame, options: DataFrame, funded: DataFrame, k: int = 5) -> DataFrame:
    """Share of the electorate and of the budget won by each stratum of a decision: ballots carry a stratum, too.

    A funded option's cost is split among those who approve it.  Strata of fewer than k voters are pooled as 'other', never dropped; a null one is 'unstated'.  utilisation is the share of the budget
    over the share of the electorate.
    """
    paper = options.groupBy("decision_ref").agg(F.collect_set("option_ref").alias("paper"))
    votes = ballots.select("decision_ref", F.coalesce("stratum", F.lit("unstated")).alias("stratum"), F.array_distinct(F.coalesce("approvals", F.array().cast("array<string>"))).alias("approvals"))
    valid = votes.join(paper, "decision_ref").where(F.size(F.array_except("approvals", "paper")) == 0)
    sizes = valid.groupBy("decision_ref", "stratum").agg(F.count(F.lit(1)).alias("n")).withColumn("shown", F.when(F.col("n") < k, "other").otherwise(F.col("stratum")))
    price = options.join(funded.select("decision_ref", "option_ref").distinct(), ["decision_ref", "option_ref"], "left_semi").select("decision_ref", "option_ref", "cost")
    backed = valid.select("decision_ref", "stratum", F.explode("approvals").alias("option_ref")).groupBy("decision_ref", "stratum", "option_ref").agg(F.count(F.lit(1)).alias("backers")).join(price, ["decision_ref", "option_ref"])
    all_backers = backed.groupBy("decision_ref", "option_ref").agg(F.sum("backers").alias("all_backers"))
    won = backed.join(all_backers, ["decision_ref", "option_ref"]).groupBy("decision_ref", "stratum").agg(F.sum(F.col("cost") * F.col("backers") / F.col("all_backers")).alias("won"))
    rows = sizes.join(won, ["decision_ref", "stratum"], "left").groupBy("decision_ref", F.col("shown").alias("stratum")).agg(F.sum("n").alias("voters"), F.sum(F.coalesce("won", F.lit(0.0))).alias("won"))
    whole = rows.groupBy("decision_ref").agg(F.sum("voters").alias("all_voters"), F.sum("won").alias("all_won"))
    r = rows.join(whole, "decision_ref").withColumn("electorate", F.col("voters") / F.col("all_voters")).withColumn("budget", F.coalesce(F.try_divide("won", "all_won"), F.lit(0.0)))
    return r.select("decision_ref", "stratum", "voters", "electorate", "won", F.col("budget").alias("share_won"), (F.col("budget") / F.col("electorate")).alias("utilisation"))
