"""Stateful streams that need their rows in order: e-processes of experiments and Elo ratings of leagues.

A key's rows wait in its state until the watermark has passed them, are then taken in order of time (ties by name) and answered once.  Rows later than the watermark are dropped, as in any stream with one; so the
result equals the batch result over the rows that came in time.  State is what the recursion carries and the rows of the watermark's delay.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: From what is carried and a row (time in ms, name, further fields) to what is carried on and the answer's fields.
_Step = Callable[[Any, list], tuple[Any, tuple]]


def _taken_in_order(start: Any, fields: tuple[str, ...], step: _Step, names: list[str]) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried, waiting = (json.loads(x) for x in state.get) if state.exists else (start, [])
        for pdf in frames:
            waiting += pdf[["ms", *fields]].astype(object).to_numpy().tolist()
        passed = state.getCurrentWatermarkMs()
        ready, rest, out = sorted(r for r in waiting if r[0] <= passed), [r for r in waiting if r[0] > passed], []
        for row in ready:
            carried, answer = step(carried, row)
            out.append((*key, *row[:2], *answer))
        state.update((json.dumps(carried), json.dumps(rest)))
        if rest:
            state.setTimeoutTimestamp(max(min(r[0] for r in rest), passed + 1))
        yield pd.DataFrame(out, columns=names)

    return run


def _ordered(rows: DataFrame, key: str, fields: tuple[str, ...], late: str, start: Any, step: _Step, answer: str) -> DataFrame:
    timed = rows.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    schema = f"{key} string, ms long, {fields[0]} long, {answer}"
    names = [c.split()[0] for c in schema.split(", ")]
    run = _taken_in_order(start, fields, step, names)
    return timed.groupBy(F.col(key).cast("string").alias(key)).applyInPandasWithState(run, schema, "carried string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def e_processes(trials: DataFrame, rho: float, *, alpha: float = 0.05, late: str = "1 day") -> DataFrame:
    """The normal-mixture e-process of each experiment over first exposures (experiment, member_ref, at, arm, y), halves per arm: experiment, ms, member_ref, t, s, e, stop."""

    def step(carried: list, row: list) -> tuple[list, tuple]:
        _, _, arm, y = row
        t, s = carried[0] + 1, carried[1] + (2.0 if arm == 1 else -2.0) * y
        v = 4.0 * t + rho
        e = math.sqrt(rho / v) * math.exp(min(700.0, s * s / (2 * v)))
        return [t, s], (t, s, e, e >= 1 / alpha)

    return _ordered(trials, "experiment", ("member_ref", "arm", "y"), late, [0, 0.0], step, "t long, s double, e double, stop boolean")


def elo_ratings(games: DataFrame, *, k: float = 32.0, initial: float = 1500.0, late: str = "1 day") -> DataFrame:
    """Ratings after each game of each league (league, game, at, winner_ref, loser_ref, drawn): league, ms, game, winner_rating, loser_rating. State has a number per player of the league."""

    def step(ratings: dict, row: list) -> tuple[dict, tuple]:
        winner, loser, drawn = str(row[2]), str(row[3]), row[4]
        a, b = ratings.get(winner, initial), ratings.get(loser, initial)
        move = k * ((0.5 if drawn else 1.0) - 1 / (1 + 10 ** ((b - a) / 400)))
        ratings[winner], ratings[loser] = a + move, b - move
        return ratings, (a + move, b - move)

    return _ordered(games, "league", ("game", "winner_ref", "loser_ref", "drawn"), late, {}, step, "winner_rating double, loser_rating double")
