"""Spells of event logs, worked by hand."""

import datetime as dt

import pytest

from tallystream.operators.spells import spells_from_log

SCHEMA = "request_ref string, at timestamp, kind string, actor_ref string, assignee_ref string, category string, parent_ref string, at_upper timestamp"
DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def log(spark, rows):
    return spark.createDataFrame([(r, DAY(n), kind, *(x.get(c) for c in ("actor_ref", "assignee_ref", "category", "parent_ref")), DAY(x["upper"]) if "upper" in x else None) for r, n, kind, x in rows], SCHEMA)


def spells(df, **kw):
    return {r.spell_ref: r for r in spells_from_log(df, "2024-01-11", "2024-01-31", **kw).collect()}


TWICE = [("a", 12, "opened", {"actor_ref": "u"}), ("a", 13, "comment", {"actor_ref": "u"}), ("a", 14, "comment", {"actor_ref": "s"}), ("a", 15, "resolved", {}), ("a", 18, "reopened", {"actor_ref": "u"}), ("a", 21, "resolved", {})]


def test_reopening_splits_or_extends(spark):
    s = spells(log(spark, TWICE))
    assert {k: (r.duration_hours, r.outcome, r.parent_ref, r.first_response_hours, r.reopened_count) for k, r in s.items()} == {"a": (72, "resolved", None, 48, 0), "a#2": (72, "resolved", "a", None, 0)}
    (r,) = spells(log(spark, TWICE), reopen_policy="extend").values()
    assert (r.duration_hours, r.outcome, r.reopened_count) == (216, "resolved", 1)
    (r,) = spells(log(spark, TWICE[:-1]), reopen_policy="extend").values()
    assert (r.outcome, r.censoring, r.duration_hours) == (None, "administrative", 18 * 24)


def test_windows_brackets_and_lost_requests(spark):
    rows = [("gone", 1, "opened", {}), ("gone", 5, "resolved", {}), ("late", 30, "opened", {}), ("old", 2, "opened", {}), ("old", 12, "resolved", {"upper": 16}), ("silent", 11, "opened", {"category": "water"}), ("silent", 12, "assigned", {"assignee_ref": "x"})]
    s = spells(log(spark, rows))
    assert s.keys() == {"old", "silent"}
    o = s["old"]
    assert (o.left_truncated, o.censoring, o.interval_lo_hours, o.interval_hi_hours, o.terminal_at) == (True, "interval", 48, 144, None)
    assert (s["silent"].censoring, s["silent"].duration_hours, s["silent"].category, s["silent"].assignee_ref) == ("administrative", 19 * 24, "water", "x")
    lost = spells(log(spark, rows), lost_after_days=10)["silent"]
    assert (lost.censoring, lost.duration_hours) == ("lost", 24)


def test_pauses_and_merges(spark):
    rows = [("a", 8, "opened", {}), ("a", 9, "paused", {}), ("a", 10, "paused", {}), ("a", 12, "resumed", {}), ("a", 13, "resumed", {}), ("a", 15, "paused", {}), ("a", 20, "resolved", {}), ("a", 22, "resumed", {})]
    rows += [("b", 11, "opened", {}), ("b", 14, "merged", {"parent_ref": "a"}), ("c", 11, "opened", {}), ("c", 31, "merged", {"parent_ref": "a"})]
    s = spells(log(spark, rows), sla_clock="active")
    # At risk from day 10: paused on days 10-12 and 15-20 of 10.
    assert (s["a"].duration_hours, s["a"].paused_hours, s["a"].active_hours, s["a"].duplicate_count) == (240, 168, 72, 1)
    assert (s["b"].outcome, s["b"].parent_ref, s["c"].outcome) == ("merged", "a", None)
    assert spells(log(spark, rows))["a"].active_hours is None


def test_empty_logs_nulls_and_logs_without_a_start(spark):
    assert spells(log(spark, TWICE).limit(0)) == {}
    assert spells(log(spark, [(None, 12, "opened", {}), ("a", 12, "opened", {}), ("a", 13, None, {})]))["a"].censoring == "administrative"
    with pytest.raises(Exception, match="no opened event first"):
        spells(log(spark, [("a", 12, "comment", {}), ("a", 13, "opened", {})]))
    with pytest.raises(ValueError):
        spells_from_log(log(spark, TWICE), "2024-01-11", "2024-01-31", reopen_policy="merge")
