"""Event logs of requests to spells: reopening, merges, pauses, bracketed ends and two clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds that end a request, kinds that answer it, and the order of kinds at one instant.
TERMINAL = ("resolved", "escalated", "withdrawn", "merged")
RESPONSE = ("acknowledged", "comment")
ORDER = ("opened", "acknowledged", "assigned", "reassigned", "status_change", "comment", "paused", "resumed", "resolved", "escalated", "withdrawn", "merged", "closed", "reopened")


def _hours(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def spells_from_log(events: DataFrame, start: str, end: str, *, reopen_policy: str = "new_spell", sla_clock: str = "wall", lost_after_days: float | None = None) -> DataFrame:
    """A row per spell of a log (request_ref, at, kind, actor_ref, assignee_ref, category, parent_ref, at_upper) that was open in [start, end).

    new_spell ends a spell at its terminal and starts another at a reopening (ref#2, ref#3, ...); extend keeps one spell, whose terminal is the last
    that no reopening undid, and counts the reopenings.  Spells without a terminal before the end are censored there (administrative), or at their last event if that is more
    than lost_after_days back (lost).  A terminal with at_upper happened somewhere between at and at_upper (interval): no time is made up for it.
    Spells opened before start are at risk from start on.  active_hours is filled for the active clock only, less paused time.  Merged requests stay,
    and count as duplicates of the request they were merged into.  Category and assignee are the last ones seen in the observed part.
    A request without an opened event raises an error, as its clock has no start; rows without request_ref, at or kind are left out.
    All steps after the first shuffle stay with their request.
    """
    if reopen_policy not in ("new_spell", "extend") or sla_clock not in ("wall", "active"):
        raise ValueError(f"unknown reopen policy or clock: {reopen_policy}, {sla_clock}")
    lo, hi = (F.lit(x).cast("timestamp") for x in (start, end))
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind"))
    e = events.where("request_ref is not null and at is not null and kind is not null").withColumn("request_ref", F.col("request_ref").cast("string"))
    e = e.withColumn("at", F.col("at").cast("timestamp")).withColumn("at_upper", F.col("at_upper").cast("timestamp")).withColumn("rank", F.when(rank > 0, rank).otherwise(len(ORDER) + 1))
    w = Window.partitionBy("request_ref").orderBy("at", "rank", "kind", F.col("actor_ref"))
    e = e.withColumn("seq", F.row_number().over(w))
    e = e.withColumn("seq", F.when((F.col("seq") > 1) | (F.col("kind") == "opened"), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("no opened event first: "), "request_ref")).cast("int")))
    reopened = F.col("kind") == "reopened"
    e = e.withColumn("episode", F.sum(reopened.cast("int")).over(w) if reopen_policy == "new_spell" else F.lit(0).cast("long"))
    # Pauses: a pause within a pause and a resumption without one count for nothing.
    inside = w.rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("kind").isin("paused", "resumed"), F.struct("episode", "kind"))
    before = F.last(turn, ignorenulls=True).over(inside)
    fresh = ~F.coalesce((before["kind"] == "paused") & (before["episode"] == F.col("episode")), F.lit(False))
    later = F.first(F.when(F.col("kind") == "resumed", F.struct("episode", "at")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    e = e.withColumn("pause", F.when((F.col("kind") == "paused") & fresh, F.struct(F.col("at").alias("a"), F.when(later["episode"] == F.col("episode"), later["at"]).alias("b"))))

    pick = lambda when, *c: F.when(when, F.struct("seq", *c))
    own = e.groupBy("request_ref", "episode").agg(
        F.min(F.struct("seq", "at", "actor_ref")).alias("first"), F.max(pick(F.col("kind").isin(*TERMINAL), "at", "at_upper", "kind", "parent_ref")).alias("t"),
        F.max(F.when(reopened, F.col("seq"))).alias("undone"), F.sum(reopened.cast("int")).alias("reopenings"), F.max(F.when(F.col("at") < hi, F.col("at"))).alias("seen"),
        F.sort_array(F.collect_list(F.struct("seq", "at", "kind", "actor_ref", "assignee_ref", "category"))).alias("log"), F.collect_list("pause").alias("pauses"),
    )  # a log is that of one request
    own = own.withColumn("opened_at", F.col("first.at")).withColumn("t", F.when(F.col("undone").isNull() | (F.col("t.seq") > F.col("undone")), F.col("t")))
    next_at = F.lead("opened_at").over(Window.partitionBy("request_ref").orderBy("episode"))
    own = own.withColumn("until", F.coalesce(next_at, hi)).withColumn("reopened_count", F.col("reopenings") if reopen_policy == "extend" else F.lit(0).cast("long"))

    merges = e.where("kind = 'merged' and parent_ref is not null").groupBy(F.col("parent_ref").cast("string").alias("survivor"), F.col("at").alias("merged_at")).agg(F.count(F.lit(1)).alias("n"))
    hits = own.select("request_ref", "episode", "opened_at", "until").join(merges, (F.col("request_ref") == F.col("survivor")) & (F.col("merged_at") >= F.col("opened_at")) & (F.col("merged_at") < F.col("until")))
    own = own.join(hits.groupBy("request_ref", "episode").agg(F.sum("n").alias("duplicates")), ["request_ref", "episode"], "left")

    own = own.where((F.col("opened_at") < hi) & ~F.coalesce(F.greatest("t.at", "t.at_upper") < lo, F.lit(False)))
    s = own.withColumn("from", F.greatest("opened_at", lo)).withColumn("done", F.coalesce(F.col("t.at") < hi, F.lit(False)))
    s = s.withColumn("interval", F.col("done") & F.col("t.at_upper").isNotNull())
    lost = ~F.col("done") & (F.lit(False) if lost_after_days is None else F.coalesce(_hours(F.col("seen"), hi) > 24 * lost_after_days, F.lit(False)))
    s = s.withColumn("lost", lost).withColumn("stop", F.when(F.col("done"), F.greatest("from", "t.at")).when(F.col("lost"), F.greatest("from", "seen")).otherwise(hi))
    wall = _hours(F.col("from"), F.col("stop"))
    paused = F.aggregate(
        "pauses", F.lit(0.0), lambda x, p: x + F.greatest(F.lit(0.0), _hours(F.greatest(p["a"], F.col("from")), F.least(F.coalesce(p["b"], F.col("stop")), F.col("stop"))))
    )
    s = s.withColumn("wall", wall).withColumn("paused_hours", paused)
    seen = lambda c: F.try_element_at(F.filter("log", lambda x: (x["at"] <= F.col("stop")) & (F.coalesce(x[c].cast("string"), F.lit("")) != "")), F.lit(-1))
    answers = F.filter("log", lambda x: x["kind"].isin(*RESPONSE) & (x["at"] < hi) & (x["actor_ref"] != F.coalesce(F.col("first.actor_ref"), F.lit("").cast("string"))))
    upper = F.least(F.col("t.at_upper"), hi)
    return s.select(
        F.when(F.col("episode") > 0, F.concat_ws("#", "request_ref", F.col("episode") + 1)).otherwise(F.col("request_ref")).alias("spell_ref"),
        F.when(F.col("episode") > 0, F.col("request_ref")).otherwise(F.when(F.col("done"), F.col("t.parent_ref").cast("string"))).alias("parent_ref"),
        "opened_at", F.col("from").alias("at_risk_from"), (F.col("opened_at") < lo).alias("left_truncated"), F.col("wall").alias("duration_hours"),
        (F.greatest(F.lit(0.0), F.col("wall") - F.col("paused_hours")) if sla_clock == "active" else F.lit(None).cast("double")).alias("active_hours"), "paused_hours",
        F.when(F.col("done"), F.col("t.kind")).alias("outcome"), F.when(F.col("done") & ~F.col("interval"), F.col("t.at")).alias("terminal_at"),
        F.when(F.col("interval"), "interval").when(F.col("done"), "none").when(F.col("lost"), "lost").otherwise("administrative").alias("censoring"),
        F.when(F.col("interval"), F.col("wall")).alias("interval_lo_hours"), F.when(F.col("interval"), F.greatest("wall", _hours(F.col("from"), upper))).alias("interval_hi_hours"),
        _hours(F.col("opened_at"), F.get(answers, F.lit(0))["at"]).alias("first_response_hours"),
        "reopened_count", F.coalesce("duplicates", F.lit(0)).alias("duplicate_count"), F.coalesce(seen("category")["category"], F.lit("other")).alias("category"), seen("assignee_ref")["assignee_ref"].alias("assignee_ref"),
    )
