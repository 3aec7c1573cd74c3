"""Atoms to units.  Calendar buckets are equal-key aggregates on a truncated date, so no range join is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flow_periods(spells: DataFrame, start: str, end: str, period: str = "month") -> DataFrame:
    """Arrivals, terminals and backlog at both ends of every calendar period of a window (long runs of empty periods included)."""
    bucket = lambda c: F.to_date(F.date_trunc(period, F.date_from_unix_date(c.cast("int"))))
    moves = spells.select(F.explode(F.array(
        F.struct(bucket(F.col("opened")).alias("p"), F.lit(1).alias("arrived"), F.lit(0).alias("closed")),
        F.struct(F.when(F.col("outcome") != "open", bucket(F.col("opened") + F.col("exit"))).alias("p"), F.lit(0).alias("arrived"), F.lit(1).alias("closed")),
    )).alias("m")).select("m.*").where("p is not null")
    n = moves.groupBy("p").agg(F.sum("arrived").alias("arrivals"), F.sum("closed").alias("terminals"))
    all_periods = spells.sparkSession.sql(f"select explode(sequence(date'{start}', date'{end}' - interval 1 day, interval 1 {period})) as q")
    both = n.join(all_periods, F.col("p") == F.col("q"), "full").select(F.coalesce("p", "q").alias("period_start"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("arrivals", "terminals")])
    w = Window.orderBy("period_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("backlog_end", F.sum(F.col("arrivals") - F.col("terminals")).over(w)).withColumn("backlog_start", F.col("backlog_end") - F.col("arrivals") + F.col("terminals"))
    return out.where((F.col("period_start") >= F.lit(start).cast("date")) & (F.col("period_start") < F.lit(end).cast("date")))


def ledger_periods(entries: DataFrame, period: str = "month", opening: int = 0) -> DataFrame:
    """Settled inflow, outflow, net and closing balance per period; pending amounts stand under expected."""
    settled = F.col("status") == "F"
    way = lambda d: F.sum(F.when(settled & (F.col("direction") == d), F.col("amount_minor")).otherwise(0))
    p = entries.groupBy(F.to_date(F.date_trunc(period, "at")).alias("period_start")).agg(
        way("inflow").alias("inflow_minor"), (-way("outflow")).alias("outflow_minor"), F.sum(F.when(~settled, F.col("amount_minor")).otherwise(0)).alias("expected_minor")
    )
    p = p.withColumn("net_minor", F.col("inflow_minor") - F.col("outflow_minor"))
    return p.withColumn("closing_minor", opening + F.sum("net_minor").over(Window.orderBy("period_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def participation_periods(events: DataFrame, period: str = "week") -> DataFrame:
    """Active members, events and weight per period; reading receipts are exposures and count as events only."""
    active = F.col("kind") != "read_receipt"
    return events.groupBy(F.to_date(F.date_trunc(period, "at")).alias("period_start")).agg(
        F.countDistinct(F.when(active, F.col("member_ref"))).alias("active_members"), F.count(F.lit(1)).alias("events"), F.sum(F.when(active, F.col("weight"))).alias("total_weight")
    )


def engagement_features(events: DataFrame, now: str) -> DataFrame:
    """Recency, frequency, breadth and weights of each member at the window's end."""
    at = F.lit(now).cast("timestamp_ntz")
    e = events.where((F.col("at") < at) & (F.col("kind") != "read_receipt"))
    days = lambda c: F.date_diff(F.to_date(at), F.to_date(c))
    return e.groupBy("member_ref").agg(
        days(F.max("at")).alias("recency_days"), F.sum((days("at") <= 14).cast("long")).alias("frequency_14d"), F.countDistinct("kind").alias("breadth"),
        F.sum(F.when(F.col("kind") == "volunteer_hours", F.col("weight")).otherwise(0.0)).alias("volunteer_weight"), days(F.min("at")).alias("tenure_days"),
    )


def roster_snapshot(members: DataFrame, strata: str, end_field: str = "event") -> DataFrame:
    """Members present at the window's end, by stratum."""
    return members.where(~F.col(end_field)).groupBy(strata).agg(F.count(F.lit(1)).alias("n"))


def rate_observations(spells: DataFrame, by: str, success: str) -> DataFrame:
    """Successes and trials per group; an undetermined (null) verdict is no trial."""
    return spells.withColumn("ok", F.expr(success)).groupBy(F.col(by).alias("group_ref")).agg(F.count_if("ok").alias("successes"), F.count("ok").alias("trials"))


def count_observations(spells: DataFrame, by: str, end_day: int) -> DataFrame:
    """Events per group and the days since its first one."""
    return spells.groupBy(F.col(by).alias("group_ref")).agg(F.count(F.lit(1)).alias("events"), (end_day - F.min("opened")).alias("exposure_days"))


#: Members of a hot object that meet the others in one task, about.
MEMBERS = 1024


def interaction_edges(pairs: DataFrame, normalise: bool = True, members: int = MEMBERS) -> DataFrame:
    """Co-attendance edges of (object, member) pairs: a < b, 1/(m-1) for each shared object of m members (or 1).

    An object's members are dealt by hash into blocks of about `members`; pairs of blocks meet in tasks of their own, so that one object with many members is not one task.
    """
    seen = pairs.where("object_ref is not null and member_ref is not null").select("object_ref", "member_ref").distinct()
    sized = seen.join(seen.groupBy("object_ref").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "object_ref").withColumn("blocks", F.ceil(F.col("m") / members).cast("int"))
    dealt = sized.withColumn("own", F.pmod(F.xxhash64("member_ref"), F.col("blocks")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = dealt.select("object_ref", F.col("member_ref").alias("a_ref"), "m", F.col("own").alias("block_a"), all_blocks.alias("block_b"))
    b = dealt.select("object_ref", F.col("member_ref").alias("b_ref"), F.col("own").alias("block_b"), all_blocks.alias("block_a"))
    w = 1.0 / (F.col("m") - 1) if normalise else F.lit(1.0)
    return a.join(b, ["object_ref", "block_a", "block_b"]).where("a_ref < b_ref").groupBy("a_ref", "b_ref").agg(F.sum(w).alias("weight"), F.count(F.lit(1)).alias("objects"))


def tied_members(pairs: DataFrame) -> DataFrame:
    """member_ref of the members who share an object with another one; no pair is formed."""
    seen = pairs.where("object_ref is not null and member_ref is not null").select("object_ref", "member_ref")
    shared = seen.groupBy("object_ref").agg(F.min("member_ref").alias("low"), F.max("member_ref").alias("high")).where("low < high").select("object_ref")
    return seen.join(shared, "object_ref", "left_semi").select("member_ref").distinct()


def pairwise_results(ballots: DataFrame) -> DataFrame:
    """Winner, loser and drawn per ballot and pair of ranked options (tiers compare; unranked pairs are ignored)."""
    a, b = (ballots.select("voter_ref", F.col("option_ref").alias(f"{k}_ref"), F.col("tier").alias(f"{k}_tier")) for k in "ab")
    p = a.join(b, "voter_ref").where("a_ref < b_ref")
    first = F.col("a_tier") <= F.col("b_tier")
    return p.select("voter_ref", F.when(first, F.col("a_ref")).otherwise(F.col("b_ref")).alias("winner_ref"), F.when(first, F.col("b_ref")).otherwise(F.col("a_ref")).alias("loser_ref"), (F.col("a_tier") == F.col("b_tier")).alias("drawn"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Degree, inner weight and part of Newman's modularity of each community over (a_ref, b_ref, weight) and (member_ref, community)."""
    of = lambda k: communities.select(F.col("member_ref").alias(f"{k}_ref"), F.col("community").alias(f"c{k}"))
    e = edges.join(of("a"), "a_ref").join(of("b"), "b_ref").groupBy("ca", "cb").agg(F.sum("weight").alias("w"))
    ends = F.array(F.struct(F.col("ca").alias("community"), F.col("w").alias("d"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("i")), F.struct(F.col("cb").alias("community"), F.col("w").alias("d"), F.lit(0.0).alias("i")))
    c = e.select(F.explode(ends).alias("x")).groupBy("x.community").agg(F.sum("x.d").alias("degree"), F.sum("x.i").alias("inside"))
    m2 = F.sum("degree").over(Window.partitionBy())  # a row per community
    return c.withColumn("modularity", F.col("inside") / (m2 / 2) - (F.col("degree") / m2) ** 2)
