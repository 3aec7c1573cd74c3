"""Calendar periods in local time: days that are 23 or 25 hours long count as what they are, whatever the session's time zone is.

Times are UTC without a zone (timestamp_ntz); periods go by their first local day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The periods, and the length of one as an interval.
PERIODS = {"day": "1 day", "week": "7 day", "month": "1 month", "quarter": "3 month", "year": "12 month"}


def _checked(period: str) -> str:
    if period not in PERIODS:
        raise ValueError(f"period is one of {', '.join(PERIODS)}")
    return period


def local_period(at: Column, period: str, zone: str) -> Column:
    """The first local day of the period (weeks begin on Monday) that a UTC time lies in."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")))
    return day if _checked(period) == "day" else F.trunc(day, period)


def period_bounds(spark: SparkSession, start: str, end: str, period: str = "week", zone: str = "UTC") -> DataFrame:
    """The periods that cover the UTC window from start up to end: period_start (local day), start_utc, end_utc, days (of 24 hours), complete (wholly inside the window).

    Bounds are those of the calendar, never clipped, so a half-covered first or last period is marked and not mistaken for a fall.  A window that ends where it begins, or before, has no periods.
    """
    ends = spark.range(1).select(*[F.to_timestamp_ntz(F.lit(x)).alias(n) for n, x in (("start", start), ("end", end))]).where("start < end")
    first, last = local_period(F.col("start"), period, zone), local_period(F.col("end") - F.expr("interval 1 microsecond"), period, zone)
    step = F.expr(f"interval {PERIODS[period]}")
    rows = ends.select("start", "end", F.explode(F.sequence(first, F.greatest(first, last), step)).alias("period_start"))
    utc = lambda c: F.convert_timezone(F.lit(zone), F.lit("UTC"), c.cast("timestamp_ntz"))
    bound = rows.select("start", "end", "period_start", utc(F.col("period_start")).alias("start_utc"), utc((F.col("period_start") + step).cast("date")).alias("end_utc"))
    seconds = F.timestamp_diff("SECOND", F.col("start_utc"), F.col("end_utc"))
    return bound.select("period_start", "start_utc", "end_utc", (seconds / 86400).alias("days"), ((F.col("start_utc") >= F.col("start")) & (F.col("end_utc") <= F.col("end"))).alias("complete"))


def counts_by_period(events: DataFrame, start: str, end: str, period: str = "week", zone: str = "UTC") -> DataFrame:
    """Events (at, UTC) of the window by local period: period_start, events, per_day (by the period's true length), days, complete; periods without events have 0, a null time belongs to none.

    Events are counted by equal keys; the table of periods is as long as the window.
    """
    inside = events.select(F.col("at").cast("timestamp_ntz").alias("at")).where((F.col("at") >= F.to_timestamp_ntz(F.lit(start))) & (F.col("at") < F.to_timestamp_ntz(F.lit(end))))
    n = inside.groupBy(local_period(F.col("at"), period, zone).alias("period_start")).agg(F.count(F.lit(1)).alias("events"))
    every = period_bounds(events.sparkSession, start, end, period, zone)
    count = F.coalesce("events", F.lit(0))
    return every.join(n, "period_start", "left").select("period_start", count.alias("events"), (count / F.col("days")).alias("per_day"), "days", "complete")
