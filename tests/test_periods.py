"""Local periods against the calendar of the standard library."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tallystream.operators import periods as P

UTC = dt.timezone.utc


def floor(day, period):
    return {"day": day, "week": day - dt.timedelta(days=day.weekday()), "month": day.replace(day=1), "quarter": day.replace(month=3 * ((day.month - 1) // 3) + 1, day=1), "year": day.replace(month=1, day=1)}[period]


def after(day, period):
    if period in ("day", "week"):
        return day + dt.timedelta(days=1 if period == "day" else 7)
    months = day.month - 1 + {"month": 1, "quarter": 3, "year": 12}[period]
    return day.replace(year=day.year + months // 12, month=months % 12 + 1)


@pytest.mark.parametrize("period", list(P.PERIODS))
@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_bounds_are_those_of_the_calendar(spark, period, zone):
    z, start, end = ZoneInfo(zone), dt.datetime(2023, 10, 30, 3), dt.datetime(2024, 4, 2, 5)
    day, want = floor(start.replace(tzinfo=UTC).astimezone(z).date(), period), []
    while True:
        nxt = after(day, period)
        a, b = (dt.datetime(d.year, d.month, d.day, tzinfo=z).astimezone(UTC).replace(tzinfo=None) for d in (day, nxt))
        if a >= end:
            break
        want.append((day, a, b, (b - a).total_seconds() / 86400, a >= start and b <= end))
        day = nxt
    got = [tuple(r) for r in P.period_bounds(spark, str(start), str(end), period, zone).orderBy("period_start").collect()]
    assert got == want


def test_events_go_to_their_local_period(spark):
    rng, z = random.Random(1), ZoneInfo("America/New_York")
    times = [dt.datetime(2024, 3, 1) + dt.timedelta(minutes=rng.randrange(30 * 1440)) for _ in range(500)] + [None]
    d = spark.createDataFrame([(t,) for t in times], "at timestamp_ntz")
    got = {r.period_start: (r.events, r.days) for r in P.counts_by_period(d, "2024-03-01 00:00:00", "2024-03-25 00:00:00", "day", "America/New_York").collect()}
    want = {}
    for t in times:
        if t and t < dt.datetime(2024, 3, 25):
            day = t.replace(tzinfo=UTC).astimezone(z).date()
            want[day] = want.get(day, 0) + 1
    assert {k: n for k, (n, _) in got.items() if n} == want and got[dt.date(2024, 3, 10)][1] == 23 / 24 and len(got) == 25
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # the session's zone plays no part
    try:
        again = {r.period_start: (r.events, r.days) for r in P.counts_by_period(d, "2024-03-01 00:00:00", "2024-03-25 00:00:00", "day", "America/New_York").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert again == got


def test_no_window_and_other_periods(spark):
    assert P.period_bounds(spark, "2024-01-02", "2024-01-02", "day").collect() == [] and P.period_bounds(spark, "2024-01-02", "2024-01-01", "day").collect() == []
    with pytest.raises(ValueError):
        P.local_period(F.lit(None), "fortnight", "UTC")
