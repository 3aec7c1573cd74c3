"""Participation periods of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_participation(events: DataFrame, *, late: str = "1 day", length: str = "7 days") -> DataFrame:
    """Events, weight and (approximately) active members per window; rows later than the watermark are dropped, closed windows are emitted once in append mode."""
    e = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", length).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("weight").alias("total_weight"), F.approx_count_distinct("member_ref").alias("active_members")
    ).select(F.col("w.start").alias("period_start"), "events", "total_weight", "active_members")
