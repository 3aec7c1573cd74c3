"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.tables import drop, spread, written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (u, v), both long; component is the smallest node reachable.

    Each round joins every edge with its node's smallest neighbour, so the edges become stars around the smallest
    nodes; the rounds needed grow with the logarithm of the longest path.  Loops, repeated edges and nulls do no harm; no edges give no rows.
    A node with many neighbours is joined in many tasks.
    """
    e = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(e)
    # Always true; it keeps both columns of the aggregates below, so that their two readers share one shuffle.
    whole = "n > 0 and m is not null"
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where(whole)
        low = least.select("u", F.least("u", "m").alias("m"))
        links, to = spread(both.where("v > u"), low, "u", 2 * mark[0], least)
        large = links.join(to, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where(whole)
        low2 = least.select("u", "m")
        links, to = spread(large, low2, "u", 2 * mark[0], least)
        small = links.join(to, ["u", "salt"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        now = _mark(nxt)
        drop(e)
        e = nxt
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
