"""Views of the star-schema tables as canonical streams.

Every view is a plan over Parquet scans: filters and column lists reach the scan.  Days are whole days between timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "1996-01-01", "2000-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(c: str | Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(c))


def _at(s: str) -> Column:
    return F.unix_date(F.to_date(F.lit(s)))


def request_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_ref, day, kind of each request: opened, then its first and second later shipment as terminal and acknowledgement candidates."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", day("o_orderdate").alias("opened"))
    ships = table(spark, sf_dir, "lineitem").select("l_orderkey", day("l_shipdate").alias("ship"))
    return orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey")).where("ship >= opened").select(F.col("o_orderkey").alias("request_ref"), F.col("ship").alias("day"))


def request_spells(spark: SparkSession, sf_dir: str, start: str = START, end: str = END) -> DataFrame:
    """A row per request opened before the window's end and not closed before its start.

    Open requests are censored at the end, requests opened before the start are at risk from the start on (left truncated); no row is
    filtered on a terminal time inside the window.  entry, exit and response are days since opening.
    """
    first = request_events(spark, sf_dir).groupBy("request_ref").agg(F.sort_array(F.collect_set("day")).alias("days"))  # a few lines an order
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    o = o.join(first, F.col("o_orderkey") == F.col("request_ref"), "left").select(
        F.col("o_orderkey").alias("request_ref"), day("o_orderdate").alias("opened"), F.get("days", F.lit(0)).alias("closed"), F.get("days", F.lit(1)).alias("replied"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("category"), (F.col("o_custkey") % 20).alias("assignee_ref"),
    )
    done = (F.col("status") != "O") & F.col("closed").isNotNull() & (F.col("closed") < _at(end))
    kind = F.when(~done, "open").when((F.col("status") == "P") & (F.col("request_ref") % 10 == 0), "escalated").when((F.col("status") == "P") & (F.col("request_ref") % 10 == 1), "withdrawn").otherwise("resolved")
    answered = F.col("replied").isNotNull() & (F.col("replied") < _at(end))
    return (
        o.withColumn("outcome", F.coalesce(kind, F.lit("open")))
        .where((F.col("outcome") == "open") | (F.col("closed") >= _at(start)))
        .select(
            "request_ref", "opened", "category", "assignee_ref", "outcome", (F.col("opened") < _at(start)).alias("left_truncated"),
            F.greatest(_at(start) - F.col("opened"), F.lit(0)).alias("entry"),
            (F.when(F.col("outcome") != "open", F.col("closed")).otherwise(_at(end)) - F.col("opened")).alias("exit"),
            (F.when(answered, F.col("replied")).otherwise(_at(end)) - F.col("opened")).alias("response"), answered.alias("answered"),
        )
    )


def member_spells(spark: SparkSession, sf_dir: str, end: str = END, idle: int = 180) -> DataFrame:
    """A membership from the first order on; it lapses `idle` days after the last order before the window's end, if that is before the end."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("member_ref")).agg(
        F.min(day("o_orderdate")).alias("entered"), F.max(day("o_orderdate")).alias("last"), F.count(F.lit(1)).alias("orders")
    )
    gone = F.col("last") + idle < _at(end)
    return o.select("member_ref", "entered", "orders", F.lit(0).alias("entry"), (F.when(gone, F.col("last") + idle).otherwise(_at(end)) - F.col("entered")).alias("exit"), gone.alias("event"))


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflow per order and outflow per line discount, in minor units, at the order's day."""
    orders = table(spark, sf_dir, "orders")
    minor = lambda c: F.round(c * 100).cast("long")
    inflow = orders.select(F.col("o_orderkey").alias("entry_ref"), F.to_date("o_orderdate").alias("at"), minor(F.col("o_totalprice")).alias("amount_minor"), F.lit("inflow").alias("direction"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (-minor(F.col("l_extendedprice") * F.col("l_discount"))).alias("amount_minor"))
    dated = orders.select("o_orderkey", F.to_date("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))
    outflow = lines.join(dated, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("entry_ref"), "at", "amount_minor", F.lit("outflow").alias("direction"), "status")
    return inflow.unionByName(outflow)


KINDS = {"click": "attend", "view": "read_receipt", "signup": "rsvp", "purchase": "volunteer_hours", "error": "comment"}


def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """member_ref, at, kind and weight of each event; a purchase's value is its weight."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("member_ref"), F.col("ts").alias("at"), F.coalesce(kind, F.lit("other")).alias("kind"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(1.0).alias("weight"), F.get_json_object("props", "$.k").cast("int").alias("object_ref"),
    )


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ballot per customer with orders: option, orders of it, and its tier (1 for most orders; equal counts share a tier)."""
    from pyspark.sql.window import Window

    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("voter_ref"), F.col("o_orderpriority").alias("option_ref")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("tier", F.dense_rank().over(Window.partitionBy("voter_ref").orderBy(F.desc("n"))))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicted probability and an outcome per line."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log of every request: opened by the customer, then a step for each further day with a shipment.

    Steps, in order: acknowledged by staff, paused, resumed, resolved (every seventh request: merged into its customer's first one), reopened, withdrawn, comment of staff.
    """
    steps = F.array(*[F.lit(k) for k in ("acknowledged", "paused", "resumed", "resolved", "reopened", "withdrawn", "comment")])
    days = request_events(spark, sf_dir).groupBy("request_ref").agg(F.sort_array(F.collect_set("day")).alias("days"))  # a few lines an order
    orders = table(spark, sf_dir, "orders")
    firsts = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.min("o_orderkey").alias("survivor"))
    o = orders.select("o_orderkey", "o_custkey", "o_orderpriority", day("o_orderdate").alias("opened")).join(firsts, F.col("o_custkey") == F.col("c"))
    o = o.join(days, F.col("o_orderkey") == F.col("request_ref"), "left").drop("request_ref")
    opened = F.array(F.struct(F.col("opened").alias("day"), F.lit("opened").alias("kind")))
    later = F.transform(F.coalesce("days", F.array().cast("array<int>")), lambda d, i: F.struct(d.alias("day"), F.get(steps, i).alias("kind")))
    o = o.withColumn("s", F.explode(F.concat(opened, later))).where("s.kind is not null")
    merged = (F.col("s.kind") == "resolved") & (F.col("o_orderkey") % 7 == 3) & (F.col("o_orderkey") != F.col("survivor"))
    staff = F.col("s.kind").isin("acknowledged", "comment")
    return o.select(
        F.col("o_orderkey").alias("request_ref"), F.timestamp_seconds(F.col("s.day").cast("long") * 86400).alias("at"), F.when(merged, "merged").otherwise(F.col("s.kind")).alias("kind"),
        F.when(staff, F.lit("staff")).otherwise(F.col("o_custkey").cast("string")).alias("actor_ref"), F.when(F.col("s.kind") == "acknowledged", F.col("o_custkey") % 20).alias("assignee_ref"),
        F.when(F.col("s.kind") == "opened", F.col("o_orderpriority")).alias("category"), F.when(merged, F.col("survivor")).alias("parent_ref"), F.lit(None).cast("timestamp").alias("at_upper"),
    )
