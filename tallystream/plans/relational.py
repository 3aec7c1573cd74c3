"""Relational reads and adapters over the star-schema tables, each with the SQL that it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.plans.catalogue import query
from tallystream.sources import adapters as D
from tallystream.sources import streams as A


def _count(name: str):
    return F.count(F.lit(1)).alias(name)


@query("relational_unread_counts", " --select SELECT user_id AS member_ref, count(*) AS items, count(*) FILTER (event_type <> 'view') AS unread FROM events GROUP BY 1")
def _(spark, d):
    return A.table(spark, d, "events").groupBy(F.col("user_id").alias("member_ref")).agg(_count("items"), F.count_if(F.col("event_type") != "view").alias("unread"))


@query("relational_notifications", " --select SELECT user_id AS member_ref, event_id AS item_ref, event_type AS kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events) WHERE rank <= 10")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = A.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts").withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return e.select(F.col("user_id").alias("member_ref"), F.col("event_id").alias("item_ref"), F.col("event_type").alias("kind"), "rank")


@query("relational_registrations_by_state", " --select SELECT l_orderkey AS event_ref, count(*) AS participants, count(*) FILTER (l_returnflag = 'R') AS checked_in, count(DISTINCT l_suppkey) AS members, max(l_extendedprice) FILTER (l_linestatus = 'F') AS best_result FROM lineitem GROUP BY 1", "best_result")
def _(spark, d):
    l = A.table(spark, d, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_orderkey").alias("event_ref")).agg(
        _count("participants"), F.count_if(F.col("l_returnflag") == "R").alias("checked_in"), F.countDistinct("l_suppkey").alias("members"), F.max(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))).alias("best_result")
    )


@query("relational_results_by_member", " --select SELECT * FROM (SELECT l_orderkey AS event_ref, l_suppkey AS member_ref, q AS result, rank() OVER (PARTITION BY l_orderkey ORDER BY q DESC)::INT AS place FROM (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)) WHERE place <= 3", "result")
def _(spark, d):
    q = A.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_ref"), F.col("l_suppkey").alias("member_ref")).agg(F.sum("l_quantity").alias("result"))
    return q.withColumn("place", F.rank().over(Window.partitionBy("event_ref").orderBy(F.desc("result")))).where("place <= 3")


@query("relational_memberships_by_state", " --select SELECT n_name AS group_name, count(*) FILTER (c_acctbal > 0) AS approved, count(*) FILTER (c_acctbal <= 0) AS pending, arg_min(c_name, c_custkey) AS leader, count(*) FILTER (c_mktsegment = 'BUILDING') > 0 AS has_builders FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(spark, d):
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("group_name"))
    c = A.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("group_name").agg(
        F.count_if(F.col("c_acctbal") > 0).alias("approved"), F.count_if(F.col("c_acctbal") <= 0).alias("pending"), F.min_by("c_name", "c_custkey").alias("leader"), (F.count_if(F.col("c_mktsegment") == "BUILDING") > 0).alias("has_builders")
    )


@query("relational_requests_of_member", " --select SELECT o_custkey AS member_ref, o_orderkey AS request_ref, o_orderstatus AS status, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS n FROM orders) WHERE n <= 5")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate").withColumn("n", F.row_number().over(w)).where("n <= 5")
    return o.select(F.col("o_custkey").alias("member_ref"), F.col("o_orderkey").alias("request_ref"), F.col("o_orderstatus").alias("status"), "n")


@query("relational_leader_queue", """ --select SELECT n_name AS group_name, o_orderkey AS request_ref, place FROM (SELECT n_name, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INT AS place
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P') WHERE place <= 20""")
def _(spark, d):
    n = A.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("group_name"))
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = A.table(spark, d, "orders").where("o_orderstatus = 'P'").join(c, F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("group_name").orderBy("o_orderpriority", "o_orderdate", "o_orderkey")
    return o.select("group_name", F.col("o_orderkey").alias("request_ref"), F.row_number().over(w).alias("place")).where("place <= 20")


@query("relational_open_counts", " --select SELECT o_orderpriority AS kind, count(*) FILTER (o_orderstatus = 'P') AS escalated, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus <> 'F') AS open FROM orders GROUP BY 1")
def _(spark, d):
    s = F.col("o_orderstatus")
    return A.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count_if(s == "P").alias("escalated"), F.count_if(s == "O").alias("pending"), F.count_if(s != "F").alias("open"))


@query("relational_dues_by_member", " --select SELECT o_custkey AS member_ref, count(*) AS dues, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS due_minor, (coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'F'), 0))::BIGINT AS settled_minor, min(o_orderdate)::DATE AS first_due FROM orders GROUP BY 1")
def _(spark, d):
    minor = F.round(F.col("o_totalprice") * 100).cast("long")
    return A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("member_ref")).agg(
        _count("dues"), F.sum(minor).alias("due_minor"), F.sum(F.when(F.col("o_orderstatus") == "F", minor).otherwise(0)).alias("settled_minor"), F.to_date(F.min("o_orderdate")).alias("first_due")
    )


@query("relational_unlinked_payments", " --select SELECT l_orderkey AS due_ref, l_linenumber AS payment_no, l_extendedprice AS amount FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')", "amount")
def _(spark, d):
    due = A.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("due_ref"))
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("due_ref"), F.col("l_linenumber").alias("payment_no"), F.col("l_extendedprice").alias("amount")).join(due, "due_ref", "left_anti")


@query("relational_latest_runs_by_params", " --select SELECT o_custkey AS scope, o_orderpriority AS params, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_ref, count(*) AS runs FROM orders GROUP BY 1, 2")
def _(spark, d):
    latest = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("params")).agg(latest.alias("run_ref"), _count("runs"))


@query("relational_run_history", " --select SELECT o_custkey AS scope, o_orderkey AS run_ref, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return A.table(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("run_ref"), F.lag("o_orderkey").over(w).alias("supersedes"), F.lead("o_orderkey").over(w).alias("superseded_by"))


@query("relational_certificate_context", """ --select SELECT o_orderkey AS certificate_ref, c_name AS holder, s.holder_nation, i.n_name AS issuer_nation, c_nationkey = s_nationkey AS home FROM (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) l
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN (SELECT n_nationkey AS hk, n_name AS holder_nation FROM nation) s ON hk = c_nationkey JOIN supplier ON s_suppkey = k JOIN nation i ON i.n_nationkey = s_nationkey""")
def _(spark, d):
    nation = A.table(spark, d, "nation")
    holder, issuer = (nation.select(F.col("n_nationkey").alias(f"{k}_key"), F.col("n_name").alias(f"{k}_nation")) for k in ("holder", "issuer"))  # one table under two names
    first = A.table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("k"))
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    c = A.table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("holder"), "c_nationkey").join(holder, F.col("c_nationkey") == F.col("holder_key"))
    s = A.table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(issuer, F.col("s_nationkey") == F.col("issuer_key"))
    r = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("k") == F.col("s_suppkey"))
    return r.select(F.col("o_orderkey").alias("certificate_ref"), "holder", "holder_nation", "issuer_nation", (F.col("c_nationkey") == F.col("s_nationkey")).alias("home"))


@query("relational_certificates_by_member", " --select SELECT o_custkey AS member_ref, count(DISTINCT o_orderkey) AS certificates, max(l_shipdate)::DATE AS latest FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus = 'F' GROUP BY 1")
def _(spark, d):
    l = A.table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))  # noqa: E741
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.groupBy(F.col("o_custkey").alias("member_ref")).agg(_count("certificates"), F.to_date(F.max("at")).alias("latest"))


@query("relational_slug_prefixes", " --select SELECT p_brand AS slug, (SELECT count(DISTINCT x.p_brand) FROM part x WHERE starts_with(x.p_brand, p.p_brand)) AS taken FROM (SELECT DISTINCT p_brand FROM part) p")
def _(spark, d):
    brands = A.table(spark, d, "part").select("p_brand").distinct()
    # Every prefix of a slug is a key, so the count by prefix is an equi-join.
    prefixes = brands.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p_brand")), lambda n: F.substring("p_brand", F.lit(1), n))).alias("slug")).groupBy("slug").agg(_count("taken"))
    return brands.select(F.col("p_brand").alias("slug")).join(prefixes, "slug")


# --- Adapters -------------------------------------------------------------------------------------------


@query("adapter_vocabulary", """ --select SELECT kind, count(*) AS n, count(*) FILTER (mapped IS NULL) AS unmapped FROM (SELECT coalesce(mapped, 'other') AS kind, mapped FROM (SELECT CASE event_type WHEN 'click' THEN 'attend' WHEN 'view' THEN 'read_receipt' WHEN 'signup' THEN 'rsvp' END AS mapped FROM events)) GROUP BY 1""")
def _(spark, d):
    e = D.mapped(A.table(spark, d, "events"), "event_type", {"click": "attend", "view": "read_receipt", "signup": "rsvp"}, "kind")
    return e.groupBy("kind").agg(_count("n"), F.count_if("unmapped").alias("unmapped"))


@query("adapter_strata", " --select SELECT c_custkey AS member_ref, coalesce(c_mktsegment, 'unstated') AS segment, CASE WHEN c_acctbal < 0 THEN 'debit' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance_band FROM customer")
def _(spark, d):
    c = A.table(spark, d, "customer")
    return D.strata(c, "c_custkey", {"segment": F.col("c_mktsegment"), "balance_band": D.banded(F.col("c_acctbal"), [(0.0, "debit"), (5000.0, "low")], "high")})


@query("adapter_pseudonyms", " --select SELECT 'm_' || left(sha256('rotating-key:member:' || c_custkey), 16) AS member_ref, count(o_orderkey) AS requests FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", D.pseudonym(F.col("c_custkey"), "member", "rotating-key").alias("member_ref"))
    return c.join(A.table(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("member_ref").agg(F.count("o_orderkey").alias("requests"))
