"""Edges of all orders against a plain loop."""

from collections import defaultdict
from itertools import combinations

import pytest

from tallystream.plans.catalogue import QUERIES

SMALL = "/root/testdata/sf0.001"


def edges_of(pairs):
    members = defaultdict(set)
    for o, m in pairs:
        members[o].add(m)
    weight, objects = defaultdict(float), defaultdict(int)
    for ms in members.values():
        for e in combinations(sorted(ms), 2):
            weight[e] += 1 / (len(ms) - 1)
            objects[e] += 1
    return {e: (pytest.approx(weight[e], abs=2e-6), objects[e]) for e in objects}


def test_edges_of_every_order(spark):
    want = edges_of((r.l_orderkey, r.l_suppkey) for r in spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect())
    got = QUERIES["reducer_interaction_edges"](spark, SMALL).collect()
    assert len(got) == len(want) and {(r.a_ref, r.b_ref): (r.weight, r.objects) for r in got} == want


def test_ties_in_any_order_count(spark, tmp_path):
    # Suppliers 1 and 2 meet in order 7, 3 and 4 in order 50; 5 is alone in order 8 and 6 has none.
    spark.createDataFrame([(7, 1), (7, 2), (50, 3), (50, 4), (8, 5), (8, 5)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "EVEN"), (1, "ODD")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {r.stratum: (r.members, r.isolated) for r in QUERIES["network_isolation_report"](spark, str(tmp_path)).collect()}
    assert got == {"EVEN": (3, 1), "ODD": (3, 1)}
