"""Communities and connectors against published answers and plain loops."""

import random
from collections import defaultdict, deque

import pytest

from tallystream.functions import networks as N
from tallystream.operators import reducers as R

#: The ties of Zachary's karate club, and the faction of its instructor.
KARATE = {
    0: [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 17, 19, 21, 31], 1: [2, 3, 7, 13, 17, 19, 21, 30], 2: [3, 7, 8, 9, 13, 27, 28, 32], 3: [7, 12, 13], 4: [6, 10], 5: [6, 10, 16], 6: [16],
    8: [30, 32, 33], 9: [33], 13: [33], 14: [32, 33], 15: [32, 33], 18: [32, 33], 19: [33], 20: [32, 33], 22: [32, 33], 23: [25, 27, 29, 32, 33], 24: [25, 27, 31], 25: [31], 26: [29, 33],
    27: [33], 28: [31, 33], 29: [32, 33], 30: [32, 33], 31: [32, 33], 32: [33],
}
INSTRUCTOR = {0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 16, 17, 19, 21}


@pytest.fixture(scope="module")
def karate(spark):
    return spark.createDataFrame([(a, b, 1.0) for a, bs in KARATE.items() for b in bs], "a_ref long, b_ref long, weight double").cache()


def test_karate_club_has_four_communities(spark, karate):
    found = N.communities(karate).collect()
    of = {r.member_ref: r.community for r in found}
    groups = defaultdict(set)
    for m, c in of.items():
        groups[c].add(m)
    q = sum(r.modularity for r in R.modularity(karate, spark.createDataFrame(list(of.items()), "member_ref long, community long")).collect())
    assert len(of) == 34 and len(groups) == 4 and 0.41 < q < 0.43, (len(groups), q)
    assert all(c == min(g) for c, g in groups.items()) and of[0] != of[33]
    assert sum(max(len(g & INSTRUCTOR), len(g - INSTRUCTOR)) for g in groups.values()) >= 32
    assert [tuple(r) for r in sorted(N.communities(karate.repartition(7)).collect())] == [tuple(r) for r in sorted(found)]


def test_degree_null_keeps_degrees_and_has_less_structure(spark, karate):
    null = N.degree_null(karate, 3)
    degree = lambda rows: {m: sum((r.a_ref == m) + (r.b_ref == m) for r in rows) for m in range(34)}
    have, want = degree(null.collect()), degree(karate.collect())
    assert all(have[m] <= want[m] for m in want) and sum(want.values()) - sum(have.values()) < 16
    q = sum(r.modularity for r in R.modularity(null, N.communities(null)).collect())
    assert q < 0.40


def test_cliques_loops_and_nothing(spark):
    rows = [(a, b, 1.0) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1), (14, 20, 0.1), (3, 3, 50.0), (None, 3, 1.0), (3, None, 1.0), (1, 2, None)]
    d = spark.createDataFrame(rows, "a_ref long, b_ref long, weight double")
    assert {r.member_ref: r.community for r in N.communities(d).collect()} == {m: m // 10 * 10 for base in (0, 10, 20) for m in range(base, base + 5)}
    assert N.communities(spark.createDataFrame([], "a_ref long, b_ref long, weight double")).collect() == []


def test_karate_betweenness_is_the_published_one(karate):
    got = {r.member_ref: r.betweenness for r in N.betweenness(karate).collect()}
    for node, published in {0: 0.43764, 33: 0.30407, 32: 0.14525, 2: 0.14366, 31: 0.13828}.items():
        assert abs(got[node] - published) < 1e-5
    assert sorted(got, key=lambda m: -got[m])[:2] == [0, 33] and len(got) == 34


def test_paths_stars_and_parts(spark):
    path = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "a_ref int, b_ref int, weight double")
    assert {r.member_ref: round(r.betweenness, 9) for r in N.betweenness(path, normalised=False).collect()} == {i: i * (9 - i) for i in range(10)}
    star = spark.createDataFrame([("c", f"l{i}", 1.0) for i in range(9)] + [("c", "l0", 1.0), ("c", "c", 1.0)], "a_ref string, b_ref string, weight double")
    assert {r.member_ref: (round(r.betweenness, 12), r.degree) for r in N.betweenness(star).collect()} == {"c": (1.0, 9), **{f"l{i}": (0.0, 1) for i in range(9)}}
    assert N.betweenness(star.limit(0)).collect() == []


def brandes(ties):
    score = dict.fromkeys(ties, 0.0)
    for s in ties:
        dist, paths, order, line = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while line:
            v = line.popleft()
            order.append(v)
            for w in ties[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    line.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        share = defaultdict(float)
        for w in reversed(order):
            for v in ties[w]:
                if dist[v] == dist[w] - 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w] / 2
    return score


def test_random_graph_in_parts_and_pivots(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)} | {(100 + rng.randrange(8), 100 + rng.randrange(8)) for _ in range(9)}
    ties = defaultdict(set)
    for a, b in pairs:
        if a != b:
            ties[a].add(b)
            ties[b].add(a)
    d = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a_ref int, b_ref int, weight double")
    want = brandes(ties)
    got = {r.member_ref: r.betweenness for r in N.betweenness(d, normalised=False).collect()}
    assert got.keys() == want.keys() and all(abs(got[m] - want[m]) < 1e-9 for m in want)
    assert {r.member_ref: r.betweenness for r in N.betweenness(d, normalised=False, pivots=len(want)).collect()} == pytest.approx(got)
    some = {r.member_ref: r.betweenness for r in N.betweenness(d, normalised=False, pivots=20).collect()}
    assert sum(some.values()) == pytest.approx(sum(want.values()), rel=0.4)


def ties_of(pairs):
    ties = defaultdict(set)
    for a, b in pairs:
        if a != b:
            ties[a].add(b)
            ties[b].add(a)
    return ties


def test_registered_betweenness_takes_every_member_as_a_source(spark, tmp_path):
    from tallystream.plans.services import betweenness_centrality

    rng = random.Random(5)
    lines = [(o, rng.randrange(180)) for o in range(400) for _ in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = brandes(ties_of([(x[1], y[1]) for x, y in zip(lines[::2], lines[1::2])]))
    got = {r.member_ref: r.betweenness for r in betweenness_centrality(spark, str(tmp_path)).collect()}
    pairs = (len(want) - 1) * (len(want) - 2) / 2
    assert len(want) > 128 and got == pytest.approx({m: x / pairs for m, x in want.items()}, abs=1e-12)


@pytest.mark.parametrize(("nodes", "ties", "piece"), [(60, 70, 5), (60, 900, 64), (40, 780, 1 << 20)])
def test_walk_by_pieces_from_either_side(nodes, ties, piece):
    import numpy as np

    from tallystream.functions.adjacency import Walk

    rng = random.Random(ties)
    of = ties_of([(i, (i + 1) % nodes) for i in range(nodes)] + [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(ties)])
    walk = Walk(np.cumsum([0] + [len(of[i]) for i in range(nodes)]), np.array([b for i in range(nodes) for b in sorted(of[i])], np.int32))
    walk.piece = piece
    got = np.zeros(nodes)
    for source in range(nodes):
        inner, share = walk.shares(source)
        got[inner] += share / 2
    want = brandes(of)
    assert got.tolist() == pytest.approx([want[i] for i in range(nodes)], abs=1e-9)


def test_large_parts_are_dealt_and_small_ones_packed(spark, monkeypatch):
    from tallystream.functions import adjacency

    monkeypatch.setattr(adjacency, "SMALL", 4)
    monkeypatch.setattr(adjacency, "UNIT", 50)
    monkeypatch.setattr(adjacency, "ROW", 3)
    rng = random.Random(11)
    pairs = [(f"g{rng.randrange(25)}", f"g{rng.randrange(25)}") for _ in range(60)] + [(f"s{i}-{j}", f"s{i}-{j + 1}") for i in range(9) for j in range(i % 3 + 1)]
    want = brandes(ties_of(pairs))
    d = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a_ref string, b_ref string, weight double")
    got = {r.member_ref: (r.betweenness, r.degree) for r in N.betweenness(d, normalised=False).collect()}
    assert {m: x for m, (x, _) in got.items()} == pytest.approx(want, abs=1e-9) and {m: k for m, (_, k) in got.items()} == {m: len(t) for m, t in ties_of(pairs).items()}


def test_sweeps_over_rows_make_the_moves_of_sweeps_by_joins(spark):
    rng = random.Random(3)
    rows = [(f"m{a}", f"m{b}", rng.choice((1.0, 0.5, 0.25))) for a, b in ((rng.randrange(70), rng.randrange(70)) for _ in range(260)) if a // 14 == b // 14 or rng.random() < 0.15]
    d = spark.createDataFrame(rows + [("m1", "m1", 9.0), (None, "m2", 1.0)], "a_ref string, b_ref string, weight double")
    by_rows, by_joins = (sorted(map(tuple, N.communities(d, sweeps=6, levels=3, held=held).collect())) for held in (N.HELD, 0))
    assert by_rows == by_joins and 1 < len({c for _, c in by_rows}) < 20


def test_draws_are_those_of_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    r = spark.range(50).select(F.xxhash64("id").alias("h"), *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)).alias(f"d{k}") for k in (0, 7)]).collect()
    for k in (0, 7):
        assert N._drawn(np.array([x.h for x in r], np.int64), k).tolist() == [x[f"d{k}"] for x in r]


def test_rows_of_a_node_are_put_together_over_batches():
    import numpy as np
    import pyarrow as pa

    from tallystream.functions.adjacency import whole_nodes

    rows = [(1, 5, [2, 3]), (1, 5, [4, 5]), (1, 5, [6]), (2, 1, [1]), (3, 3, [1, 2]), (3, 3, [4])]
    batch = lambda part: pa.RecordBatch.from_pydict({
        "a": pa.array([x[0] for x in part], pa.int32()), "ties": pa.array([x[1] for x in part], pa.int32()), "nb": pa.array([x[2] for x in part], pa.list_(pa.int32())), "w": pa.array([[float(y) for y in x[2]] for x in part], pa.list_(pa.float64()))
    })
    for cuts in ((0, 6), (0, 1, 6), (0, 2, 3, 5, 6), (0, 1, 2, 3, 4, 5, 6)):
        got = list(whole_nodes(batch(rows[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)))
        assert np.concatenate([g[0] for g in got]).tolist() == [1, 2, 3] and np.concatenate([g[1] for g in got]).tolist() == [5, 1, 3]
        assert np.concatenate([g[2] for g in got]).tolist() == [2, 3, 4, 5, 6, 1, 1, 2, 4] == np.concatenate([g[3] for g in got]).tolist()
    with pytest.raises(ValueError, match="lie apart"):
        list(whole_nodes([batch(rows[:2])]))
