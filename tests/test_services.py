"""Services against plain loops and hand-worked cases."""

import math
import random

from pyspark.sql import functions as F

from tallystream.functions import kernels as K
from tallystream.functions import statistics as S
from tallystream.functions import survival as V
from tallystream.operators import reducers as R


def test_kaplan_meier_with_delayed_entry_and_ties(spark):
    rng = random.Random(5)
    spells = [(e := rng.choice([0, 0, 0, rng.randint(1, 9)]), e + rng.randint(1, 12), rng.random() < 0.6) for _ in range(300)]
    got = {r.t: r for r in V.kaplan_meier(spark.createDataFrame(spells, "entry int, exit int, event boolean"), "event").collect()}
    s, g = 1.0, 0.0
    for t in sorted({x for _, x, d in spells if d}):
        n = sum(e < t <= x for e, x, _ in spells)
        d = sum(x == t and k for _, x, k in spells)
        s *= 1 - d / n
        g += d / (n * (n - d)) if n > d else 0
        assert (got[t].at_risk, got[t].events) == (n, d)
        assert math.isclose(got[t].survival, s, abs_tol=1e-12) and math.isclose(got[t].green, g, abs_tol=1e-12)
    assert len(got) == len({x for _, x, d in spells if d})


def test_survival_reaches_zero_without_failing(spark):
    rows = V.kaplan_meier(spark.createDataFrame([(0, 1, True), (0, 2, True)], "entry int, exit int, event boolean"), "event").orderBy("t").collect()
    assert [round(r.survival, 9) for r in rows] == [0.5, 0.0]


def test_incidences_and_survival_sum_to_one(spark):
    rng = random.Random(1)
    rows = [(0, rng.randint(1, 30), rng.choice(["resolved", "escalated", "withdrawn", "open"])) for _ in range(200)]
    c = V.cumulative_incidence(spark.createDataFrame(rows, "entry int, exit int, outcome string"), ("resolved", "escalated", "withdrawn"))
    for r in c.groupBy("t").agg(F.sum("incidence").alias("f"), F.first("still_open").alias("s")).collect():
        assert math.isclose(r.f + r.s, 1, abs_tol=1e-9)


def test_cusum_is_the_reflected_recursion(spark):
    xs = [10.0, 12.0, 9.0, 11.0, 17.0, 18.0, 19.0, 10.0, 9.0, 3.0, 2.0]
    rows = S.cusum(spark.createDataFrame(list(enumerate(xs)), "period_start int, x double")).orderBy("period_start").collect()
    mean = sum(xs) / len(xs)
    sigma = sum(abs(b - a) for a, b in zip(xs, xs[1:])) / (len(xs) - 1) / 1.128
    hi = lo = 0.0
    for r, x in zip(rows, xs, strict=True):
        hi, lo = max(0, hi + (x - mean) / sigma - 0.5), max(0, lo - (x - mean) / sigma - 0.5)
        assert math.isclose(r.high, hi, abs_tol=1e-9) and math.isclose(r.low, lo, abs_tol=1e-9)


def test_tennessee(spark):
    options = ("Memphis", "Nashville", "Chattanooga", "Knoxville")
    groups = [(42, "MNCK"), (26, "NCKM"), (15, "CKNM"), (17, "KCNM")]
    names = {o[0]: o for o in options}
    rows, v = [], 0
    for n, order in groups:
        for _ in range(n):
            v += 1
            rows += [(v, names[c], i + 1) for i, c in enumerate(order)]
    b = spark.createDataFrame(rows, "voter_ref int, option_ref string, tier int")
    m = S.pairwise_matrix(b, options)
    assert {(r.a_ref, r.b_ref): r.votes for r in m.collect()}[("Nashville", "Memphis")] == 58
    assert [r.option_ref for r in S.condorcet(m, 4).where("condorcet").collect()] == ["Nashville"]
    assert {r.option_ref: r.wins for r in S.schulze(m, options).collect()} == {"Nashville": 3, "Chattanooga": 2, "Knoxville": 1, "Memphis": 0}
    assert {r.option_ref: r.points for r in S.borda(m, 100).collect()} == {"Memphis": 126.0, "Nashville": 194.0, "Chattanooga": 173.0, "Knoxville": 107.0}


def test_edges_of_shared_objects(spark):
    rows = R.interaction_edges(spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "b"), (3, "a")], "object_ref int, member_ref string")).collect()
    assert {(r.a_ref, r.b_ref): (r.weight, r.objects) for r in rows} == {("a", "b"): (1.5, 2), ("a", "c"): (0.5, 1), ("b", "c"): (0.5, 1)}


def test_suppressed_rows_stay_but_lose_their_measures(spark):
    rows = S.suppress_small(spark.createDataFrame([("a", 3, 1.0), ("b", 12, 2.0)], "stratum string, n int, x double"), "n", ("x",), 5).orderBy("stratum").collect()
    assert (rows[0].n, rows[0].x, rows[0].suppressed) == (None, None, True) and (rows[1].n, rows[1].x) == (12, 2.0)


def test_running_sums_over_buckets(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1.0, 2.5, rng.random() * 50]), i, rng.randint(0, 9)) for i in range(500)]
    d = spark.createDataFrame(rows, "x double, i int, v int")
    got = {r.i: r.s for r in S.running_sums(d, "x", ("i",), {"s": F.col("v")}, parts=7).collect()}
    total, want = 0, {}
    for _, i, v in sorted(rows):
        total += v
        want[i] = total
    assert got == want
    assert S.running_sums(d.limit(0), "x", ("i",), {"s": F.col("v")}).count() == 0


def test_no_answer_beyond_the_curve(spark):
    c = V.kaplan_meier(spark.createDataFrame([(0, 1, True), (0, 5, True)], "entry int, exit int, event boolean"), "event")
    assert V.attainment(c, 3).first().attained == 0.5 and V.attainment(c, 6).first().attained is None


def test_options_off_the_paper_fail(spark):
    import pytest

    b = spark.createDataFrame([(1, "a", 1), (1, "x", 2)], "voter_ref int, option_ref string, tier int")
    with pytest.raises(Exception, match="no such option: x"):
        S.pairwise_matrix(b, ("a", "b")).collect()


def test_text_joins_in_blocks_with_common_words(spark):
    rng = random.Random(8)
    text = lambda: " ".join(["the", "of", *(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 9)))])
    q = [(i, text()) for i in range(12)] + [(12, ""), (13, None)]
    d = [(i, text()) for i in range(200)] + [(200, q[0][1]), (201, ""), (202, None)]
    qs, ds = spark.createDataFrame(q, "q int, text string"), spark.createDataFrame(d, "d int, text string")
    sets = lambda rows: [(k, set(t.split())) for k, t in rows if t]
    want = {(a, b): len(x & y) / len(x | y) for a, x in sets(q) for b, y in sets(d) if len(x & y) >= 0.5 * len(x | y)}
    for rows in (20, 10_000):
        got = {(r.q, r.d): r.jaccard for r in S.jaccard_candidates(qs, ds, 0.5, rows).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    one, many = (sorted(map(tuple, K.tfidf_similarity(qs, ds, 4, rows).collect())) for rows in (10_000, 20))
    assert one == many and len(one) == 12 * 4 and [r[3] for r in one if r[0] == 0 and r[2] == 200] == [1.0]


def test_spread_splits_heavy_keys_only(spark):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(3000)], "token string, i int")
    right = left.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    a, b, on = S.spread(left, right, "token")
    assert a.join(b, on).count() == 6000 and a.where("token = 'hot'").select("salt").distinct().count() == 64 and a.where("token <> 'hot' and salt > 0").isEmpty()


def test_tfidf_with_rare_words_shared_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(K, "COMMON", 12)
    rng = random.Random(4)
    word = lambda: f"w{int(rng.paretovariate(0.5)) % 400}"
    text = lambda n: " ".join(word() for _ in range(n))
    q = [(f"q{i}", text(8)) for i in range(6)] + [("none", "neverseen"), ("empty", "")]
    d = [(i % 240, text(rng.randint(0, 30))) for i in range(300)] + [(None, text(9)), (None, text(9)), (900, q[0][1]), (901, q[0][1]), (902, None)]
    tokens: dict = {}
    for k, t in d:
        tokens.setdefault(k, []).extend((t or "").lower().split())
    count = {k: {w: t.count(w) for w in t} for k, t in tokens.items()}
    idf = {w: math.log((1 + len(d)) / (1 + sum(w in c for c in count.values()))) + 1 for c in count.values() for w in c}
    weigh = lambda c: {w: (1 + math.log(n)) * idf[w] for w, n in c.items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, t in q:
        a = weigh({w: t.split().count(w) for w in t.split()})
        scores = {x: sum(a[w] * b[w] for w in a if w in b) / (norm(a) * norm(b)) for x, c in count.items() if x is not None and (b := weigh(c)) and any(w in b for w in a)}
        want.update({(k, r + 1): (x, scores[x]) for r, x in enumerate(sorted(scores, key=lambda x: (-round(scores[x], 12), x))[:3])})
    qs, ds = spark.createDataFrame(q, "q string, text string"), spark.createDataFrame(d, "d int, text string").repartition(5)
    for rows in (10_000, 15):
        got = {(r.q, r["rank"]): (r.d, r.score) for r in K.tfidf_similarity(qs, ds, 3, rows).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9) for k in want)
    assert [want["q0", r][0] for r in (1, 2)] == [900, 901]


def test_tfidf_leaves_a_task_with_few_candidates():
    import numpy as np
    import pyarrow as pa

    class State:
        value = (pa.array(["a", "b", "c"]), np.array([1.0, 2.0, 3.0]), 3.5, 4.0, np.array([0, 1, 2, 2]), np.array([0, 0]), np.array([1.0, 2.0]), np.array([math.sqrt(5)]), pa.array(["q"]))

    docs = [["a", "b"]] + [["a", "b"] + ["c"] * (i % 9 + 1) + [f"x{i}"] * 3 for i in range(500)] + [["b", "a", "y"]]
    batch = pa.RecordBatch.from_pydict({"d": pa.array(range(len(docs)), pa.int32()), "words": pa.array(docs)})
    (got,) = K._candidates(State, 2)([batch.slice(0, 100), batch.slice(100)])
    assert sorted(got.column("d").to_pylist()) == [0, 501] and got.schema.field("d").type == pa.int32()
