"""Topics: recovery of a known mixture, coherence with exact answers."""

import random

import numpy as np

from tallystream.functions import topics as T


def corpus():
    rng = random.Random(4)
    kinds = [[f"{name}{i}" for i in range(12)] for name in ("water", "gate", "lift")]
    rows = [(i, " ".join(rng.choice(kinds[i % 3]) if rng.random() < 0.95 else rng.choice(kinds[rng.randrange(3)]) for _ in range(25))) for i in range(120)]
    return kinds, [*rows, (900, None), (901, ""), (902, "once")]


def test_topics_and_documents_are_recovered(spark):
    kinds, rows = corpus()
    docs = spark.createDataFrame(rows, "d long, text string")
    table, terms = T.vectors(docs)
    assert "once" not in terms and len(terms) == 36
    h, error = T.nmf(table, len(terms), 3, seed=1)
    target = np.array([[float(t in kind) for t in terms] for kind in kinds])
    cos = target @ h.T / np.outer(np.linalg.norm(target, axis=1), np.linalg.norm(h, axis=1))
    best = cos.argmax(1)
    assert sorted(best) == [0, 1, 2] and cos.max(1).min() > 0.9 and error > 0
    got = {r.d: r for r in T.assigned(table, h).collect()}
    assert len(got) == 120 and sum(got[i].topic == best[i % 3] for i in got) >= 118 and all(0 < r.share <= 1 for r in got.values())


def test_the_number_of_topics_is_chosen_by_coherence(spark):
    kinds, rows = corpus()
    got = T.nmf_topics(spark.createDataFrame(rows, "d long, text string"), topics=(2, 3), top=6, iterations=15).collect()
    assert {r.n_topics for r in got} == {3} and all(len({r.term[:3] for r in got if r.topic == c}) == 1 for c in range(3))
    assert T.nmf_topics(spark.createDataFrame([], "d long, text string")).collect() == []


def test_coherence_of_terms_that_always_or_never_meet(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(10)] + [(i, "c") for i in range(10, 20)], "d long, text string")
    topics = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c"), (2, "a"), (2, "nowhere"), (3, "a"), (3, "b"), (3, "c")], "topic int, term string")
    got = {r.topic: (r.pairs, round(r.coherence, 9)) for r in T.npmi_coherence(docs, topics).collect()}
    assert got == {0: (1, 1.0), 1: (1, -1.0), 3: (3, round(-1 / 3, 9))}
