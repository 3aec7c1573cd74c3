"""Vector codes and the prefix trie against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallystream.llm import prefixtrie, vectorcodes

VECTOR = "vec_id long, embedding array<double>, label int"


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[near(p, cut(v, p))[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i])] if members[i] else e for i, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, per = [], defaultdict(int)
    for i, v, lab in kept:
        got = [near(p, cut(v, p)) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got), lab))
        per[lab] += out[-1][2]
    return sorted(((i, c, e, per[lab], digest) for i, c, e, lab in out), key=str)


def test_codes_equal_a_plain_lloyd_iteration(spark):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(500 + i, rows[0][1], 1) for i in range(150)]  # a hot vector
    rows += [(7, rows[3][1], 2), (7, rows[3][1], 2), (None, rows[4][1], 1), (900, None, 1), (901, [None] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] + [0.0] * 15, None), (904, [0.0] * 16, None)]
    d = spark.createDataFrame(rows, VECTOR).selectExpr("*", "'x' as pos", "'x' as entry", "'x' as code", "'x' as salt")
    got = sorted((tuple(r) for r in vectorcodes.compress(d).collect()), key=str)
    assert got == lloyd(rows)


def test_few_other_and_no_vectors(spark):
    rows = [(3, [1.0, -0.00001], None), (1, [0.5, 0.25], 4), (2, [0.1], 4), (5, [], 4), (6, [0.1, 0.2, 0.3], 1)]
    d = spark.createDataFrame(rows, VECTOR)
    got = sorted(tuple(r) for r in vectorcodes.compress(d, parts=2).collect())
    assert got == lloyd(rows[:2], parts=2)  # one and three components can't be cut in two
    assert vectorcodes.compress(spark.createDataFrame([], VECTOR)).count() == 0
    assert vectorcodes.compress(spark.createDataFrame([(1, None, 1)], VECTOR)).collect() == []
    with pytest.raises(Exception, match="too large"):
        vectorcodes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], VECTOR)).collect()
    with pytest.raises(ValueError):
        vectorcodes.compress(d, entries=257)


def test_codes_decode_to_their_entries(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0]) for _ in range(8)], 0) for i in range(64)]
    codes, books = vectorcodes.encode(spark.createDataFrame(rows, VECTOR), entries=64, rounds=2)
    want = {i: v for i, v, _ in rows}
    for r in vectorcodes.decode(codes, books).collect():
        assert r.error == 0 and np.allclose(r.vector, want[r.vec_id])


def trie(rows, family=20, heads=4):
    original = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            original[c].append((t is not None, t or 0, (role or "", text or "")))
    original = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in original.items()}
    seqs = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % heads
        seqs[c] = tuple(original.get(c - int(math.fmod(c, family)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    kids = defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    out = []
    for s, m in members.items():
        below = [t for t in members if t[: len(s)] == s]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(seqs[c]) == len(s)))
        saved = sum((len(members[t]) - 1) * words(t[-1][1]) for t in below if t)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], sum(kids[t] == 0 for t in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURN = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("least", [1, 16])
def test_trie_equals_a_plain_one(spark, monkeypatch, least):
    monkeypatch.setattr(prefixtrie, "LEAST", least)
    monkeypatch.setattr(prefixtrie, "BITS", 2)
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else "user", rng.choice(["a b", "c", "d e f "])))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(5)]  # copies
    rows += [(c, t, "u", f"deep {t}") for c in (201, 202) for t in range(70)]  # long chains
    rows += [(300 + 20 * c + 3, 0, "user", f"no first conversation {c}") for c in range(12)]  # some are left without turns
    rows += [(250, None, None, None), (250, 1, None, "x"), (250, 2, "r", ""), (None, 1, "user", "x"), (-7, 0, "user", "below zero"), (-7, 1, "user", "z"), (-7, 2, "user", "z"), (-7, 3, "user", "z")]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, TURN).selectExpr("*", "'x' as pos", "'x' as owner", "'x' as depth", "'x' as salt")
    # the remainder is SQL's: it has the sign of the dividend
    got = sorted((tuple(r) for r in prefixtrie.conversation_trie(d).collect()), key=str)
    assert got == trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], TURN)).collect() == []
    only = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4)
    got = prefixtrie.conversation_trie(spark.createDataFrame([(only, 0, "user", "hi")], TURN)).collect()
    assert [tuple(r) for r in got] == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]


def test_long_lists_of_ends_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "one text") for c in range(0, 9000, 20)] + [(c, 0, "user", "one text") for c in range(20 * 10**6, 20 * 10**6 + 100, 20)]
    got = {r.depth: r for r in prefixtrie.conversation_trie(spark.createDataFrame(rows, TURN)).collect()}
    assert got[1].n_convs == 455 and got[1].ends_sha256 == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
