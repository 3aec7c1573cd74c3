"""Personal data against plain patterns and a plain bootstrapping loop."""

import hashlib
import math
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tallystream.llm import pii
from tallystream.llm.queries import op13_bootstrapped_pii

SMALL = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(text):
    out = []
    for k, (name, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if name == "ip" else True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[name]:
                out.append((k, m.start(), m.end()))
    return out


ODD = st.text(st.sampled_from("aZ0159.@+-_%() \nü:[]"), max_size=60)


@settings(max_examples=1500, deadline=None)
@given(ODD)
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b@c.de", "1.2.3.4", "999.1.1.1.2.3.4.5", "4111 1111-1111 1111", "+1 (017) 555-7713", "@", ".", " ", "4111111111111112", "x@y", "+", "00000255.1.1.0256"]), max_size=8))
def test_base_spans_of_identifiers_side_by_side(pieces):
    assert pii.base_spans("".join(pieces)) == plain_base("".join(pieces))


def bootstrapped(texts, support=pii.SUPPORT, sure=pii.SURE, rounds=pii.ROUNDS):
    """The added spans by plain loops over all values and patterns."""
    seen = [pii.occurrences(t or "")[1] for t in texts]
    fills, info, known = defaultdict(set), {}, set()
    for found in seen:
        for k, _, _, v, ps, state in found:
            info[v] = (k, max(state, info.get(v, (k, 0))[1]))
            known |= {v} if state == 2 else set()
            for p in ps:
                fills[p].add(v)
    state_in = {(p, v): 0 for p in fills for v in fills[p]}
    for found in seen:
        for k, _, _, v, ps, state in found:
            for p in ps:
                state_in[p, v] = max(state_in[p, v], state)
    for _ in range(rounds):
        doubt = defaultdict(int)
        for p, vs in fills.items():
            for k in range(4):
                sure_ones = sum(info[v][0] == k and v in known for v in vs)
                opened = [v for v in vs if info[v][0] == k and v not in known and state_in[p, v] == 1]
                score = math.floor(pii.ONE * sure_ones / (len(vs) - len(opened) / 2 + 1))
                if sure_ones >= support and opened and score >= sure:
                    for v in opened:
                        doubt[v] += round(-math.log1p(-score / (pii.ONE + 1)) * pii.ONE)
        more = {v for v, d in doubt.items() if d >= int(-math.log1p(-sure / (pii.ONE + 1)) * pii.ONE)} - known
        if not more:
            break
        known |= more
    return [sorted((k, s, e) for k, s, e, v, _, state in found if state == 1 and v in known) for found in seen]


def contextual():
    lines = [f"please write to: user{i}@host{i}.example.com for help, {w}" for i, w in enumerate("abcdefghij")]
    lines += [f"my phone number is +1 (017) 555-77{i:02d} call me {i}" for i in range(12)]
    lines += [f"server log: address 10.0.0.{i} was seen {'x' * i}" for i in range(9)]
    hidden = ["Please write to: jane.doe at mail dot example dot org for help, z", "my phone number is (030) 555 77 13 9 call me", "server log: address 2001:db8::17 was seen", "server log: address 10[.]9[.]9[.]9 was seen"]
    known = ["elsewhere user3 (at) host3 (dot) example (dot) com stands", "ring 1.017.555.7703 there"]
    clean = ["order number 4845168114407329 was sent", "the total is 123 456 789 0 units", "we met at the dot com party", "at 12:30:45 on 2024-01-15", "order 4845-1681-1440-7328 1"]
    return lines, hidden, known, clean


def test_contexts_of_seeds_find_other_forms_and_leave_the_rest(spark):
    lines, hidden, known, clean = contextual()
    lines += ["card no 4111111111111111 thanks"] * 500 + [f"card no {c} thanks" for c in ("5500000000000004", "340000000000009", "30000000000004", "6011000000000004", "201400000000009")]
    clean += ["card no 4845.1681.1440.7320 thanks"]  # fails the check digit
    hidden += ["card no 4000.0000.0000.0002 thanks"]
    texts = lines + hidden + known + clean + [None, "", "a" * 200_000, "1" * 200_000, "a@" * 50_000, "+1" * 50_000, "1.1." * 50_000, ": " * 50_000, "(at) " * 20_000]
    d = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'x' as found", "'x' as base", "'x' as rid", "'x' as value")
    got = pii.find(d).collect()
    want = defaultdict(list)
    for i, (t, spans) in enumerate(zip(texts, bootstrapped(texts))):
        want[i if i % 7 else None].append(([tuple(x) for x in plain_base(t or "")] if len(t or "") < 1000 else None, spans))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append(([tuple(x) for x in r.base], [tuple(x) for x in r.added]))
    for i in want:
        assert sorted(x[1] for x in want[i]) == sorted(x[1] for x in have[i])
        assert all(w[0] is None or w in have[i] for w in want[i])
    added = {t: s for t, s in zip(texts, bootstrapped(texts))}
    shown = {t: [t[s:e] for _, s, e in added[t]] for t in hidden + known}
    assert list(shown.values()) == [["jane.doe at mail dot example dot org"], ["(030) 555 77 13 9"], ["2001:db8::17"], ["10[.]9[.]9[.]9"], ["4000.0000.0000.0002"], ["user3 (at) host3 (dot) example (dot) com"], ["1.017.555.7703"]]
    assert not any(added[t] for t in clean)


def test_query_equals_plain_loops_on_all_documents(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = {}
    for r, added in zip(rows, bootstrapped([r.text for r in rows])):
        base = plain_base(r.text or "")
        say = lambda x: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(x))
        every = base + added
        want[r.doc_id] = (*(sum(k == i for k, _, _ in every) for i in range(4)), hashlib.sha256(say(base).encode()).hexdigest(), say(every))
    got = {r.doc_id: tuple(r)[1:7] for r in op13_bootstrapped_pii(spark, SMALL).collect()}
    assert got == want and any(sum(w[:4]) for w in want.values())


def test_no_documents(spark):
    assert pii.spans_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = pii.spans_report(spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)] * 2
