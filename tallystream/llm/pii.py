"""Personal data by bootstrapped contextual extraction.

Base patterns give the seeds: e-mail addresses, IPv4 addresses, payment cards and phone numbers in their plain form.  Looser shapes give candidates: the same
kinds of identifier written otherwise ("jane at host dot org", "10[.]0[.]0[.]1", IPv6, cards cut by dots, phone numbers without "+").  The words around seeds are lexical patterns (two words before, one
before and one behind, two behind).  Patterns and values form a graph that is scored in turn: a pattern by the values known to be identifiers among all that fill it, a
value by the patterns it fills.  Values that reach the threshold count as known in the next round; a candidate that is a seed's value in another form is known from the start.

One pass reads the texts and keeps positions and hashes only; all scoring is done on distinct (pattern, value) pairs, so copies of a document add nothing.
Scores are whole numbers (millionths), so that results do not depend on the order of rows.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.tables import drop, settled, spread, written

#: The kinds, in the order in which results list them.
KINDS = ("email", "ip", "card", "phone")
#: Known values that a pattern needs; the millionths that a pattern and a value need; scoring rounds at most; characters before and behind a value that its context is taken from.
SUPPORT, SURE, ROUNDS, WINDOW = 4, 700_000, 4, 96
ONE = 1_000_000

# Base patterns, in forms that read a text once: e-mails from their @, addresses from runs of numbers and dots.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Looser shapes.  Their lengths are those of the identifiers: 64 characters before the @, 63 in a label of a domain.
_AT = re.compile(r"@|\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20", re.I)
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20)"
_BEFORE_AT = re.compile(r"[\w.%+-]+\Z")
_HOST = re.compile(rf"[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}})+", re.I)
_LOOSE_IP = re.compile(rf"(?<![\w.:])(?:[0-9A-Fa-f]{{0,4}}(?::[0-9A-Fa-f]{{0,4}}){{2,7}}(?![\w:])|[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?!\w))", re.I)
_LOOSE_CARD = re.compile(r"(?<!\w)[0-9](?:[\x20./_  ‐-―-]?[0-9]){12,18}(?!\w)")
_LOOSE_PHONE = re.compile(r"(?<![\w+])\(?[0-9](?:[\x20()./ ‐-―-]{0,2}[0-9]){8,14}(?!\w)")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and non-overlapping within a kind, in order; matches that fail their kind's check are left out."""
    out = []
    least, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1)
        if start < at and host:
            out.append((0, start, host.end()))
            least = host.end()
        else:
            least = max(least, at + 1)
        at = text.find("@", max(least, at + 1))
    for run in _DOTTED.finditer(text) if "." in text else ():
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in four):
                out.append((1, at, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _plain(kind: int, s: str) -> str | None:
    """What a value of some kind is apart from how it is written; None if it can't be of that kind."""
    if kind in (0, 1):
        plain = re.sub(_DOT, ".", re.sub(_AT, "@", s.lower(), count=1) if kind == 0 else s.lower(), flags=re.I)
        if kind == 1:
            try:
                return ipaddress.ip_address(".".join(str(int(p)) for p in plain.split(".")) if "." in plain else plain).compressed
            except ValueError:
                return None
        return plain
    digits = _digits(s)
    return digits if kind == 3 or _luhn(digits) else None


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser shapes, non-overlapping within a kind."""
    out, last = [], 0
    for at in _AT.finditer(text):
        host = _HOST.match(text, at.end())
        local = host and _BEFORE_AT.search(text, max(last, at.start() - 64), at.start())
        if local and local.start() >= last:
            out.append((0, local.start(), host.end()))
            last = host.end()
    if _DIGIT.search(text) or "::" in text:
        for kind, shape in ((1, _LOOSE_IP), (2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
            out += [(kind, *m.span()) for m in shape.finditer(text)]
    return out


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _words(line: str) -> list[str]:
    return [re.sub(r"[0-9]", "0", w) for w in line.lower().split()]


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the lexical patterns around a value: words of its line within WINDOW characters, digits as 0; a line's ends count as words, but not alone."""
    before = _words(text[max(0, start - WINDOW) : start].rpartition("\n")[2])
    behind = _words(text[end : end + WINDOW].partition("\n")[0])
    left, right = (["^", "^", *before])[-2:], ([*behind, "$", "$"])[:2]
    made = (("before", *left), ("around", left[1], right[0]), ("behind", *right))
    return [_hash(*m) for m in made if any(w not in ("^", "$") for w in m[1:])]


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, list[int], int]]]:
    """The base spans, and what takes part in the graph: (kind, start, end, value, patterns, state), state 2 for a seed, 1 for a candidate, 0 for a shape that can't be of its kind.

    Candidates do not overlap a base span of any kind.
    """
    base = base_spans(text)
    found = [(k, s, e, _hash(k, _plain(k, text[s:e]) or text[s:e]), contexts(text, s, e), 2) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    reach = [0]
    for s, e in taken:
        reach.append(max(reach[-1], e))
    for k, s, e in loose_spans(text):
        # Base spans that start before e: the farthest reach among them tells whether one lies over s.
        lo, hi = 0, len(taken)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if taken[mid][0] < e else (lo, mid)
        if reach[lo] > s:
            continue
        plain = _plain(k, text[s:e])
        found.append((k, s, e, _hash(k, plain or text[s:e]), contexts(text, s, e), 1 if plain else 0))
    return base, found


_SPAN = "struct<kind:int,start:int,end:int>"
_FOUND = "struct<kind:int,start:int,end:int,value:long,patterns:array<long>,state:int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([(n, pa.int32()) for n in ("kind", "start", "end")])
    part = pa.struct([*((n, pa.int32()) for n in ("kind", "start", "end")), ("value", pa.int64()), ("patterns", pa.list_(pa.int64())), ("state", pa.int32())])
    for b in batches:
        base, found = [], []
        for text in b.column("text"):
            got = occurrences(text.as_py() or "")
            base.append([dict(zip(("kind", "start", "end"), x)) for x in got[0]])
            found.append([dict(zip(("kind", "start", "end", "value", "patterns", "state"), x)) for x in got[1]])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(part))], ["doc_id", "base", "found"])


def _scored(edges: DataFrame, known: DataFrame, pairs: int, sure: int, support: int) -> DataFrame:
    """One round: (value, kind) of candidates that reach `sure`, from edges (pattern, value, kind, state) and the known values (value)."""
    left, right = spread(edges, known.withColumn("is", F.lit(1)), "value", pairs)
    seen = left.join(right, ["value", "salt"], "left").drop("salt")
    fill = seen.groupBy("pattern").agg(
        *(F.sum(((F.col("kind") == k) & F.col("is").isNotNull()).cast("long")).alias(f"known{k}") for k in range(len(KINDS))),
        *(F.sum(((F.col("kind") == k) & F.col("is").isNull() & (F.col("state") == 1)).cast("long")).alias(f"open{k}") for k in range(len(KINDS))),
        F.count(F.lit(1)).alias("n"),
    )
    # Of all values that fill a pattern: those known to be of the kind, against the others; open ones of the kind count half.
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"known{k}").alias("known"), F.col(f"open{k}").alias("open")) for k in range(len(KINDS))))).alias("k")
    sure_of = F.floor(F.lit(ONE) * F.col("k.known") / (F.col("n") - F.col("k.open") / 2 + 1)).cast("long")
    patterns = fill.select("pattern", "n", each).where((F.col("k.known") >= support) & (F.col("k.open") > 0)).select("pattern", F.col("k.kind").alias("of"), sure_of.alias("sure"), "n").where(F.col("sure") >= sure)
    left, right = spread(seen.where("`is` is null and state = 1").select("pattern", "value", "kind"), patterns.drop("n"), "pattern", pairs)
    votes = left.join(right, ["pattern", "salt"]).where("kind = of")
    # One minus the product of what each pattern leaves open, in whole millionths of a logarithm.
    doubt = F.sum(F.round(-F.log1p(-F.col("sure") / F.lit(float(ONE + 1))) * ONE).cast("long"))
    return votes.groupBy("value", "kind").agg(doubt.alias("doubt")).where(F.col("doubt") >= int(-math.log1p(-sure / (ONE + 1)) * ONE)).select("value", "kind")


def find(docs: DataFrame, *, support: int = SUPPORT, sure: int = SURE, rounds: int = ROUNDS) -> DataFrame:
    """Personal data in whole texts: doc_id, base and added, arrays of (kind, start, end) with kind an index into KINDS, in code points, end exclusive.

    base has the spans of the base patterns, added those of the graph; added ones overlap no base span.  Every row is a document of its own, whatever its doc_id; a null or empty text
    has no spans; other columns are ignored; an empty table gives no rows.  A pattern counts with `support` known values at least, patterns and values from `sure` millionths on.
    """
    scan = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, base array<{_SPAN}>, found array<{_FOUND}>").withColumn("rid", F.monotonically_increasing_id()))
    each = scan.select("rid", F.explode("found").alias("f")).select("rid", "f.*")
    # Values are told from each other by kind and plain form; copies count once.
    edges = each.select(F.explode("patterns").alias("pattern"), "value", "kind", "state").groupBy("pattern", "value").agg(F.first("kind").alias("kind"), F.max("state").alias("state"))
    edges = written(edges)
    # Only patterns that may come to have enough known values, and that some candidate fills, can find anything.
    open_ = F.sum((F.col("state") == 1).cast("long"))
    live = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), open_.alias("open")).where((F.col("n") > support) & (F.col("open") > 0))
    pairs = edges.count()
    left, right = spread(edges, live.select("pattern"), "pattern", pairs, live.select("pattern", "n"))
    graph = written(left.join(right, ["pattern", "salt"], "left_semi").drop("salt"))
    drop(edges)
    seeds = written(each.where("state = 2").select("value").distinct())
    known, found = seeds, []
    for _ in range(rounds):
        more = written(_scored(graph, known, pairs, sure, support))
        if more.isEmpty():
            break
        found.append(more)
        known = written(known.unionByName(more.select("value")))
    accepted = known.distinct()
    open_rows = each.where("state = 1").select("rid", "value", F.struct("kind", "start", "end").alias("span"))
    left, right = spread(open_rows, accepted, "value", max(1, scan.count()))
    added = left.join(right, ["value", "salt"]).groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("added"))
    return scan.join(added, "rid", "left").select("doc_id", "base", F.coalesce("added", F.expr(f"cast(array() as array<{_SPAN}>)")).alias("added"))


def spans_report(docs: DataFrame, **how: int) -> DataFrame:
    """find() as counts and strings: doc_id, n_email, n_ip, n_card, n_phone (of all spans), base_sha256 (of the base spans as kind:start:end, by kind, then start, joined by commas),
    spans (all spans, likewise), n_added.  Null and empty texts have no spans: zeros, the hash of the empty string, an empty string.
    """

    def shown(c):
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(c), lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def report() -> DataFrame:
        every = F.concat("base", "added")
        kinds = F.transform(every, lambda x: x["kind"])
        counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
        return find(docs, **how).select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(every).alias("spans"), F.size("added").cast("long").alias("n_added"))

    return settled(report)
