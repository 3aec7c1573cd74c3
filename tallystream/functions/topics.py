"""Topics of texts: non-negative factors of the tf-idf table, and the coherence of their terms.

The vocabulary is bounded (`max_features`), so the term side of the factors is a small matrix that goes out with each pass and comes back as sums; documents stay where they are, and their side is
solved for anew in every pass, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.sources.stages import Stages

#: Multiplicative steps that solve for a block of documents.
INNER = 40
_TINY = 1e-10


def tokens(docs: DataFrame) -> DataFrame:
    """(d, term, c): counts of lower-cased words of texts (d, text); null texts have none."""
    words = F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("term")
    return docs.select("d", words).groupBy("d", "term").agg(F.count(F.lit(1)).alias("c"))


def vectors(docs: DataFrame, max_features: int = 5000, min_docs: int = 2) -> tuple[DataFrame, list[str]]:
    """Unit-length sublinear tf-idf vectors (d, ids, weights) over the terms of most documents (ties by name), and these terms: max_features at most, in at least min_docs documents.

    Documents without any of the terms have no vector.
    """
    counts = tokens(docs)
    total = docs.count()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_docs).orderBy(F.desc("df"), "term").limit(max_features).collect()  # bounded by max_features
    terms = [r.term for r in df]
    if not terms:
        return docs.sparkSession.createDataFrame([], "d long, ids array<int>, weights array<double>"), []
    known = docs.sparkSession.createDataFrame([(r.term, i, float(np.log((1 + total) / (1 + r.df)) + 1)) for i, r in enumerate(df)], "term string, id int, idf double")
    w = counts.join(F.broadcast(known), "term").select("d", F.struct("id", ((1 + F.log("c")) * F.col("idf")).alias("w")).alias("x"))
    rows = w.groupBy("d").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("norm", F.sqrt(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x["w"] * x["w"])))
    return rows.select("d", F.transform("xs", lambda x: x["id"]).alias("ids"), F.transform("xs", lambda x: x["w"] / F.col("norm")).alias("weights")), terms


def _block(pdf: pd.DataFrame, terms: int) -> np.ndarray:
    out = np.zeros((len(pdf), terms))
    for i, (ids, weights) in enumerate(zip(pdf.ids, pdf.weights, strict=True)):
        out[i, ids] = weights
    return out


def _solved(v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Document weights w >= 0 with w h close to v, from a flat start."""
    vh, hh = v @ h.T, h @ h.T
    w = np.full((len(v), len(h)), max(v.mean(), _TINY))
    for _ in range(INNER):
        w *= vh / (w @ hh + _TINY)
    return w


def _summed(table: DataFrame, terms: int, give: Callable[[np.ndarray], dict[int, np.ndarray]], blocks: int = 512) -> dict[int, np.ndarray]:
    """Sums over all documents of the arrays that give returns for a block of dense rows, by number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[int, np.ndarray] = {}
        for pdf in batches:
            for at in range(0, len(pdf), blocks):
                for name, x in give(_block(pdf.iloc[at : at + blocks], terms)).items():
                    have[name] = have[name] + x if name in have else x
        rows = [(name, i, line.tolist()) for name, x in have.items() for i, line in enumerate(np.atleast_2d(x))]
        yield pd.DataFrame(rows, columns=["name", "line", "x"])

    parts = table.select("ids", "weights").mapInPandas(run, "name int, line int, x array<double>")
    wide = parts.select("name", "line", F.posexplode("x").alias("i", "x")).groupBy("name", "line", "i").agg(F.sum("x").alias("x"))
    got = wide.groupBy("name", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x")).collect()
    out: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.name, r.line)):
        out.setdefault(r.name, []).append(r.x)
    return {k: np.array(v) for k, v in out.items()}


def _start(table: DataFrame, terms: int, k: int, seed: int, passes: int = 4) -> np.ndarray:
    """Term factors from the leading right singular vectors (subspace iteration): of each one the sign that carries more weight, with the documents' share in it."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, min(terms, k + 6))))[0]
    for _ in range(passes):
        q = np.linalg.qr(_summed(table, terms, lambda v, q=q: {0: (v @ q).T @ v})[0].T)[0]
    gram = _summed(table, terms, lambda v, q=q: {0: (v @ q).T @ (v @ q)})[0]
    right = (q @ np.linalg.eigh(gram)[1][:, ::-1])[:, :k]
    halves = _summed(table, terms, lambda v: {0: np.stack([(np.maximum(v @ right, 0) ** 2).sum(0), (np.maximum(-v @ right, 0) ** 2).sum(0)])})[0]
    h = np.full((k, terms), 1e-8)
    for c in range(right.shape[1]):
        sides = [(np.sqrt(halves[s, c]) * np.linalg.norm(np.maximum(sign * right[:, c], 0)), sign) for s, sign in ((0, 1.0), (1, -1.0))]
        mass, sign = max(sides)
        part = np.maximum(sign * right[:, c], 0)
        if mass > 0:
            h[c] = np.maximum(part / np.linalg.norm(part) * np.sqrt(mass), 1e-8)
    return h


def nmf(table: DataFrame, terms: int, k: int, *, seed: int = 0, iterations: int = 40, tolerance: float = 1e-5) -> tuple[np.ndarray, float]:
    """Term factors (k x terms) of the vectors and the root of the summed squared error: alternating, documents solved for in place, terms by multiplicative steps.

    An iteration is one pass; k x terms and k x k numbers come back.  It ends when the error falls by less than `tolerance` of itself.
    """
    h = _start(table, terms, k, seed)
    last = None
    for _ in range(iterations):

        def give(v: np.ndarray, h=h) -> dict[int, np.ndarray]:
            w = _solved(v, h)
            return {0: w.T @ v, 1: w.T @ w, 2: np.array([((v - w @ h) ** 2).sum()])}

        got = _summed(table, terms, give)
        if not got:
            return h, 0.0
        error = float(np.sqrt(got[2][0][0]))
        if last is not None and last - error < tolerance * last:
            break
        last = error
        for _ in range(5):
            h = h * got[0] / (got[1] @ h + _TINY)
    return h, error


def assigned(table: DataFrame, h: np.ndarray) -> DataFrame:
    """(d, topic, share): each document's heaviest topic and its share of the document's weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                w = _solved(_block(part, h.shape[1]), h) * np.linalg.norm(h, axis=1)
                yield pd.DataFrame({"d": part.d, "topic": w.argmax(1).astype("int32"), "share": w.max(1) / np.maximum(w.sum(1), _TINY)})

    return table.mapInPandas(run, f"d {table.schema['d'].dataType.simpleString()}, topic int, share double")


def npmi_coherence(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, pairs, coherence): normalised pointwise mutual information of a topic's terms, averaged over their pairs; topics has topic, term.

    Pairs that never share a document have -1, pairs that always do 1; terms that occur nowhere form no pair.  Only the topics' own terms are kept of a document, so a document gives few pairs.
    """
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    wanted = topics.select("term").distinct()  # topics * terms rows, a parameter
    words = docs.select("d", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("term")).join(F.broadcast(wanted), "term")
    single = words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    listed = words.groupBy("d").agg(F.array_sort(F.collect_list("term")).alias("ts"))
    couples = F.explode(F.flatten(F.transform("ts", lambda t, i: F.transform(F.slice("ts", i + 2, F.size("ts")), lambda u: F.struct(t.alias("a"), u.alias("b"))))))
    both = listed.select(couples.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("both"))
    of = lambda k: topics.select("topic", F.col("term").alias(k)).distinct()
    count = lambda k: single.select(F.col("term").alias(k), F.col("n").alias(f"n{k}"))
    pairs = of("a").join(of("b"), "topic").where("a < b").join(count("a"), "a").join(count("b"), "b").join(both, ["a", "b"], "left").crossJoin(F.broadcast(total))  # one row
    share = F.col("both") / F.col("n")
    npmi = F.when(F.col("both").isNull(), -1.0).when(F.col("both") == F.col("n"), 1.0).otherwise(F.log(share * F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))) / -F.log(share))
    return pairs.groupBy("topic").agg(F.count(F.lit(1)).alias("pairs"), F.avg(npmi).alias("coherence"))


def nmf_topics(docs: DataFrame, *, topics: tuple[int, ...] = (4,), top: int = 10, max_features: int = 5000, seed: int = 0, iterations: int = 40) -> DataFrame:
    """The topics of texts (d, text): n_topics, topic, rank, term, weight, coherence, error; of several numbers of topics the one whose terms are most coherent on average (ties: the smaller).

    weight is a term's share of its topic.  Texts that are null or share no term with another one take no part; without any vector there are no rows.
    """
    s = Stages(docs.sparkSession)
    table, terms = vectors(docs, max_features)
    spark = docs.sparkSession
    schema = "n_topics int, topic int, rank int, term string, weight double, coherence double, error double"
    table = s.step(table)
    best: tuple[float, int, list] | None = None
    for k in topics if terms else ():
        h, error = nmf(table, len(terms), min(k, len(terms)), seed=seed, iterations=iterations)
        share = h / np.maximum(h.sum(1, keepdims=True), _TINY)
        lists = [(c, r + 1, terms[i], float(share[c, i])) for c in range(len(h)) for r, i in enumerate(sorted(range(len(terms)), key=lambda i: (-share[c, i], terms[i]))[:top])]
        found = {r.topic: r.coherence for r in npmi_coherence(docs, spark.createDataFrame([(c, t) for c, _, t, _ in lists], "topic int, term string")).collect()}  # a row per topic
        mean = sum(found.get(c, 0.0) for c in range(len(h))) / len(h)
        if best is None or mean > best[0] + 1e-12:
            best = (mean, k, [(len(h), c, r, t, w, found.get(c), error) for c, r, t, w in lists])
    s.close()
    return spark.createDataFrame(best[2] if best else [], schema)
