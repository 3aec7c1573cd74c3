"""Language identification by multilingual mixture inference.

A text is a mixture of languages: each of its byte n-grams comes from language l with probability share[l], and then
has the language's own n-gram probability.  Expectation-maximisation estimates the shares of every document, all documents of a batch in step.
The set of languages is chosen by penalised likelihood: a language stays only if it raises the log-likelihood by more
than the penalty; the rest are estimated again without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.textkernel import slices, utf8_view

#: Bytes in an n-gram, and hashed kinds of n-grams.
GRAM, KINDS = 4, 1 << 16
#: Labelled documents that the model is fitted on: about so many of each language (the bound of the sample).
SAMPLE = 4000
#: Different labels at most.
LANGUAGES = 512
#: Steps of expectation-maximisation, and the log-likelihood that one more language must bring per doubling of a text.
STEPS, PENALTY = 8, 3.0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(65), *range(91, 97), *range(123, 128)]] = 32


def _kinds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kinds of all n-grams of the texts of a slice, in order, and the text each is of."""
    base, n = int(offsets[0]), len(offsets) - 1
    x = _FOLD[buf[base : offsets[-1]]].astype(np.uint32)
    if len(x) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    own = np.repeat(np.arange(n), np.diff(offsets))
    # Within one text, and not of blanks alone or runs of them.
    ok = (own[: len(k)] == own[3:]) & ((x[:-3] != 32) | (x[1:-2] != 32)) & ((x[1:-2] != 32) | (x[2:-1] != 32)) & ((x[2:-1] != 32) | (x[3:] != 32))
    return ((k[ok] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64), own[: len(k)][ok]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: lang, kind, n."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        buf, off = utf8_view(batch.column(0))
        langs = batch.column(1).to_pylist()
        for i, j in slices(off):
            kind, own = _kinds(buf, off[i : j + 1])
            names = np.array([langs[k] for k in range(i, j)], dtype=object)
            for lang in set(names):
                pick = (names == lang)[own] if len(own) else np.zeros(0, bool)
                total[lang] = total.get(lang, 0) + np.bincount(kind[pick], minlength=KINDS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "kind", "n"])


class LanguageModel:
    """Log-free n-gram probabilities of each language, smoothed with what all languages share."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        total = counts.sum(axis=0) + 0.5
        own = counts + 20.0 * total / total.sum() * KINDS / 64
        self.p = (own / own.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()  # kind x language

    def shares(self, kind: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
        """Language shares (n x languages) of n texts from their n-grams; texts without n-grams get equal shares."""
        langs = len(self.langs)
        share = np.full((n, langs), 1.0 / langs, np.float64)
        if not len(kind):
            return share
        key, count = np.unique(own * KINDS + kind, return_counts=True)
        doc, kind = key // KINDS, key % KINDS
        p, count = self.p[kind], count.astype(np.float64)
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        docs = doc[first]
        size = np.add.reduceat(count, first)
        row = np.repeat(np.arange(len(docs)), np.diff(np.append(first, len(doc))))

        def fit(s: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            for _ in range(steps):
                mixed = p * s[row]
                weight = count / np.maximum(mixed.sum(axis=1), 1e-30)
                s = np.add.reduceat(mixed * weight[:, None], first) / size[:, None]
            return s, np.add.reduceat(count * np.log(np.maximum((p * s[row]).sum(axis=1), 1e-30)), first)

        s, fitted = fit(share[docs], STEPS)
        # Drop the smallest share while the likelihood it brings is not worth the penalty.
        open_ = np.ones(len(docs), bool)
        for _ in range(langs - 1):
            held = np.where(s > 0, s, np.inf)
            least = held.argmin(axis=1)
            fewer = s.copy()
            fewer[np.arange(len(s)), least] = 0
            left = fewer.sum(axis=1)
            open_ &= (left > 1e-9) & ((s > 0).sum(axis=1) > 1)
            if not open_.any():
                break
            fewer = np.where(open_[:, None], fewer / np.maximum(left, 1e-30)[:, None], s)
            tried, value = fit(fewer, 2)
            open_ &= fitted - value < PENALTY * np.log2(size + 2)
            s = np.where(open_[:, None], tried, s)
            fitted = np.where(open_, value, fitted)
        share[docs] = s
        return share


def fit(docs: DataFrame, *, sample: int = SAMPLE) -> LanguageModel | None:
    """Fit on text and non-null lang of docs (all of them may be used).

    At most about `sample` documents of each language are read whole: those whose hash (of doc_id and text) falls under sample divided by the
    language's count.  The counts come back as one table of languages x KINDS at most; more than LANGUAGES different labels are an error, as
    lang is then no language and the table would not fit.  No labelled text gives None.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    sizes = {r[0]: r[1] for r in docs.where("lang is not null").groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} labels in lang")
    if not sizes:
        return None
    part = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(1.0, sample / n)))])
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    counts = labelled.where(draw < part[F.col("lang")]).select("text", "lang").mapInArrow(_counted, "lang string, kind int, n long")
    rows = counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("kind").alias("kind"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    if not rows:
        return None
    table = np.zeros((len(rows), KINDS))
    for i, r in enumerate(rows):
        table[i, r.kind] = r.n
    return LanguageModel([r.lang for r in rows], table)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        names = np.array(m.langs, dtype=object)
        for batch in batches:
            buf, off = utf8_view(batch.column(1))
            best, score, spoken = [], [], []
            for i, j in slices(off, 1 << 20):
                share = m.shares(*_kinds(buf, off[i : j + 1]), j - i)
                at = share.argmax(axis=1)
                best += names[at].tolist()
                score += share[np.arange(len(share)), at].clip(0, 1).tolist()
                spoken += (share > 0).sum(axis=1).tolist()
            letters = batch.column(2).to_pylist()
            best = [b if x else "und" for b, x in zip(best, letters, strict=True)]
            score = [s if x else 0.0 for s, x in zip(score, letters, strict=True)]
            spoken = [s if x else 0 for s, x in zip(spoken, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(spoken, pa.int32()), *batch.columns[3:]],
                names=["doc_id", "lang_pred", "score", "n_languages", *batch.schema.names[3:]],
            )

    return run


def held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether crc32 of the decimal doc_id is divisible by folds: such documents are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None, *, rows: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (the share of that language in the text, 0 to 1) and n_languages of every row; with rows the input row as a struct, too.

    lang_pred is 'und' with score 0 and no languages where text is null or has no letter, or without a model.  Only text decides.  Equal texts get
    equal answers, ties go to the language that sorts first; other columns are ignored.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    letters = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters, *row)
    if model is None:
        return d.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).alias("n_languages"), *(["row"] if rows else []))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x KINDS floats, bounded by the model's parameters
    schema = "doc_id long, lang_pred string, score double, n_languages int" + (f", row {d.schema['row'].dataType.simpleString()}" if rows else "")
    return d.mapInArrow(_predicted(sent), schema)
