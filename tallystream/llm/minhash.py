"""MinHash near-deduplication with SetSketch registers.

Every text's distinct word shingles become a sketch of exponentially spaced, truncated minima (Ertl's SetSketch):
register i holds floor(1 - log_b(x_i)), clipped to 0..q+1, of the smallest exponential value x_i that hash i gives.
Sketches of two sets merge by the larger register, and two registers agree about as often as the sets overlap.

1. Texts with equal shingle sets form a class; only its smallest doc_id goes on.
2. Bands of registers are hashed; a bucket's members are compared with one hub, so a bucket gives a row per member.
3. Likelihood: the counts of greater, smaller and equal registers and both set sizes give the most likely Jaccard
   similarity.  Pairs five standard errors under the threshold go, all others are confirmed on full sets.
4. Buckets whose members are still in more than one component are finished exactly: over their documents, two sets
   that reach the threshold share one of their rarest shingles at positions that leave room for the needed
   overlap.  Within a family (components that a hub's likely pairs join) sets are written as their differences from the
   family's usual shingles, which are few and rare, so members that differ from each other do not meet over what all of them share.
   Such pairs are confirmed on full sets, too.  No bucket is capped; sets that share only common shingles do not meet.
5. Components by large-star and small-star steps.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.llm.components import connected_components
from tallystream.llm.tables import drop, spread, written
from tallystream.llm.textkernel import shingle_hashes, slices, utf8_view, word_hashes

#: Registers, and registers to a band.  Sets with a similarity of 0.8 share a band with a chance of 1 - 5e-8.
REGISTERS, BAND = 128, 4
#: Kinds of buckets that choose their hubs alike.
HUBS = 8
#: Salts of a hot shingle or difference: its rows on the other side are repeated so many times.
SALTS = 8
#: SetSketch's base, rate and largest register value.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
_rng = np.random.Generator(np.random.PCG64(8191))
_A, _B = (_rng.integers(1, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes (uint16; zeros for an empty set)."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint16)
    hi, lo = (shingles >> np.uint64(32)).astype(np.uint32), shingles.astype(np.uint32)
    best = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hi), 512):
        v = hi[i : i + 512, None] * _A
        v += lo[i : i + 512, None] * _B
        np.minimum(best, v.min(axis=0), out=best)
    x = -np.log1p(-(best.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8_view(batch.column(1))
            size, digest, regs = [], [], []
            for i, j in slices(off):
                words, first = word_hashes(buf, off[i : j + 1])
                for k in range(j - i):
                    s = shingle_hashes(words[first[k] : first[k + 1]], width)
                    size.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())],
                names=["doc_id", "id", "n_shingles", "digest", "regs"],
            )

    return run


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, id, n_shingles, digest of the shingle set, and its registers (two bytes each); the last two null for an empty set."""
    return docs.select("doc_id", "text", "id").mapInArrow(_sketch(width), "doc_id long, id long, n_shingles long, digest binary, regs binary")


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8_view(batch.column(1))
            for i, j in slices(off):
                words, first = word_hashes(buf, off[i : j + 1])
                sets = [shingle_hashes(words[first[k] : first[k + 1]], width).view(np.int64) for k in range(j - i)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], names=["doc_id", "shingles"])

    return run


def likely_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of pairs of sketches (rows of a and b) of sets of na and nb elements."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1.0 - u
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    for share in np.linspace(0.0, 1.0, 201):
        j = share * np.minimum(u / v, v / u)
        up, down = p(u - v * j), p(v - u * j)
        fit = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = fit > best
        best, at = np.where(better, fit, best), np.where(better, j, at)
    return at


def _likely(least: float):
    @F.pandas_udf("boolean")
    def keep(ra, rb, na, nb):
        import pandas as pd

        if not len(ra):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), -1) for x in (ra, rb))
        return pd.Series(likely_similarity(a, b, na.to_numpy(float), nb.to_numpy(float)) >= least)

    return keep


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets reach the threshold, as edges (u, v)."""
    left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _within_families(docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents (doc_id, component, family, shingles) of one family and different components: all that may reach the threshold, as far as they join components.

    With D = set ^ usual, |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, whatever the usual shingles are.  So x and y reach the threshold if, and only if,
    2 (100 + percent) |Dx & Dy| >= cost(x) + cost(y), where cost = 2 percent n - (100 + percent) (n - |D|).  What reaches it without any shared difference does
    so with the member of least cost, the centre; the components of these members are the core.  All other pairs share one of their rarest differences.
    """
    scale = 100 + percent
    families = docs.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("family", "size")
    left, right = spread(docs, families, "family", docs.count())
    inside = written(left.join(right, ["family", "salt"]).drop("salt"))
    rows = inside.count()
    # More than half of the members have each usual shingle, so there are less than twice as many as in a mean set.
    usual = inside.select("family", "size", F.explode("shingles").alias("t")).groupBy("family", "t").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("2 * n > size")
    usual = inside.select("family").distinct().join(usual, "family", "left").groupBy("family").agg(F.collect_list("t").alias("usual"))
    left, right = spread(inside, usual, "family", rows)
    apart = written(
        left.join(right, ["family", "salt"])
        .select("doc_id", "component", "family", F.size("shingles").cast("long").alias("n"), F.concat(F.array_except("shingles", "usual"), F.array_except("usual", "shingles")).alias("apart"))
        .withColumn("d", F.size("apart").cast("long"))
        .withColumn("cost", 2 * percent * F.col("n") - scale * (F.col("n") - F.col("d")))
    )
    drop(inside)
    centres = apart.groupBy("family").agg(F.min("cost").alias("least"), F.min_by("doc_id", F.struct("cost", "doc_id")).alias("centre"))
    left, right = spread(apart.select("doc_id", "component", "family", "cost"), centres, "family", rows)
    near = written(left.join(right, ["family", "salt"]).where("cost + least <= 0").select("doc_id", "component", "centre"))
    core = near.select("component").distinct().withColumn("core", F.lit(True))
    left, right = spread(apart, core, "component", rows)
    sided = written(left.join(right, ["component", "salt"], "left").withColumn("core", F.coalesce("core", F.lit(False))).drop("salt"))
    drop(apart)
    bounds = sided.groupBy("family").agg(F.min("cost").alias("least"), F.min(F.when(~F.col("core"), F.col("cost"))).alias("outer")).where("outer is not null")
    left, right = spread(sided, bounds, "family", rows)
    bound = F.col("cost") + F.when(F.col("core"), F.col("outer")).otherwise(F.col("least"))
    parts = written(left.join(right, ["family", "salt"]).select("doc_id", "component", "family", "core", "n", "d", "cost", bound.alias("bound"), F.explode("apart").alias("t")))
    # A difference that only one component or only the core has joins nothing; it stands for the rarest kind in the order.
    often = parts.groupBy("family", "t").agg(
        F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("core").alias("all_core")
    ).where("lo < hi and not all_core")
    order = Window.partitionBy("doc_id").orderBy("df", "t")
    prefix = written(
        parts.join(often.select("family", "t", "df"), ["family", "t"], "left")
        .withColumn("df", F.coalesce("df", F.lit(1)))
        .withColumn("left", F.col("d") - F.row_number().over(order) + 1)
        .where((F.col("df") > 1) & (2 * scale * F.col("left") >= F.col("bound")))
        .select("doc_id", "component", "core", "n", "cost", "left", F.xxhash64("family", "t").alias("t"))
    )
    x, y = (prefix.select(F.col("t"), *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "component", "core", "n", "cost", "left"))) for k in "ab")
    x, y = spread(x.where("not core_a"), y, "t", prefix.count(), salts=SALTS)
    met = (
        x.join(y, ["t", "salt"])
        .where((F.col("component_a") != F.col("component_b")) & (F.col("core_b") | (F.col("doc_id_b") < F.col("doc_id_a"))))
        .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .where(2 * scale * F.least("left_a", "left_b") >= F.col("cost_a") + F.col("cost_b"))
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
    )
    met = written(met.unionByName(near.where("doc_id <> centre").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))).distinct())
    drop(near, sided, parts, prefix)
    return met


def _across_families(docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents (doc_id, family, shingles) of different families: all that may reach the threshold."""
    tokens = written(docs.select("doc_id", "family", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("t")))
    # Of the members of the family that has a shingle most often, none need look for each other.
    often = tokens.groupBy("t", "family").agg(F.count(F.lit(1)).alias("df")).groupBy("t").agg(
        F.sum("df").alias("df"), F.max_by("family", F.struct("df", "family")).alias("most"), F.count(F.lit(1)).alias("families")
    ).where("families > 1")
    # A shingle in one family only can't join two; it stands for the rarest kind (df 1) in the order.
    order = Window.partitionBy("doc_id").orderBy("df", "t")
    prefix = written(
        tokens.join(often.select("t", "df", "most"), "t", "left")
        .withColumn("df", F.coalesce("df", F.lit(1)))
        .withColumn("left", F.col("n") - F.row_number().over(order) + 1)
        .where((F.col("df") > 1) & (100 * F.col("left") >= percent * F.col("n")))
        .select("doc_id", "family", "n", "t", "left", (F.col("family") == F.col("most")).alias("lead"))
    )
    x, y = (prefix.select(F.col("t"), *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "family", "n", "left", "lead"))) for k in "ab")
    x, y = spread(x.where("not lead_a"), y, "t", prefix.count(), salts=SALTS)
    met = written(
        x.join(y, ["t", "salt"])
        .where((F.col("family_a") != F.col("family_b")) & (F.col("lead_b") | (F.col("doc_id_b") < F.col("doc_id_a"))))
        .where((100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b")))
        .select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b"))
        .distinct()
    )
    drop(tokens, prefix)
    return met


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Group texts whose distinct `width`-word shingle sets have a Jaccard similarity of at least percent/100.

    Returns a row per input row: doc_id, n_shingles (size of its set), component_id (the smallest doc_id reachable over
    links, its own included) and kept (doc_id = component_id).  Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased.
    A null text, and one without words, has an empty set and is linked with nothing.  Repeated rows get equal rows; rows that share a doc_id with different
    texts are linked each by its own text.  A row without doc_id is linked like any other; it is not kept, and component_id is null if nothing that it reaches has one.  Columns
    other than doc_id and text are ignored.
    """
    # Inside, a row goes by a hash of doc_id and text, so that every text is one node; doc_ids come back at the end.
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("doc_id"), "text", F.col("doc_id").cast("long").alias("id"))
    sk = written(sketches(docs, width))
    classes = sk.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("id").alias("id"))
    reps = written(
        sk.join(classes, (sk.digest == classes.digest) & (sk.doc_id == classes.rep), "left_semi").select("doc_id", "n_shingles", "regs").dropDuplicates(["doc_id"])
    )
    step = 2 * BAND
    bands = reps.select(
        "doc_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * step + 1, F.lit(step))))).alias("bucket"),
    )
    # Buckets of one kind prefer the same members, so the members of a large group meet few hubs, however many bands they share.
    hubs = bands.groupBy("bucket").agg(F.min_by("doc_id", F.xxhash64("doc_id", F.pmod("bucket", F.lit(HUBS)))).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(bands.join(hubs.select("bucket", "hub"), "bucket"))
    wanted = members.select("doc_id").distinct()
    sets = written(
        docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
        .mapInArrow(_sets(width), "doc_id long, shingles array<long>")
        .dropDuplicates(["doc_id"])
    )
    pairs = members.where("doc_id <> hub").select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    ra, rb = (reps.select(F.col("doc_id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}")) for x in "ab")
    j = percent / 100
    least = j - 5 * math.sqrt(j * (1 - j) / REGISTERS)
    likely = written(
        pairs.join(ra, "a").join(rb, "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .where(_likely(least)("ra", "rb", "na", "nb"))
        .select("a", "b")
    )
    edges = written(_confirmed(likely, sets, percent))
    first = written(connected_components(edges))

    # What a hub did not settle: buckets with more than one component.
    label = lambda d, k: d.join(first.withColumnRenamed("node", k), k, "left").withColumn("component", F.coalesce("component", k))
    labelled = label(members.select("bucket", "doc_id"), "doc_id")
    open_buckets = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    unsettled = labelled.join(open_buckets, "bucket", "left_semi").select("doc_id", "component").distinct()
    # A family is what the pairs join that look alike and are not linked; any partition would do, as other pairs are looked for across families.
    alike = label(label(likely, "a").select("b", F.col("component").alias("u")), "b").select("u", F.col("component").alias("v"))
    family = connected_components(alike).select(F.col("node").alias("component"), F.col("component").alias("family"))
    unsettled = unsettled.join(family, "component", "left").withColumn("family", F.coalesce("family", "component"))
    unsettled = written(sets.join(unsettled, "doc_id"))
    within, across = _within_families(unsettled, percent), _across_families(unsettled, percent)
    rest = within.unionByName(across)
    more = written(_confirmed(rest, sets, percent))
    merged = label(label(more, "u").select(F.col("component").alias("u"), "v"), "v").select("u", F.col("component").alias("v"))
    second = connected_components(merged).select(F.col("node").alias("component"), F.col("component").alias("final"))
    of_class = label(classes.select("digest", "id", F.col("rep").alias("doc_id")), "doc_id").join(second, "component", "left").select("digest", "id", F.coalesce("final", "component").alias("component"))
    least_id = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = written(of_class.select("digest", "component").join(least_id, "component").select("digest", "component_id"))
    drop(reps, members, sets, likely, edges, first, unsettled, within, across, more)
    own = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return (
        sk.select("id", "n_shingles", "digest").join(labels, "digest", "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))
    )
