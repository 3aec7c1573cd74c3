"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are hashed into blocks of about BLOCK documents.  A source's target says how many whole passes
over its blocks the mix makes and how many words of one more pass; that pass takes the blocks of a pseudo-random
permutation while they fit whole; the room left is filled with documents of the blocks after these, until no document that is left
fits.  These documents make one last block, so every source has an exact quota of blocks.  A tree splits all quotas among the output shards: at each node the left half's blocks are a
multivariate-hypergeometric draw from the node's.  The leaves give each shard a run of each source's permuted blocks,
disjoint from all others; documents are shuffled within their shard by a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.llm.tables import drop, written

#: Documents to a block, and blocks to a stratum (running sums go over strata first, then within one).
BLOCK, STRATUM = 64, 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, docs, source_size and target of each source of sizes (source, docs, source_size).

    Sources in the order of their code points, null last, get the weights in turn.  Targets are share times all sizes by weight;
    one that passes most times its source's size stops there and the excess is shared by weight among the rest.
    In the order of cap / weight the capped sources come first, so the level at which the others stop is a quotient of running sums.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("weight", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(so_far), F.lit(0.0))
    )
    s = s.withColumn("level", level)
    stop = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    return s.withColumn("stop", F.coalesce(stop.getField("level"), F.lit(float("inf")))).select(
        "source", "docs", "source_size", F.least("cap", F.col("stop") * F.col("weight")).alias("target")
    )


def _drawn(quotas: np.ndarray, totals: np.ndarray, seed: list[int]) -> np.ndarray:
    """A table of shards x colours with these margins: at each node of the tree the left half's blocks are a multivariate-hypergeometric draw."""
    parts = np.zeros((len(totals), len(quotas)), np.int64)

    def node(lo: int, hi: int, left: np.ndarray) -> None:
        if hi - lo == 1:
            parts[lo] = left
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.PCG64([*seed, lo, hi]))
        take, others = int(totals[lo:mid].sum()), int(left.sum())
        got = np.zeros_like(left)
        for i in np.flatnonzero(left):  # one colour after the other: sums may pass the library's limit for all at once
            others -= int(left[i])
            if take:
                got[i] = rng.hypergeometric(int(left[i]), others, take)
                take -= int(got[i])
        node(lo, mid, got)
        node(mid, hi, left - got)

    node(0, len(totals), quotas)
    return parts


#: Sources are dealt into so many groups: the tree splits the groups' quotas first, and below each group those of its sources.
GROUPS = 256


def _split_groups(shards: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        quotas = pdf.quota.to_numpy(np.int64)
        totals = np.diff(quotas.sum() * np.arange(shards + 1) // shards)
        return pd.DataFrame({"g": pdf.g, "totals": _drawn(quotas, totals, [seed]).T.tolist()})

    return run


def _split_sources(seed: int):
    def run(key, pdf: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"source": [], "ends": []})
        pdf = pdf.sort_values(["source"], na_position="last")
        parts = _drawn(pdf.quota.to_numpy(np.int64), np.array(totals.totals.iloc[0], np.int64), [seed, int(key[0]) + 1])
        return pd.DataFrame({"source": pdf.source, "ends": parts.cumsum(axis=0).T.tolist()})

    return run


def splits(quota: DataFrame, shards: int, seed: int) -> DataFrame:
    """source and ends (running sums over shards) of the blocks that each shard gets of each source's quota (source, quota)."""
    q = quota.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(GROUPS)).cast("int"))
    groups = q.groupBy("g").agg(F.sum("quota").alias("quota"))  # GROUPS rows at most
    totals = groups.groupBy(F.lit(0).alias("tree")).applyInPandas(_split_groups(shards, seed), "g int, totals array<bigint>")
    return q.select("g", "source", "quota").groupBy("g").cogroup(totals.groupBy("g")).applyInPandas(_split_sources(seed), "source string, ends array<bigint>")


def numbered(rows: DataFrame) -> DataFrame:
    """rows (base, id, ...) with h, a hash of base and of the row's number among those of equal base.

    Numbers are given within the parts of the table (the upper bits of id) and shifted by the counts of the parts before, so a base that many rows
    have is never in one task.  Rows of equal base are interchangeable, so which of them gets which number does not matter.
    """
    rows = rows.withColumn("part", F.shiftright("id", 33))
    counts = rows.groupBy("base", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    shift = counts.select("base", "part", F.sum("n").over(before).alias("shift")).where("shift is not null")
    own = F.row_number().over(Window.partitionBy("base", "part").orderBy("id")) - 1
    out = rows.withColumn("number", own).join(shift, ["base", "part"], "left")
    return out.withColumn("h", F.xxhash64("base", F.col("number") + F.coalesce("shift", F.lit(0)))).drop("part", "number", "shift", "id")


def _with_ahead(block: DataFrame) -> DataFrame:
    """block (source, place, words, ...) with the words of a source's blocks before each; sums go over strata first, then within one."""
    block = block.withColumn("stratum", F.floor(F.col("place") / STRATUM))
    strata = block.groupBy("source", "stratum").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select(F.col("source").alias("of"), F.col("stratum").alias("st"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        block.join(strata, F.col("source").eqNullSafe(F.col("of")) & (F.col("stratum") == F.col("st")))
        .withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("words").over(within), F.lit(0)))
        .drop("of", "st", "stratum")
    )


def _filling(dealt: DataFrame, state: DataFrame) -> list[DataFrame]:
    """source, place and h of the documents that fill the room (of, at, room) of sources from their blocks after `at`.

    A round takes, block after block, what fits whole among the documents no longer than the room, then of the block that overflows documents from
    the largest down.  The next round goes on behind that block.  What is passed over is longer than the room left, and the room at least halves
    (the document taken first is longer than what is left), so the rounds are few.
    """
    same = F.col("source").eqNullSafe(F.col("of"))
    units = dealt.where("size > 0").join(state, same & (F.col("place") > F.col("at"))).select("source", "place", "h", "size", F.col("room").alias("most"))
    units = written(units.where("size <= most").drop("most"))
    found = []
    while not state.isEmpty():
        fits = units.join(state, same & (F.col("place") > F.col("at")) & (F.col("size") <= F.col("room"))).drop("of", "at")
        block = _with_ahead(fits.groupBy("source", "place", "room").agg(F.sum("size").alias("words"))).where("ahead < room")
        block = block.select(F.col("source").alias("of"), F.col("place").alias("p"), (F.col("room") - F.col("ahead")).alias("left"), (F.col("ahead") + F.col("words") <= F.col("room")).alias("full"))
        choice = F.aggregate(
            F.sort_array(F.collect_list(F.struct("size", "h")), asc=False),
            F.struct(F.first("left").alias("room"), F.array().cast("array<bigint>").alias("ids")),
            lambda s, x: F.struct(F.when(x.size <= s.room, s.room - x.size).otherwise(s.room).alias("room"), F.when(x.size <= s.room, F.concat(s.ids, F.array(x.h))).otherwise(s.ids).alias("ids")),
        )
        # A round's documents by block, and the room that its overflowing block leaves.
        taken = fits.join(block, same & (F.col("place") == F.col("p"))).groupBy("source", "place", "full").agg(choice.alias("choice"))
        taken = written(taken.select("source", "place", "full", "choice.room", "choice.ids"))
        found.append(taken.select("source", "place", F.explode("ids").alias("h")))
        state = taken.where("not full and room > 0").select(F.col("source").alias("of"), F.col("place").alias("at"), "room")
    drop(units)
    return found


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns: rows that share it are equal."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def mix(docs: DataFrame, *, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 7, keys: bool = False) -> DataFrame:
    """How often the mix takes each document, and where to.

    Returns a row per input row: doc_id, size (words of text; 0 for null), source, source_size, target, taken (size times
    the number of takes, 0 to 2), takes, and places: for each take the output shard and the place key by which the shard's documents are
    shuffled; with keys also key (`row_key`).  A document is taken whole or not; no document that a source's words would still have room for is left out.
    Every row is a document of its own, whether it shares its doc_id with others, has none, or is repeated.  An empty table gives no rows; rows
    without words are taken 0 words.  Documents are hashed into blocks, so that any order of the blocks is a random one.  Reruns agree, whatever
    the partitioning.  Columns other than doc_id, text and source only serve to tell rows apart.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_key(docs).alias("base"), F.monotonically_increasing_id().alias("id")
    )
    rows = numbered(written(rows))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    goal = (
        targets(sizes, weights, share, most)
        .withColumn("blocks", F.ceil(F.col("docs") / BLOCK))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    )
    goal = written(goal)
    same = F.col("source").eqNullSafe(F.col("of"))
    place = F.pmod(F.xxhash64(F.lit(seed), "h"), F.col("blocks"))
    dealt = written(
        rows.join(goal.withColumnRenamed("source", "of"), same).select("doc_id", "source", "size", "base", "h", "source_size", "target", "blocks", "passes", "rest", place.alias("place"))
    )
    block = _with_ahead(dealt.groupBy("source", "place", "rest").agg(F.sum("size").alias("words"))).where(F.col("ahead") + F.col("words") <= F.col("rest"))
    whole = block.groupBy("source").agg(F.max("place").alias("at"), F.max(F.col("ahead") + F.col("words")).alias("words"))
    # Of each source the last block that fits whole, and the room behind it.
    reached = goal.join(whole.withColumnRenamed("source", "of"), same, "left").select(
        "source", "passes", "blocks", F.coalesce("at", F.lit(-1)).alias("at"), (F.col("rest") - F.coalesce("words", F.lit(0))).alias("room")
    )
    reached = written(reached)
    found = _filling(dealt, reached.where("room > 0").select(F.col("source").alias("of"), "at", "room"))
    picked = dealt.select("source", "place", "h").limit(0)
    for f in found:
        picked = picked.union(f)
    picked = written(picked.select(F.col("source").alias("of"), F.col("place").alias("p"), F.col("h").alias("picked")))
    filled = picked.groupBy("of").agg(F.lit(1).alias("filled"))
    quota = reached.join(filled, same, "left").select("source", (F.col("passes") * F.col("blocks") + F.col("at") + 1 + F.coalesce("filled", F.lit(0))).alias("quota"))
    ends = splits(quota, shards, seed)
    ends = reached.join(ends.withColumnRenamed("source", "of"), same).select(F.col("source").alias("of"), "at", "ends")
    taken = (
        dealt.join(ends, same).drop("of")
        .join(picked, same & (F.col("place") == F.col("p")) & (F.col("h") == F.col("picked")), "left")
        .withColumn("more", (F.col("place") <= F.col("at")) | F.col("picked").isNotNull())
        .withColumn("takes", (F.col("passes") + F.col("more").cast("int")).cast("int"))
    )
    slot = lambda k: F.when(F.col("picked").isNotNull() & (k == F.col("passes")), F.col("at") + 1).otherwise(F.col("place"))
    shard = lambda k: F.size(F.filter("ends", lambda e: e <= slot(k) + k * F.col("blocks")))
    places = F.transform(F.sequence(F.lit(1), F.lit(int(most) + 1)), lambda k: F.struct(shard(k - 1).cast("int").alias("shard"), F.xxhash64(F.lit(seed), "h", k).alias("key")))
    key = [F.col("base").alias("key")] if keys else []
    return taken.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"), "takes", F.slice(places, 1, F.col("takes")).alias("places"), *key
    )
