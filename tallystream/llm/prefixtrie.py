"""The prefix trie of conversations and its rollup by centroid decomposition of the parent-edge forest.

Conversations that begin with the same turns share the nodes of these turns.  A node goes by (owner, depth): owner is the smallest conversation that passes
it.  Conversations own the lower end of their path; the path table, a row per conversation and depth with the node's owner, answers which ancestor a node has at a depth.

Subtree sums.  The forest below the root is cut into components at centroids.  A node weighs as many conversations as pass it, so the weight of its subtree is the number of turns
from it on, one aggregate.  With all components lighter than 2 * bound, a component has at most one chain of nodes whose remaining subtree weighs bound or more; the deepest is
its centroid.  The total of the centroid's subtree is added to all nodes from the centroid to the component's top, then the centroid goes: its children's subtrees and what is
left above are components lighter than bound.  The bound is halved until components are lighter than 2 * LEAST; there every node adds itself to its ancestors in the component, fewer than 2 * LEAST.
A round emits no more rows than there are nodes, so the work is nodes * log(turns), however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.llm.tables import HEAVY, drop, settled, spread, written

#: A block holds 2^BITS neighbouring turns of a conversation, or conversation ids that are joined into one string.
BITS = 12
#: Components lighter than twice this are rolled up directly.
LEAST = 16

_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns by position and the conversations: (conv_id, pos from 1, h1, h2, words) and (conv_id, n).

    turns has conv_id, turn, role, text.  A conversation's turns come in order of turn, null first, then of a hash of role and text; null role or text counts as empty.  h1 and h2 are
    hashes of role and text, words is the number of words of the text.  Rows without conv_id belong to no conversation and take no part.  A long conversation is ranked in many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(F.lit("one"), role, text).alias("h1"), F.xxhash64(F.lit("two"), role, text).alias("h2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    # Pieces of a range partitioning follow each other, so a row's rank is its rank in its piece plus the rows of the pieces before.
    rows = written(rows.repartitionByRange("conv_id", "turn", "h1").withColumn("piece", F.spark_partition_id()))
    pieces = rows.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy("turn", "h1", "h2"))
    ranked = rows.withColumn("local", local).join(pieces.select("conv_id", "piece", before.alias("before")), ["conv_id", "piece"])
    placed = written(ranked.select("conv_id", (F.col("before") + F.col("local")).alias("pos"), "h1", "h2", "words", "piece"))
    convs = written(pieces.groupBy("conv_id").agg(F.sum("n").alias("n")))
    drop(rows)
    return placed, convs


def rebuilt(placed: DataFrame, convs: DataFrame, *, family: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads, in the form of ordered(): conversation c begins with the first h turns of conversation c - c % family and goes on with its own turns after its first h; h = crc32(decimal c) % heads.

    All turns if the first one has fewer than h, none if it is absent.  A conversation may be left without turns.
    """
    of = convs.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    of = of.join(sizes, "base", "left").withColumn("cut", F.least("h", F.coalesce("base_n", F.lit(0))))
    first = placed.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base").drop("piece")
    head = of.where("cut > 0").select("conv_id", "base", "cut").join(first, "base").where("pos <= cut").select("conv_id", "pos", "h1", "h2", "words")
    # A long conversation is joined by its pieces.
    pieces = placed.select("conv_id", "piece").distinct().join(of.select("conv_id", "h", "cut"), "conv_id")
    own = placed.join(pieces, ["conv_id", "piece"]).where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("cut")).alias("pos"), "h1", "h2", "words")
    return head.unionByName(own), of.select("conv_id", (F.col("cut") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("long").alias("n"))


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, pos, n, words, key, above): key names the first pos turns, above the first pos - 1; n is the conversation's length."""
    # Hashes that hold the position, so that their xor depends on the order.
    rows = turns.select("conv_id", "pos", F.xxhash64("pos", "h1").alias("k1"), F.xxhash64("pos", "h2", F.lit("two")).alias("k2"), "words", F.shiftright("pos", BITS).alias("block"))
    rows = written(rows)
    run = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"))
    lengths = blocks.join(convs, "conv_id").select("conv_id", "block", "n", F.coalesce(F.bit_xor("b1").over(done), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("b2").over(done), F.lit(0)).alias("b2"))
    summed = rows.withColumn("s1", F.bit_xor("k1").over(run)).withColumn("s2", F.bit_xor("k2").over(run)).join(lengths, ["conv_id", "block"])
    p1, p2 = F.col("s1").bitwiseXOR(F.col("b1")), F.col("s2").bitwiseXOR(F.col("b2"))
    key = F.struct("pos", p1.alias("k1"), p2.alias("k2"))
    above = F.struct((F.col("pos") - 1).alias("pos"), p1.bitwiseXOR(F.col("k1")).alias("k1"), p2.bitwiseXOR(F.col("k2")).alias("k2"))
    out = written(summed.select("conv_id", "pos", "n", "words", key.alias("key"), above.alias("above")))
    drop(rows)
    return out


def _trie(prefixes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The nodes below the root, the path table (conv_id, pos, n, owner, parent), and the number of its rows."""
    nodes = written(prefixes.groupBy("key").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.first("above").alias("above"), F.sum(F.col("n") - F.col("pos") + 1).alias("weight"),
    ))
    rows, some = prefixes.count(), nodes.count()
    kids = nodes.groupBy("above").agg(F.count(F.lit(1)).alias("n"))
    up = nodes.select(F.col("key").alias("above"), F.col("owner").alias("parent"))
    left, right = spread(nodes.where("key.pos > 1"), up, "above", some, kids)
    linked = left.join(right, ["above", "salt"]).drop("salt").unionByName(nodes.where("key.pos = 1").withColumn("parent", F.lit(None).cast("long")))
    counted = linked.join(kids.select(F.col("above").alias("key"), F.col("n").alias("n_children")), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = written(counted.select("key", "owner", F.col("key.pos").alias("depth"), "parent", "n_convs", "n_children", "weight", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    left, right = spread(prefixes.select("conv_id", "pos", "n", "key"), full.select("key", "owner", "parent"), "key", rows, full.select("key", F.col("n_convs").alias("n")))
    paths = written(left.join(right, ["key", "salt"]).select("conv_id", "pos", "n", "owner", "parent"))
    drop(nodes)
    return full.drop("key"), paths, rows


def _decomposed(nodes: DataFrame, paths: DataFrame, rows: int) -> DataFrame:
    """(owner, depth, n_leaves, saved_tokens) of the nodes below the root, by centroids; rows is the number of rows of paths."""
    on_path = lambda conv, pos: paths.select(F.col("conv_id").alias(conv), F.col("pos").alias(pos), F.col("owner").alias("at"), F.col("parent").alias("at_parent"))
    leaf = (F.col("n_children") == 0).cast("long").alias("leaf")
    tops = paths.where("pos = 1").select("conv_id", F.col("owner").alias("top")).withColumnRenamed("conv_id", "owner")
    left, right = spread(nodes.select("owner", "depth", "weight", leaf, "saved"), tops, "owner", rows)
    state = written(left.join(right, ["owner", "salt"]).select("owner", "depth", F.struct("top", F.lit(1).cast("long").alias("top_depth")).alias("comp"), "weight", "leaf", "saved"))
    added = []
    while True:
        most = state.agg(F.max("weight")).first()[0]
        if most is None or most < 2 * LEAST:
            break
        bound = 1 << (most.bit_length() - 1)
        deepest = F.min_by(F.struct("owner", "depth", "weight"), F.col("weight"))  # in one component heavy nodes form a chain
        cents = written(state.where(F.col("weight") >= bound).groupBy("comp").agg(deepest.alias("c")).select("comp", F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")))
        # The path from each centroid up to its component's top.
        steps = cents.select("comp", "c_owner", "c_depth", "c_weight", F.explode(F.sequence(F.col("comp.top_depth"), F.col("c_depth"))).alias("step"))
        path = written(steps.join(on_path("c_owner", "step"), ["c_owner", "step"]).select(F.col("at").alias("owner"), F.col("step").alias("depth"), "comp", F.col("c_weight").alias("off")))
        # Nodes below a centroid go to the component of its child above them.
        if cents.count() <= HEAVY:
            cut = state.join(F.broadcast(cents), "comp", "left")
        else:
            left, right = spread(state, cents, "comp", rows)
            cut = left.join(right, ["comp", "salt"], "left").drop("salt")
        own = F.col("owner") == F.col("c_owner")
        ask = F.when((F.col("depth") > F.col("c_depth")) & ~own, F.col("c_depth") + 1).otherwise(-1)
        found = cut.withColumn("ask", ask).join(on_path("owner", "ask").withColumnRenamed("at_parent", "over"), ["owner", "ask"], "left")
        below = F.coalesce(own & (F.col("depth") > F.col("c_depth")), F.lit(False)) | F.coalesce(F.col("over") == F.col("c_owner"), F.lit(False))
        child = F.struct(F.when(own, F.col("owner")).otherwise(F.col("at")).alias("top"), (F.col("c_depth") + 1).alias("top_depth"))
        kept = found.withColumn("below", below).join(path.select("owner", "depth", "off"), ["owner", "depth"], "left").select(
            "owner", "depth", F.col("comp").alias("old"), F.when(F.col("below"), child).otherwise(F.col("comp")).alias("comp"), "leaf", "saved", "below",
            (F.col("weight") - F.coalesce("off", F.lit(0))).alias("weight"), F.coalesce(own & (F.col("depth") == F.col("c_depth")), F.lit(False)).alias("central"),
        )
        kept = written(kept)
        total = kept.where("below or central").groupBy(F.col("old").alias("comp")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        added.append(written(path.join(total, "comp").select("owner", "depth", "leaf", "saved")))
        drop(state, cents, path)
        state = kept.where("not central").select("owner", "depth", "comp", "weight", "leaf", "saved")
        state._tallystream_path = kept._tallystream_path
    steps = state.withColumn("step", F.explode(F.sequence(F.col("comp.top_depth"), F.col("depth")))).select(F.col("owner").alias("conv"), "step", "leaf", "saved")
    out = steps.join(on_path("conv", "step"), ["conv", "step"]).select(F.col("at").alias("owner"), F.col("step").alias("depth"), "leaf", "saved")
    for a in added:
        out = out.unionByName(a)
    return out.groupBy("owner", "depth").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's strings in their order, joined by commas; a node's rows lie behind each other, over batches too."""
    node, state = None, None
    for b in batches:
        out = []
        for owner, depth, ids in zip(b.owner, b.depth, b.ids):
            if (owner, depth) == node:
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["owner", "depth", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["owner", "depth", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256) of conversations by the node they end at: ids in order, in strings of neighbouring ids, then one digest after the other."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = ends.groupBy("owner", "depth", F.shiftright("conv_id", BITS).alias("block")).agg(ids.alias("ids"))
    lines = blocks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").select("owner", "depth", "ids")
    return lines.mapInPandas(_hashed, "owner long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations, in the form of ordered(): turns (conv_id, pos, h1, h2, words) and conversations (conv_id, n), of which some may have no turns.

    A node of depth d is a distinct sequence of d turns that conversations (its members) begin with; the root has depth 0.  Returns conv_id (the smallest member), depth,
    parent_conv_id (the parent's conv_id; null for the root), n_convs (members), n_children, n_leaves (nodes without children in its subtree, itself included), saved_tokens (over its subtree: (n_convs - 1)
    * words of the node's last turn), ends_sha256 (of the decimal ids of members that end there, ascending, joined by commas).  Sequences are told apart by 128-bit hashes.
    No conversations give no rows, not even a root.
    """
    spark = turns.sparkSession
    convs = written(convs)
    whole = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    if not whole.n:
        return spark.createDataFrame([], _OUT)
    prefixes = _prefixes(turns, convs)
    nodes, paths, rows = _trie(prefixes)
    drop(prefixes)
    sums = _decomposed(nodes, paths, rows)
    root = F.lit(whole.least).alias("owner"), F.lit(0).cast("long").alias("depth")
    ended = paths.where("pos = n").select("owner", F.col("pos").alias("depth"), "conv_id").unionByName(convs.where("n = 0").select(*root, "conv_id"))
    top = nodes.agg(
        F.coalesce(F.sum((F.col("depth") == 1).cast("long")), F.lit(0)).alias("n_children"), F.greatest(F.lit(1), F.sum((F.col("n_children") == 0).cast("long"))).alias("n_leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"),
    ).select(*root, F.lit(None).cast("long").alias("parent"), F.lit(whole.n).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    parent = F.when(F.col("depth") == 1, F.lit(whole.least)).otherwise(F.col("parent"))
    every = nodes.join(sums, ["owner", "depth"]).select("owner", "depth", parent.alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens").unionByName(top)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.join(_ends(ended), ["owner", "depth"], "left").select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def conversation_trie(conversations: DataFrame, *, family: int = 20, heads: int = 4) -> DataFrame:
    """prefix_trie() of the conversations rebuilt(): the result is written once and all intermediate tables are dropped."""
    return settled(lambda: prefix_trie(*rebuilt(*ordered(conversations), family=family, heads=heads)))
