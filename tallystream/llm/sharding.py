"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard has virtual nodes on a ring of cells; a row hashes (by doc_id and text) to a cell and belongs to the next virtual
node clockwise, whose arc ends there.  A shard takes no more rows than its room (row counts at most one apart).
It first takes rows of its own arcs; room left over lies in equal parts at its virtual nodes.  Rows that find
their shard full continue clockwise, first come, first served, to the next virtual node with room.  As all room together
equals all rows, every row is placed; only rows of overfull shards move.

Who goes where follows from row counts by cell alone, by running sums over tables bounded by the numbers of cells and
virtual nodes; the rows are ranked within their cells, in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.llm.tables import written


def _ring(docs: DataFrame, shards: int, vnodes: int, cells: int) -> DataFrame:
    """A row per cell: its arc (the cell of its virtual node), shard, rows, and the rows of its arc before it."""
    spark = docs.sparkSession
    nodes = (
        spark.range(shards * vnodes, numPartitions=1)
        .select(F.expr(f"id div {vnodes}").cast("int").alias("shard"), (F.col("id") % vnodes).alias("number"))
        .select("shard", F.pmod(F.xxhash64(F.lit("node"), "shard", "number"), F.lit(cells)).alias("cell"))
        .groupBy("cell").agg(F.min("shard").alias("shard"))
    )
    counts = docs.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.when(F.col("shard").isNotNull(), F.struct(F.col("cell").alias("arc"), "shard"))
    cell = (
        spark.range(cells, numPartitions=1).select(F.col("id").alias("cell"))
        .join(nodes, "cell", "left").join(counts, "cell", "left")
        .select("cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.last(own, True).over(ahead), F.first(own, True).over(first)).alias("to"))
        .select("cell", "n", "to.arc", "to.shard")
    )
    # A wrapped arc begins with the cells past the last virtual node.
    along = Window.partitionBy("arc").orderBy(F.col("cell") <= F.col("arc"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    return cell.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))


def _segments(ring: DataFrame, shards: int) -> DataFrame:
    """Where the rows of each arc go: those of rank lo <= rank < hi to a shard, from slot base on."""
    arcs = ring.groupBy("arc", "shard").agg(F.sum("n").alias("n"))
    everything = Window.partitionBy()
    shard = Window.partitionBy("shard")
    before = shard.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = F.sum("n").over(everything)
    arcs = (
        arcs.withColumn("room", F.floor(rows / shards) + F.when(F.col("shard") < rows % shards, 1).otherwise(0))
        .withColumn("own", F.greatest(F.lit(0), F.least(F.col("n"), F.col("room") - so_far("n", before))))
        .withColumn("over", F.col("n") - F.col("own"))
        .withColumn("left", F.col("room") - F.sum("own").over(shard))
        .withColumn("nodes", F.count(F.lit(1)).over(shard))
        .withColumn("nth", F.row_number().over(shard.orderBy("arc")) - 1)
        .withColumn("free", F.floor(F.col("left") / F.col("nodes")) + F.when(F.col("nth") < F.col("left") % F.col("nodes"), 1).otherwise(0))
        .withColumn("base", so_far("own", before))
        .withColumn("free_base", F.sum("own").over(shard) + so_far("free", before))
    )
    # Start behind the arc where the fewest rows wait: from there on every row on the move is met by room ahead of it.
    clockwise = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    waiting = arcs.withColumn("waiting", F.sum(F.col("over") - F.col("free")).over(clockwise))
    turned = waiting.withColumn("start", F.min_by("arc", F.struct("waiting", "arc")).over(everything))
    lap = Window.orderBy(F.col("arc") <= F.col("start"), "arc").rowsBetween(Window.unboundedPreceding, -1)
    steps = turned.withColumn("queued", so_far("over", lap)).withColumn("served", so_far("free", lap))
    own = steps.where("own > 0").select("arc", F.lit(0).cast("long").alias("lo"), F.col("own").alias("hi"), "shard", "base")
    # The rows on the move form a queue; the cuts of both its ends make pieces that go from one arc to one shard.
    put, got = F.struct("arc", "own", "queued"), F.struct("shard", "served", F.col("free_base").alias("base"))
    cut = F.explode(F.array(
        F.struct(F.col("queued").alias("at"), F.when(F.col("over") > 0, put).alias("put"), F.when(F.lit(False), got).alias("got")),
        F.struct(F.col("served").alias("at"), F.when(F.lit(False), put).alias("put"), F.when(F.col("free") > 0, got).alias("got")),
        F.struct((F.col("queued") + F.col("over")).alias("at"), F.when(F.lit(False), put).alias("put"), F.when(F.lit(False), got).alias("got")),
    ))
    cuts = steps.select(cut.alias("c")).select("c.*").groupBy("at").agg(F.first("put", True).alias("put"), F.first("got", True).alias("got"))
    w = Window.orderBy("at")
    pieces = cuts.select("at", F.lead("at").over(w).alias("to"), F.last("put", True).over(w).alias("put"), F.last("got", True).over(w).alias("got")).where("at < to")
    carried = pieces.select(
        F.col("put.arc").alias("arc"), (F.col("put.own") + F.col("at") - F.col("put.queued")).alias("lo"), (F.col("put.own") + F.col("to") - F.col("put.queued")).alias("hi"),
        F.col("got.shard").alias("shard"), (F.col("got.base") + F.col("at") - F.col("got.served")).alias("base"),
    )
    return own.unionByName(carried)


def ring_shards(docs: DataFrame, *, shards: int = 8, vnodes: int = 64, cells: int = 1 << 14) -> DataFrame:
    """Deal the rows of docs to shards 0 .. shards-1; row counts differ by one at most.

    Returns a row per input row: doc_id, size (UTF-8 bytes of text plus 1; a null text has none), text_crc32 (of the
    UTF-8 text; 0 for a null or empty one), law ('rows'), shard, slot (gapless from 0 in each shard) and grown_shard
    (null: under this law room depends on all rows).  Equal texts are not kept together.  Rows equal in doc_id and text share a ring position
    and are interchangeable; they are counted and ranked by the parts of the table, never all in one task.  Columns other than doc_id and text are ignored; an empty table gives no rows.

    The ring's tables have `cells` rows and 3 * shards * vnodes segments at most, whatever the input, so they are broadcast; raise cells with
    the number of rows (a cell's rows are ranked in one sort).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftright(F.monotonically_increasing_id(), 33).alias("part"), F.monotonically_increasing_id().alias("id"),
    )
    at = F.xxhash64(F.lit("row"), "doc_id", "text_crc32", "size")
    rows = written(rows.withColumn("at", at)).withColumn("cell", F.pmod("at", F.lit(cells)))
    ring = written(_ring(rows.select("cell"), shards, vnodes, cells))
    # A row's rank in its arc: the rows of the arc's cells before its own, those of its cell before its position and part, and those of the part before it.
    counts = rows.groupBy("cell", "at", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("cell").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(F.broadcast(ring.select("cell", "arc", "before")), "cell").select("at", "part", "arc", (F.col("before") + F.col("ahead")).alias("ahead"))
    placed = rows.withColumn("own", F.row_number().over(Window.partitionBy("at", "part").orderBy("id")) - 1).join(counts, ["at", "part"]).withColumn("rank", F.col("ahead") + F.col("own"))
    seg = F.broadcast(_segments(ring, shards).withColumnRenamed("arc", "on_arc"))
    return placed.join(seg, (F.col("arc") == F.col("on_arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
