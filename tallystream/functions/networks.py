"""Communities and connectors of interaction graphs.

Edges are (a_ref, b_ref, weight), undirected; loops are left out, repeated edges add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.functions.adjacency import from_both_ends, named, numbered, rows_of_ties, shortest_path_shares, whole_nodes
from tallystream.functions.statistics import spread
from tallystream.sources.stages import Stages


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, w): each tie from both its ends, repeated ties summed, loops left out."""
    e = edges.where("a_ref <> b_ref").select(F.least("a_ref", "b_ref").alias("a"), F.greatest("a_ref", "b_ref").alias("b"), F.col("weight").cast("double").alias("w"))
    e = e.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def _moves(ties: DataFrame, labels: DataFrame, whole: float, resolution: float) -> DataFrame:
    """(node, own, c, gain, k): for each node that would gain by it the best community among its neighbours'."""
    totals = labels.groupBy("c").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("size"))
    left, right, on = spread(ties.where("a <> b"), labels.select(F.col("node").alias("b"), "c", "df"), "b")
    links = left.join(right, on).groupBy(F.col("a").alias("node"), "c").agg(F.sum("w").alias("w"))
    own = labels.select("node", "k", F.col("c").alias("own")).join(totals.select(F.col("c").alias("own"), F.col("total").alias("own_total"), F.col("size").alias("own_size")), "own")
    seen = links.join(totals, "c").join(own, "node").withColumn("stays", F.col("c") == F.col("own"))
    # Two nodes on their own would swap places for ever: they go to the smaller name only.
    free = ~F.col("stays") & ~((F.col("size") == 1) & (F.col("own_size") == 1) & (F.col("c") > F.col("own")))
    # Compared to 15 digits, as the order of a sum must not decide; of equally good communities the smaller name.
    pull = F.round((F.col("w") - resolution * F.col("total") * F.col("k") / whole) / whole, 15)
    best = seen.groupBy("node", "own", "own_total", "k").agg(F.min(F.when(free, F.struct((-pull).alias("push"), "c"))).alias("best"), F.sum(F.when(F.col("stays"), F.col("w"))).alias("w_own"))
    stay = (F.coalesce("w_own", F.lit(0.0)) - resolution * (F.col("own_total") - F.col("k")) * F.col("k") / whole) / whole
    return best.withColumn("gain", 2 * (-F.col("best.push") - stay)).where(F.col("gain") > 1e-12).select("node", "own", F.col("best.c").alias("c"), "gain", "k")


def _chosen(moves: DataFrame, whole: float, resolution: float, sweep: int) -> DataFrame:
    """Moves (node, c) that may be made at once, such that modularity rises.

    A community gives or takes in a sweep, as its best move says.  Moves that share a community disturb each other by no more than 2 * resolution * k1 * k2 / whole^2 (a tie between
    the movers only helps), so each goes whose gain covers that for all that share with it, and the best of both its communities in any case.  Where too many want to, a share of them drawn by hash is left to try.
    """
    side = lambda c, role: F.struct(F.col(c).alias("side"), F.lit(role).alias("role"))
    each = moves.select("node", "gain", "k", F.explode(F.array(side("own", "gives"), side("c", "takes"))).alias("s")).select("node", "gain", "k", "s.*")
    sides = each.groupBy("side").agg(
        F.min(F.struct(F.round(-F.col("gain"), 15).alias("push"), "node", "role")).alias("best"), F.sum(F.when(F.col("role") == "gives", F.col("k"))).alias("gives"), F.sum(F.when(F.col("role") == "takes", F.col("k"))).alias("takes")
    )
    gives = sides.where("best.role = 'gives'").select(F.col("side").alias("own"), F.col("best.node").alias("own_best"), "gives")
    takes = sides.where("best.role = 'takes'").select(F.col("side").alias("c"), F.col("best.node").alias("c_best"), "takes")
    fair = moves.join(gives, "own").join(takes, "c").withColumn("top", (F.col("own_best") == F.col("node")) & (F.col("c_best") == F.col("node")))
    covers = F.col("gain") * whole**2 / (2 * resolution * F.col("k") * (F.col("gives") + F.col("takes")))
    drawn = F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(1 << 20)) / float(1 << 20)
    tried = fair.where(F.col("top") | (covers >= 1) | (drawn < covers / 2)).select("node", "own", "c", "gain", "k", "top")
    load = tried.select("k", F.explode(F.array("own", "c")).alias("side")).groupBy("side").agg(F.sum("k").alias("load"))
    here, there = load.select(F.col("side").alias("own"), F.col("load").alias("here")), load.select(F.col("side").alias("c"), F.col("load").alias("there"))
    return tried.join(here, "own").join(there, "c").where(F.col("top") | (F.col("gain") * whole**2 >= 2 * resolution * F.col("k") * (F.col("here") + F.col("there")))).select("node", "c")


def _settled(s: Stages, ties: DataFrame, labels: DataFrame, whole: float, resolution: float, sweeps: int) -> tuple[DataFrame, bool]:
    """labels after sweeps of moves until none gains, and whether any was made; labels is dropped if so."""
    for sweep in range(sweeps):
        moves = s.step(_moves(ties, labels, whole, resolution))
        if moves.isEmpty():
            s.drop(moves)
            return labels, sweep > 0
        to = _chosen(moves, whole, resolution, sweep).withColumnRenamed("c", "to")
        moved = s.step(labels.join(to, "node", "left").select("node", "k", "df", F.coalesce("to", "c").alias("c")))
        s.drop(moves, labels)
        labels = moved
    return labels, True


def _start(ties: DataFrame) -> DataFrame:
    return ties.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"), F.count(F.lit(1)).alias("df"))


def _joined_communities(s: Stages, edges: DataFrame, resolution: float, sweeps: int, levels: int) -> DataFrame:
    """The rounds of `communities` as joins and aggregates."""
    ties = first = s.step(both_ways(edges))
    whole = ties.agg(F.sum("w")).first()[0]
    members = s.step(ties.select(F.col("a").alias("member_ref")).distinct().withColumn("community", F.col("member_ref")))
    for _ in range(levels):
        labels, gained = _settled(s, ties, s.step(_start(ties).withColumn("c", F.col("node"))), whole, resolution, sweeps)
        if not gained:
            break
        names = labels.groupBy("c").agg(F.min("node").alias("to"))
        named = s.step(labels.select("node", "c", "df").join(names, "c").select("node", "to", "df"))
        left, right, on = spread(ties, named.select(F.col("node").alias("a"), F.col("to").alias("ta"), "df"), "a")
        half = left.join(right, on).select("ta", "b", "w")
        left, right, on = spread(half, named.select(F.col("node").alias("b"), F.col("to").alias("tb"), "df"), "b")
        before, ties = ties, s.step(left.join(right, on).groupBy(F.col("ta").alias("a"), F.col("tb").alias("b")).agg(F.sum("w").alias("w")))
        old, members = members, s.step(members.join(named.select(F.col("node").alias("community"), "to"), "community").select("member_ref", F.col("to").alias("community")))
        s.drop(old, named, labels, *([] if before is first else [before]))
    labels = s.step(_start(first).join(members.select(F.col("member_ref").alias("node"), F.col("community").alias("c")), "node"))
    labels, _ = _settled(s, first, labels, whole, resolution, sweeps)
    names = labels.groupBy("c").agg(F.min("node").alias("community"))
    return labels.join(names, "c").select(F.col("node").alias("member_ref"), "community")


#: Nodes whose labels the driver and every task hold; in larger graphs sweeps are joins.
HELD = 1 << 21


def _drawn(hashes: np.ndarray, sweep: int) -> np.ndarray:
    """Spark's pmod(xxhash64(node, sweep), 2^20) / 2^20 from xxhash64(node)."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    x = hashes.view(np.uint64) + five + np.uint64(4)
    x ^= np.array([sweep], np.uint64) * one
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * two + three
    x = (x ^ (x >> np.uint64(33))) * two
    x = (x ^ (x >> np.uint64(29))) * three
    x ^= x >> np.uint64(32)
    return (x & np.uint64((1 << 20) - 1)) / float(1 << 20)


def _sums(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their w."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.add.reduceat(w[order], at)


def _strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, lens, _, w in whole_nodes(batches):
        yield pa.RecordBatch.from_pydict({"node": pa.array(a), "k": pa.array(np.add.reduceat(w, np.cumsum(lens) - lens))})


def _best_moves(state: Broadcast, whole: float, resolution: float):
    """What `_moves` finds, from rows of ties."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, k, total, size = state.value
        for a, lens, nb, w in whole_nodes(batches):
            row = np.repeat(np.arange(len(a)), lens)
            other = nb != a[row]
            if not other.any():
                continue
            key, links = _sums(row[other] * len(c) + c[nb[other]], w[other])
            row, to = np.divmod(key, len(c))
            own, kk = c[a[row]], k[a[row]]
            stays = to == own
            free = ~stays & ~((size[to] == 1) & (size[own] == 1) & (to > own))
            pull = np.where(free, np.round((links - resolution * total[to] * kk / whole) / whole, 15), -np.inf)
            w_own = np.zeros(len(a))
            w_own[row[stays]] = links[stays]
            at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            best = np.flatnonzero(free & (pull == np.repeat(np.maximum.reduceat(pull, at), np.diff(np.append(at, len(row))))))
            best = best[np.concatenate(([True], row[best][1:] != row[best][:-1]))[: len(best)]]  # of equally good ones the smaller name
            own, kk = own[best], kk[best]
            gain = 2 * (pull[best] - (w_own[row[best]] - resolution * (total[own] - kk) * kk / whole) / whole)
            good = gain > 1e-12
            yield pa.RecordBatch.from_pydict({"node": pa.array(a[row[best]][good]), "c": pa.array(to[best][good]), "gain": pa.array(gain[good])})

    return run


def _made(node: np.ndarray, own: np.ndarray, to: np.ndarray, gain: np.ndarray, k: np.ndarray, drawn: np.ndarray, n: int, whole: float, resolution: float) -> np.ndarray:
    """Which of the moves `_chosen` chooses."""
    side, push = np.concatenate((own, to)), np.tile(np.round(-gain, 15), 2)
    order = np.lexsort((np.tile(node, 2), push, side))
    first = order[np.concatenate(([True], side[order][1:] != side[order][:-1]))]
    best, gives = np.full(n, -1), np.zeros(n, bool)
    best[side[first]], gives[side[first]] = np.tile(node, 2)[first], first < len(node)
    fair = gives[own] & ~gives[to]
    top = fair & (best[own] == node) & (best[to] == node)
    covers = gain * whole**2 / (2 * resolution * k * (np.bincount(own, k, n)[own] + np.bincount(to, k, n)[to]))
    tried = fair & (top | (covers >= 1) | (drawn < covers / 2))
    load = np.bincount(own[tried], k[tried], n) + np.bincount(to[tried], k[tried], n)
    return tried & (top | (gain * whole**2 >= 2 * resolution * k * (load[own] + load[to])))


def _contracted(state: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = state.value
        for a, lens, nb, w in whole_nodes(batches):
            key, w = _sums(to[np.repeat(a, lens)] * len(to) + to[nb], w)
            a, b = np.divmod(key, len(to))
            yield pa.RecordBatch.from_pydict({"base": pa.array(np.zeros(len(a), np.int64)), "a": pa.array(a), "b": pa.array(b), "w": pa.array(w)})

    return run


def _labelled(state: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "to": pa.array(state.value[batch.column("id").to_numpy()])})

    return run


def _held_communities(s: Stages, nodes: DataFrame, n: int, first: DataFrame, resolution: float, sweeps: int, levels: int) -> DataFrame:
    """The rounds of `communities` over numbered nodes (node, id, h) and rows of ties: the driver holds a few numbers a node, tasks find the moves of the nodes in their rows without a shuffle."""
    context = s.spark.sparkContext

    def with_state(state, frame):
        held = context.broadcast(state)
        try:
            return frame(held)
        finally:
            held.destroy()

    hashes, k_first = np.empty(n, np.int64), np.empty(n)
    names = nodes.select("id", F.xxhash64("node").alias("h")).toArrow()
    hashes[names["id"].to_numpy()] = names["h"].to_numpy()
    strengths = first.mapInArrow(_strengths, "node int, k double").toArrow()
    k_first[strengths["node"].to_numpy()] = strengths["k"].to_numpy()
    whole = float(k_first.sum())

    def settled(rows: DataFrame, active: np.ndarray, c: np.ndarray, k: np.ndarray) -> bool:
        for sweep in range(sweeps):
            state = (c, k, np.bincount(c[active], k[active], n), np.bincount(c[active], minlength=n))
            m = with_state(state, lambda held: rows.mapInArrow(_best_moves(held, whole, resolution), "node int, c long, gain double").toArrow())
            if not m.num_rows:
                return sweep > 0
            node, to, gain = (m[x].to_numpy() for x in ("node", "c", "gain"))
            made = _made(node, c[node], to, gain, k[node], _drawn(hashes[node], sweep), n, whole, resolution)
            c[node[made]] = to[made]
        return True

    every = np.arange(n)
    rows, active, k, members = first, every, k_first, every.copy()
    for _ in range(levels):
        c = every.copy()
        if not settled(rows, active, c, k):
            break
        least, to = np.full(n, n), every.copy()
        np.minimum.at(least, c[active], active)
        to[active] = least[c[active]]
        members, k, active = to[members], np.bincount(to[active], k[active], n), np.unique(to[active])
        ties = with_state(to, lambda held, rows=rows: s.step(rows.mapInArrow(_contracted(held), "base long, a long, b long, w double")))
        rows, before = rows_of_ties(s, ties, ties.count(), weighted=True), rows
        s.drop(ties, *([] if before is first else [before]))
    settled(first, every, members, k_first)
    least = np.full(n, n)
    np.minimum.at(least, members, every)
    found = with_state(least[members], lambda held: s.step(nodes.select("id").mapInArrow(_labelled(held), "id long, to long")))
    return found.join(nodes.select("id", F.col("node").alias("member_ref")), "id").join(nodes.select(F.col("id").alias("to"), F.col("node").alias("community")), "to").select("member_ref", "community")


def communities(edges: DataFrame, *, resolution: float = 1.0, sweeps: int = 60, levels: int = 12, held: int = HELD) -> DataFrame:
    """Louvain communities: (member_ref, community), community being its smallest member.

    Every node begins on its own.  In a sweep each node looks for the neighbouring community that raises modularity most, and all moves are made that together raise it for sure.  When
    no node gains, communities become nodes and the sweeps begin again, until a level changes nothing; then single members may still move by themselves.  sweeps (of a level) and levels
    bound the rounds.  Ties without weight or ends are ignored; nodes without ties do not occur in an edge table; no edges give no rows.

    Up to `held` nodes their labels are held by the driver and the tasks, and a sweep is one pass over rows of ties; with more, it is joins and aggregates, and nothing but counts comes to the driver.
    """
    s = Stages(edges.sparkSession)
    ties = s.step(edges.where("a_ref <> b_ref and weight > 0").select(F.col("a_ref").alias("a"), F.col("b_ref").alias("b"), F.col("weight").cast("double").alias("w")))
    nodes, n = numbered(s, from_both_ends(ties).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("df")), "node")
    if not n:
        return ties.select(F.col("a").alias("member_ref"), F.col("b").alias("community"))
    if n > held:
        out = _joined_communities(s, ties.select(F.col("a").alias("a_ref"), F.col("b").alias("b_ref"), F.col("w").alias("weight")), resolution, sweeps, levels)
    else:
        nodes = s.step(nodes)
        by_number = from_both_ends(named(ties, nodes, "id", "w"), "w").withColumn("base", F.lit(0))
        out = _held_communities(s, nodes, n, rows_of_ties(s, by_number, 2 * ties.count(), weighted=True), resolution, sweeps, levels)
    out = s.step(out)
    s.close(out)
    return out


def degree_null(edges: DataFrame, seed: int, edges_a_block: int = 1 << 14) -> DataFrame:
    """Edges between the same ends in another match, so that every node keeps its number of ties: what communities found by chance look like.

    Ties lose their weight (1 each) as in any comparison by degree.  Ends are matched anew within blocks of about edges_a_block ties, chosen by hash; ends that meet themselves are dropped with the loops.
    """
    e = edges.where("a_ref <> b_ref").select("a_ref", "b_ref").distinct()
    blocks = max(1, -(-e.count() // edges_a_block))
    at = lambda name: F.xxhash64(F.lit(seed), F.lit(name), "a_ref", "b_ref")
    flip = F.pmod(at("side"), F.lit(2)) == 0  # an undirected tie has no first end
    dealt = e.select(F.pmod(at("block"), F.lit(blocks)).alias("block"), F.when(flip, F.col("a_ref")).otherwise(F.col("b_ref")).alias("one"), F.when(flip, F.col("b_ref")).otherwise(F.col("a_ref")).alias("two"), at("first").alias("h1"), at("second").alias("h2"))
    place = lambda h: F.row_number().over(Window.partitionBy("block").orderBy(h, "one", "two"))
    one, two = dealt.select("block", F.col("one").alias("a_ref"), place("h1").alias("n")), dealt.select("block", F.col("two").alias("b_ref"), place("h2").alias("n"))
    return one.join(two, ["block", "n"]).where("a_ref <> b_ref").select("a_ref", "b_ref", F.lit(1.0).alias("weight"))


def betweenness(edges: DataFrame, *, pivots: int | None = None, normalised: bool = True) -> DataFrame:
    """(member_ref, betweenness, degree): shortest paths through each node, from all sources.

    Paths count ties, not weights.  Connected parts are walked by kernels that hold a part's ties in a file (`adjacency.Walk`), dealt by sources; the work is that of a breadth-first search
    a source, so it grows with the square of a part's nodes, memory with the nodes.  With `pivots` that many nodes, chosen by a hash of their name, are sources, and sums are scaled by
    nodes / pivots: an estimate whose standard error falls with the root of pivots.  normalised divides by (n - 1)(n - 2) / 2 pairs, so that the centre of a star has 1.  No edges give no rows.
    """
    s = Stages(edges.sparkSession)
    ties = s.step(edges.where("a_ref <> b_ref").select(F.least("a_ref", "b_ref").alias("a"), F.greatest("a_ref", "b_ref").alias("b")).distinct())
    some = None if pivots is None else lambda nodes: nodes.orderBy(F.xxhash64("node"), "node").limit(pivots)
    shares = s.step(shortest_path_shares(s, ties, some))
    n = shares.count()
    scale = n / max(1, min(pivots, n)) if pivots is not None else 1.0
    pairs = (n - 1) * (n - 2) / 2 if normalised and n > 2 else 1.0
    out = s.step(shares.select(F.col("node").alias("member_ref"), (F.col("share") * scale / 2 / pairs).alias("betweenness"), F.col("df").alias("degree")))
    s.close(out)
    return out
