"""Graphs as numbered rows of neighbours, for kernels that walk them: parts of a graph, numbers of its nodes, rows of ties and shortest paths.

Ties are (a, b) or (a, b, w) by name, once or from both ends; nodes get whole numbers in a stated order, so that a row of ties is an array of 32-bit numbers.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.functions.statistics import spread
from tallystream.sources.stages import Stages

#: Ties that one task puts in rows, about.
TASK = 1 << 20
#: Ties in a row of a table, so that a batch of rows stays small; the rows of a node lie together.
ROW = 1024
#: Ties that a kernel has in hand at once (a node with more is taken whole).
PIECE = 1 << 20
#: Ties times sources that are worth a task of their own.
UNIT = 1 << 33
#: Parts of up to this many nodes are packed with others, to packs of about twice as many.
SMALL = 512


def from_both_ends(ties: DataFrame, *more: str) -> DataFrame:
    end = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    return ties.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e"), *more).select("e.*", *more)


def named(ties: DataFrame, names: DataFrame, name: str, *more: str) -> DataFrame:
    """ties with both ends replaced by `name` of names (node, df, name)."""
    for end in "ab":
        left, right, on = spread(ties.select("a", "b", *more), names.select(F.col("node").alias(end), F.col(name).alias("to"), "df"), end)
        ties = left.join(right, on).drop(end).withColumnRenamed("to", end)
    return ties.select("a", "b", *more)


def parts(s: Stages, ties: DataFrame) -> DataFrame:
    """(node, part, df) of the nodes of ties (a, b), each tie once: the smallest node of the connected part, and the number of the node's ties.

    In a round every node points to its smallest neighbour if that is smaller, pointers are followed to their ends, and ties between different ends are the next round's.  Two rounds
    leave half of the ends at most.
    """
    found = None
    while True:
        near = from_both_ends(ties).groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("df"))
        tree = s.step(near.select(F.col("a").alias("node"), F.least("a", "low").alias("up"), "df"))
        while True:
            ends = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
            tree, last = s.step(tree.join(ends, "up").select("node", F.col("top").alias("up"), "df", (F.col("top") != F.col("up")).alias("moved"))), tree
            s.drop(last)
            if tree.where("moved").isEmpty():
                break
        if found is None:
            found = s.step(tree.select("node", F.col("up").alias("part"), "df"))
        else:
            found, last = s.step(found.join(tree.select(F.col("node").alias("part"), "up"), "part", "left").select("node", F.coalesce("up", "part").alias("part"), "df")), found
            s.drop(last)
        rest = named(ties, tree, "up").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        ties = s.step(rest)
        s.drop(tree)
        if ties.isEmpty():
            return found


def numbered(s: Stages, nodes: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """nodes with their place `id` in the given order, from 0, and how many there are; a number a task comes to the driver."""
    at = s.step(nodes.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33).cast("int")
    sizes = {r.task: r.n for r in at.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, n = [], 0
    for t in range(max(sizes, default=-1) + 1):
        starts.append(n)
        n += sizes.get(t, 0)
    if n >= 1 << 31:
        raise ValueError("a graph may have 2^31 nodes at most")
    first = F.get(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), task)
    return at.withColumn("id", first + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at"), n


def _in_rows(weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(x.num_rows for x in batches):
            return
        got = pa.Table.from_batches(batches)
        a, b, base = (got[c].to_numpy() for c in ("a", "b", "base"))
        order = np.argsort((a << 32) | b, kind="stable")
        a, b, base = a[order], b[order], base[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        w = np.add.reduceat(got["w"].to_numpy()[order], new) if weighted else None
        a, b, base = a[new], b[new], base[new]
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        lens = np.diff(np.append(starts, len(a)))
        cuts = np.flatnonzero((np.arange(len(a)) - np.repeat(starts, lens)) % ROW == 0)
        at = pa.array(np.append(cuts, len(a)).astype(np.int32))
        out = {
            "base": pa.array(base[cuts]), "a": pa.array((a - base)[cuts].astype(np.int32)), "ties": pa.array(np.repeat(lens, lens)[cuts].astype(np.int32)),
            "nb": pa.ListArray.from_arrays(at, pa.array((b - base).astype(np.int32))),
        }
        if weighted:
            out["w"] = pa.ListArray.from_arrays(at, pa.array(w))
        yield pa.RecordBatch.from_pydict(out)

    return run


def rows_of_ties(s: Stages, ties: DataFrame, count: int, weighted: bool = False) -> DataFrame:
    """(base, a, ties, nb[, w]) from ties (base, a, b[, w]) by number, from both their ends: neighbours of a, less base as a is, and their weights; repeated ties are one, with their weights' sum.

    A node has a row for each ROW of its `ties`; these lie together and in order in one file, as a file has one group of rows.
    """
    tasks = max(s.spark.sparkContext.defaultParallelism, -(-count // TASK))
    cols = ["base", "a", "b"] + ["w"] * weighted
    kept = ties.select(*[F.col(c).cast("double" if c == "w" else "long").alias(c) for c in cols]).repartition(tasks, "a")
    return s.step(kept.mapInArrow(_in_rows(weighted), "base long, a int, ties int, nb array<int>" + ", w array<double>" * weighted))


def whole_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From weighted rows of ties: nodes, their numbers of ties, and neighbours and weights one after another, for whole nodes of about PIECE ties together."""
    held = None
    for batch in batches:
        nb, w = batch.column("nb"), batch.column("w")
        now = (batch.column("a").to_numpy(), batch.column("ties").to_numpy(), np.diff(nb.offsets.to_numpy()), nb.flatten().to_numpy(), w.flatten().to_numpy())
        a, ties, lens, nb, w = now if held is None else (np.concatenate(x) for x in zip(held, now, strict=True))
        if not len(a):
            continue
        rows = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        have, ends = np.add.reduceat(lens, rows), np.cumsum(lens)
        open_ = have[-1] < ties[-1]
        nodes = len(rows) - int(open_)
        if (have[:nodes] != ties[rows[:nodes]]).any():
            raise ValueError("the rows of a node lie apart")
        cut, at = rows[-1] if open_ else len(a), ends[rows[-1] - 1] if open_ and rows[-1] else 0 if open_ else len(nb)
        held = (a[cut:], ties[cut:], lens[cut:], nb[at:], w[at:]) if open_ else None
        stops, i = np.concatenate(([0], np.cumsum(have[:nodes]))), 0
        while i < nodes:
            j = max(i + 1, int(np.searchsorted(stops, stops[i] + PIECE, "right")) - 1)
            yield a[rows[i:j]], have[i:j], nb[stops[i] : stops[j]], w[stops[i] : stops[j]]
            i = j
    if held is not None:
        raise ValueError("the rows of a node lie apart")


class Walk:
    """Shortest paths over one pack of parts: ptr, nbr as in a sparse matrix.  Memory is a few numbers a node and PIECE ties; nbr is a file.

    A level is found from the one before or from the nodes not yet reached, whichever have fewer ties, as is the way back; so a source costs far less than a pass over all ties where levels are few.
    """

    def __init__(self, ptr: np.ndarray, nbr: np.ndarray) -> None:
        self.n, self.ptr, self.nbr, self.deg = len(ptr) - 1, ptr, nbr, np.diff(ptr)
        self.dist, self.paths, self.piece = np.empty(self.n, np.int32), np.empty(self.n), max(PIECE, self.n)

    def pieces(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """rows in pieces: their nodes, numbers of ties and neighbours one after another."""
        lens = self.deg[rows]
        ends, at = np.cumsum(lens), 0
        while at < len(rows):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + self.piece, "right")))
            r, k = rows[at:to], lens[at:to]
            total = int(ends[to - 1] - before)
            if total >= 16 * len(r):
                x = np.concatenate([self.nbr[i:j] for i, j in zip(self.ptr[r].tolist(), self.ptr[r + 1].tolist(), strict=True)], dtype=np.intp)
            else:
                x = self.nbr[np.arange(total) + np.repeat(self.ptr[r] - (ends[at:to] - k - before), k)].astype(np.intp)
            yield r, k, x
            at = to

    def push(self, pieces, value: np.ndarray | None) -> np.ndarray:
        """For every node the sum of value over those of its neighbours that are in pieces (their number without value)."""
        got = None
        for r, k, x in pieces:
            part = np.bincount(x, None if value is None else np.repeat(value[r], k), self.n)
            got = part if got is None else got + part
        return got

    def pull(self, pieces, value: np.ndarray) -> np.ndarray:
        """For the nodes in pieces the sum of value over their neighbours."""
        return np.concatenate([np.add.reduceat(value[x], np.cumsum(k) - k) for _, k, x in pieces])

    def shares(self, source: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes, and the share that each has in the shortest paths from source to all others, ends not counted (Brandes' dependencies)."""
        dist, paths = self.dist, self.paths
        dist.fill(-1)
        dist[source], paths[source] = 0, 1.0
        levels, reached, open_ = [np.array([source])], 1, int(self.ptr[-1] - self.deg[source])
        kept, most = (0, None), 0
        while reached < self.n:
            last, d = levels[-1], len(levels)
            ties = int(self.deg[last].sum())
            if ties <= open_:
                pieces = self.pieces(last)
                if most < ties <= 8 * PIECE:  # the way back takes them again
                    pieces = list(pieces)
                    kept, most = (d - 1, pieces), ties
                got = self.push(pieces, None if d <= 2 else paths)
                got[dist >= 0] = 0
                new = np.flatnonzero(got)
                found = got[new]
            else:
                now, left = np.zeros(self.n), np.flatnonzero(dist < 0)
                now[last] = paths[last]
                found = self.pull(self.pieces(left), now)
                new, found = left[found > 0], found[found > 0]
            if not len(new):
                break
            dist[new], paths[new] = d, found
            reached += len(new)
            open_ -= int(self.deg[new].sum())
            levels.append(new)
        share = np.zeros(self.n)
        for d in range(len(levels) - 1, 1, -1):
            far, near = levels[d], levels[d - 1]
            gives = np.zeros(self.n)
            gives[far] = (1 + share[far]) / paths[far]
            if kept[0] == d - 1:
                share[near] = paths[near] * self.pull(kept[1], gives)
            elif self.deg[far].sum() < self.deg[near].sum():
                share[near] = paths[near] * self.push(self.pieces(far), gives)[near]
            else:
                share[near] = paths[near] * self.pull(self.pieces(near), gives)
        inner = np.concatenate(levels[1:-1]) if len(levels) > 2 else np.empty(0, np.intp)
        return inner, share[inner]


class _Pack:
    """The ties of one pack as they come; neighbours go to a file without a name."""

    def __init__(self, n: int) -> None:
        self.deg, self.kind, self.file = np.zeros(n, np.int64), np.uint16 if n <= 1 << 16 else np.int32, tempfile.TemporaryFile()

    def add(self, rows: pa.RecordBatch) -> None:
        nb = rows.column("nb")
        np.add.at(self.deg, rows.column("a").to_numpy(), np.diff(nb.offsets.to_numpy()))
        self.file.write(nb.flatten().to_numpy().astype(self.kind).tobytes())

    def walk(self) -> Walk:
        self.file.flush()
        held = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.file.close()
        return Walk(np.concatenate(([0], np.cumsum(self.deg))), np.frombuffer(held, self.kind))


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, Walk]]:
    """(base, unit, units, walk) of each pack in batches ordered by base, unit, a."""
    now, pack = None, None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("base", "unit", "units", "n")])
        cuts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if now != (key := tuple(keys[:, i].tolist())):
                if pack:
                    yield *now[:3], pack.walk()
                now, pack = key, _Pack(key[3])
            pack.add(batch.slice(i, j - i))
    if pack:
        yield *now[:3], pack.walk()


def _walked(only: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, unit, units, walk in _packs(batches):
            sources = np.arange(unit, walk.n, units)
            if only is not None:
                sources = np.intersect1d(sources, only - base)
            total = np.zeros(walk.n)
            for source in sources.tolist():
                nodes, share = walk.shares(source)
                total[nodes] += share
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"id": pa.array(some + base), "share": pa.array(total[some])})

    return run


def shortest_path_shares(s: Stages, ties: DataFrame, pivots: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, df, share): the share of each node in the shortest paths between others, summed over sources (each path from both its ends), and its number of ties.

    ties (a, b) has each tie once.  Sources are all nodes, or those that `pivots` leaves of a table with their names as node, which come to the driver as numbers.  A connected part and a
    share of its sources go to one task; small parts are packed, large ones dealt over the cores, each of which then holds the part's ties in a file.
    """
    spark = s.spark
    of = parts(s, ties)
    sizes = of.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    small = F.col("size") <= SMALL
    packs = F.broadcast(sizes.agg(F.ceil(F.sum(F.when(small, F.col("size"))) / (2 * SMALL)).alias("packs")))  # one row
    keyed = of.join(sizes, "part").crossJoin(packs).select("node", "df", F.when(small, F.pmod(F.xxhash64("part"), F.col("packs"))).otherwise(-1).alias("pack"), F.when(~small, F.col("part")).alias("part"))
    nodes, n = numbered(s, keyed, "pack", "part", "node")
    if not n:
        return nodes.select("node", "df", F.lit(0.0).alias("share"))
    nodes = s.step(nodes)
    only = None
    if pivots is not None:
        only = np.array(sorted(r.id for r in nodes.join(pivots(nodes.select("node")), "node").select("id").collect()))
    cores = spark.sparkContext.defaultParallelism
    chosen = F.lit(1) if only is None else F.col("id").isin(only.tolist()).cast("int")
    heads = nodes.groupBy("pack", "part").agg(F.min("id").alias("base"), F.count(F.lit(1)).cast("int").alias("n"), (F.sum("df") * F.sum(chosen)).alias("work"))
    units = F.least(F.lit(cores), F.ceil(F.col("work") / UNIT)).cast("int")
    heads = s.step(heads.withColumn("units", units))
    mine = s.step(nodes.join(heads, (nodes.pack == heads.pack) & nodes.part.eqNullSafe(heads.part)).select("node", "df", "id", "base"))
    by_number = from_both_ends(named(ties, mine, "id")).join(mine.select(F.col("id").alias("a"), "base"), "a").select("base", "a", "b")
    rows = rows_of_ties(s, by_number, 2 * ties.count())
    rows = rows.join(heads.where("units > 0").select("base", "n", "units"), "base").withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1)))
    tasks = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("base", "unit", "units", "n", "a", "nb").repartitionById(tasks, F.pmod(F.xxhash64("base") + F.col("unit"), F.lit(tasks)).cast("int")).sortWithinPartitions("base", "unit", "a")
    got = s.step(dealt.mapInArrow(_walked(only), "id long, share double"))
    return mine.join(got.groupBy("id").agg(F.sum("share").alias("share")), "id", "left").select("node", "df", F.coalesce("share", F.lit(0.0)).alias("share"))
