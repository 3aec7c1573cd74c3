"""Approximate nearest neighbours: a forest of random-projection trees searched through a shared priority queue.

The trees are fitted on a bounded sample of vectors: each node projects its vectors on the line between two random ones
(moved towards the means of their sides) and splits at the median.  Every distinct vector is routed to one leaf of each tree.  A
query descends all trees with one priority queue, ordered by the sum of the squared margins it would have to cross,
and takes leaves in that order until its budget of leaves is used.  Queries meet the vectors of their leaves in tasks keyed by leaf and
salt; a task keeps a query's best that reach the k-th best of the sample's vectors in these leaves, and the union of these is ranked exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallystream.llm.tables import written

#: Vectors that the forest is fitted on at most, trees, and vectors of the sample in a leaf at most.
SAMPLE, TREES, LEAF = 16_384, 8, 48
#: Share of all leaves of one tree's size that a query takes from the shared queue.  The test vectors have hardly any structure: a
#: recall of 0.9 needs about two fifths of the table.  Lower it for clustered vectors.
BUDGET = 0.7
#: Vectors of one leaf that meet its queries in one task (salts follow from the table's size).
BLOCK = 4096
#: Relative error of an inner product, per component, between two orders of summation; salts of the queries with one vector.
EXACT, SALTS = 4e-16, 16


class Forest:
    """Trees as arrays: normal and offset of each inner node; children, negative for leaves."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> None:
        self.normal, self.offset, self.child, self.root = [], [], [], []
        self.leaves, self.sample = 0, sample
        rng = np.random.Generator(np.random.PCG64(seed))
        for _ in range(trees):
            self.root.append(self._grow(sample, np.arange(len(sample)), leaf, rng, 0))
        d = sample.shape[1] if sample.ndim == 2 else 0
        self.normal = np.array(self.normal, np.float64).reshape(-1, d)
        self.offset = np.array(self.offset)
        self.child = np.array(self.child, np.int64).reshape(-1, 2)
        # The sample's vectors in each leaf, leaf after leaf.
        leaf_of = self.route(sample) if len(sample) else np.zeros((0, trees), np.int64)
        order = np.argsort(leaf_of.ravel(), kind="stable")
        self.member = order // max(1, trees)
        self.start = np.searchsorted(leaf_of.ravel()[order], np.arange(self.leaves + 2))

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf: int, rng, depth: int) -> int:
        for _ in range(4 if len(at) > leaf and depth < 40 else 0):
            some = x[at if len(at) <= 256 else rng.choice(at, 256, replace=False)]
            a, b = some[rng.choice(len(some), 2, replace=False)]
            for _ in range(3):
                near_a = ((some - a) ** 2).sum(axis=1) < ((some - b) ** 2).sum(axis=1)
                if 0 < near_a.sum() < len(some):
                    a, b = some[near_a].mean(axis=0), some[~near_a].mean(axis=0)
            normal = (a - b) / max(np.linalg.norm(a - b), 1e-300)
            side = x[at] @ normal
            offset = float(np.median(side))
            left = side <= offset
            if 0 < left.sum() < len(at):
                node = len(self.normal)
                self.normal.append(normal)
                self.offset.append(offset)
                self.child.append([0, 0])
                self.child[node] = [self._grow(x, at[left], leaf, rng, depth + 1), self._grow(x, at[~left], leaf, rng, depth + 1)]
                return node
        self.leaves += 1
        return -self.leaves

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree (rows x trees)."""
        out = np.empty((len(x), len(self.root)), np.int64)
        for t, root in enumerate(self.root):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = np.einsum("ij,ij->i", x[inner], self.normal[node]) > self.offset[node]
                at[inner] = self.child[node, right.astype(int)]
            out[:, t] = -at
        return out

    def search(self, q: np.ndarray, budget: int) -> list[int]:
        """The leaves of one query in the order of the shared queue."""
        margin = self.normal @ q - self.offset if len(self.normal) else np.zeros(0)
        heap = [(0.0, i, r) for i, r in enumerate(self.root)]
        heapq.heapify(heap)
        out, serial = [], len(heap)
        while heap and len(out) < budget:
            worst, _, node = heapq.heappop(heap)
            while node >= 0:
                m = margin[node]
                near, far = (1, 0) if m > 0 else (0, 1)
                serial += 1
                heapq.heappush(heap, (worst + m * m, serial, int(self.child[node, far])))
                node = int(self.child[node, near])
            out.append(-node)
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _packed(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _routed(forest, budget: float, k: int):
    """Where vectors lie (budget 0) or which leaves a query takes, and what a candidate must reach: the k-th best of the sample's vectors in these leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        most = max(1, round(budget * f.leaves / max(1, len(f.root)))) + len(f.root)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            least = np.full(len(x), -np.inf)
            if budget:
                leaves = [f.search(v, most) for v in x]
                for i, taken in enumerate(leaves):
                    met = np.zeros(len(f.sample), bool)
                    for leaf in taken:
                        met[f.member[f.start[leaf] : f.start[leaf + 1]]] = True
                    if met.sum() >= k:
                        near = f.sample[met] @ x[i]
                        slack = EXACT * x.shape[1] * np.linalg.norm(x[i]) * np.sqrt((f.sample[met] ** 2).sum(axis=1).max())
                        least[i] = np.partition(near, -k)[-k] - slack
            else:
                leaves = f.route(x).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(least), pa.array(leaves, pa.list_(pa.int64()))], names=["vec_id", "v", "least", "leaves"]
            )

    return run


def _leaf_best(k: int):
    def run(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        query, cand, score, slack = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        if len(q) and len(x):
            b, ids, least = _packed(x.v), x.vec_id.to_numpy(), q.least.to_numpy()
            names = q.vec_id.to_numpy()
            a = _packed(q.v)
            size = EXACT * b.shape[1] * np.linalg.norm(b, axis=1)
            for i in range(0, len(a), 256):
                near = a[i : i + 256] @ b.T
                tol = np.linalg.norm(a[i : i + 256], axis=1)[:, None] * size
                enough = near + tol >= least[i : i + 256, None]
                if near.shape[1] > k:  # what may be among the k best, whatever the order of summation
                    enough &= near + tol >= np.partition(near - tol, -k, axis=1)[:, -k][:, None]
                r, c = np.nonzero(enough)
                query.append(names[i : i + 256][r])
                cand.append(ids[c])
                score.append(near[r, c])
                slack.append(tol[r, c])
        return pd.DataFrame({"query": np.concatenate(query), "cand": np.concatenate(cand), "near": np.concatenate(score), "tol": np.concatenate(slack)})

    return run


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, sample: int = SAMPLE, trees: int = TREES, budget: float = BUDGET) -> DataFrame:
    """For each row whose vec_id is divisible by `every` its k nearest other rows by inner product.

    Returns query_id, rank (from 1), vec_id, score (the inner product of the original vectors, summed in double precision from the first
    component to the last); nearest first, ties to the smaller vec_id; fewer rows only if fewer candidates are found.  Vectors that are null, zero,
    or hold null or non-finite components, and rows without vec_id, take no part.  Inner products need one length: the commonest (of equally common ones the
    longest) is searched, vectors of other lengths take no part either.  Of rows that share a vec_id one takes part, the one whose vector comes last in order.
    Equal vectors form a class that is indexed and searched once; a class offers its k + 1 smallest ids, no more can be among
    the nearest.  budget is the number of leaves a query takes, as a share of one tree's leaves.  An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda c: c.cast("double"))
    fine = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    )
    rows = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = written(rows)
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == lengths.n).groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("h", F.xxhash64("v"))
    rows = written(rows)
    # Classes of equal vectors: one row each, with the smallest ids, chosen in two salted steps.
    salted = Window.partitionBy("h", "v", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    classes = written(
        few.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids")).select(F.col("ids")[0].alias("vec_id"), "ids", "v", "h")
    )
    share = min(1.0, sample / max(1, lengths.rows))
    drawn = classes.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) / float(1 << 30) < share).select("vec_id", "v").orderBy("vec_id").limit(2 * sample)
    fitted = drawn.toPandas()  # at most 2 * sample vectors
    forest = Forest(np.array(fitted.v.tolist(), np.float64) if len(fitted) else np.zeros((0, lengths.n)), trees)
    sent = spark.sparkContext.broadcast(forest)  # bounded by the sample
    schema = "vec_id long, v binary, least double, leaves array<long>"
    index = classes.select("vec_id", "v").mapInArrow(_routed(sent, 0, k + 1), schema)
    # The classes that are asked for; the queries themselves come back at the end.
    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h", "v")
    asking = written(asked.select("h", "v").distinct().join(classes.select("h", "v", F.col("vec_id").alias("class")), ["h", "v"]))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    queries = asking.select(F.col("class").alias("vec_id"), "v").repartition(width, "vec_id").mapInArrow(_routed(sent, budget, k + 1), schema)
    # A leaf's vectors are dealt over salts so that a task holds about BLOCK of them; queries go to every salt of their leaves.
    salts = max(1, -(-int(lengths.rows) * trees // max(1, forest.leaves) // BLOCK))
    left = queries.select("vec_id", "v", "least", F.explode("leaves").alias("leaf")).select("vec_id", "v", "least", "leaf", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    right = index.select("vec_id", "v", F.explode("leaves").alias("leaf")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    found = left.groupBy("leaf", "salt").cogroup(right.groupBy("leaf", "salt")).applyInPandas(_leaf_best(k + 1), "query long, cand long, near double, tol double")
    found = found.groupBy("query", "cand").agg(F.max("near").alias("near"), F.max("tol").alias("tol"))
    # All that may be among the k + 1 best go on, however many they are: those that reach the (k + 1)-th best sure value.
    sure = Window.partitionBy("query").orderBy(F.desc(F.col("near") - F.col("tol")), "cand")
    bar = F.min(F.when(F.col("n") <= k + 1, F.col("near") - F.col("tol"))).over(Window.partitionBy("query"))
    best = found.withColumn("n", F.row_number().over(sure)).withColumn("bar", bar).where(F.col("near") + F.col("tol") >= F.col("bar"))
    offered = best.select("query", "cand").join(classes.select(F.col("vec_id").alias("cand"), "ids", F.col("v").alias("x")), "cand")
    exact = F.aggregate(F.zip_with("v", "x", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    scored = offered.join(asking.select(F.col("class").alias("query"), "v"), "query").select("query", exact.alias("score"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)  # a query of the class may be one of them
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("n"), "vec_id", "score"))).alias("list"))
    # A vector that many queries have: its list goes to every salt.
    of = asking.select("h", "v", F.col("class").alias("query")).join(lists, "query").select("h", "v", "list", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    got = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(of, ["h", "v", "salt"])
    others = F.slice(F.filter("list", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return got.select("query_id", F.posexplode(others).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
