"""Vector code compression by member-resident Lloyd iteration.

Vectors of whole numbers are cut into parts; every part becomes the index of the nearest entry of its position's codebook.
Part rows lie in files partitioned by (position, entry, salt), the home of an entry's members.  An owner keeps count and sum of
its members.  A round reads the homes where they lie and writes only the parts whose nearest entry changed, brought to their
new home by the round's shuffle; owners add what came and take off what left.  Whether a row still lives where it was written follows
from the codebooks since then, so rows that stay are never written again.

Codebooks and sums have entries * components numbers whatever the input: they go through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.tables import drop, spread, written

#: Members of an entry that share a salt, about, and salts at least.
MEMBERS, SALTS = 1 << 15, 16
#: Scaled components lie below this size, so that summed squares fit a long.
LIMIT = 1 << 26

_PART = "rid long, vec_id long, label string, pos int, c array<int>"


def _parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    c = b.column("c")
    return b.column("pos").to_numpy(), c.flatten().to_numpy().astype(np.int64).reshape(len(c), -1)


def _nearest(book: np.ndarray, pos: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (of equally near ones the first) of each part, and its squared distance."""
    to, far = np.zeros(len(pos), np.int32), np.zeros(len(pos), np.int64)
    for p in np.unique(pos):
        here = pos == p
        gap = np.stack([((c[here] - e) ** 2).sum(1) for e in book[p]], 1)
        to[here] = gap.argmin(1)
        far[here] = gap.min(1)
    return to, far


def _residents(books: list[np.ndarray], since: int, moving: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows written in round `since`, those that live there until the last codebook: with their entry under it, or only those that leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for book in books[since + 1 : -1]:
                if len(b):
                    b = b.filter(pa.array(_nearest(book, *_parts(b))[0] == b.column("entry").to_numpy()))
            if not len(b):
                continue
            to, far = _nearest(books[-1], *_parts(b))
            if moving:
                away = to != b.column("entry").to_numpy()
                b, to, far = b.filter(pa.array(away)), to[away], far[away]
            names = ["rid", "vec_id", "label", "pos", *(["c", "entry"] if moving else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(to), pa.array(far)], [*names, "to", "far"])

    return run


def _first_homes(book: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest(book, *_parts(b))[0])], [*b.schema.names, "entry"])

    return run


def _sums(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count and sum of the parts by (pos, column), for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            pos, c = _parts(b)
            cells, where = np.unique(np.stack([pos, b.column(column).to_numpy()], 1), axis=0, return_inverse=True)
            total = np.zeros((len(cells), c.shape[1]), np.int64)
            np.add.at(total, where.ravel(), c)
            yield pa.RecordBatch.from_arrays([pa.array(cells[:, 0]), pa.array(cells[:, 1]), pa.array(np.bincount(where.ravel())), pa.array(list(total))], ["pos", "entry", "n", "total"])

    return run


def _owned(members: DataFrame, column: str, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums by (position, entry): at most one row each comes to the driver."""
    each = members.select("pos", "c", column).mapInArrow(_sums(column), "pos int, entry int, n long, total array<long>")
    got = each.groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(shape[2]))).alias("total")).collect()
    n, total = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for r in got:
        n[r.pos, r.entry], total[r.pos, r.entry] = r.n, r.total
    return n, total


def encode(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """Codes of vectors and the codebooks (position, entry, component): for each of `parts` equal consecutive parts the index of the nearest of `entries` entries.

    vectors has vec_id, embedding, label; other columns are ignored.  A component x counts as floor(scale * x).  A position's codebook starts as that part of the vectors of the
    smallest vec_ids (ties by vector; none last; fewer entries if there are fewer vectors); each round assigns all parts (squared Euclidean distance, ties to the lower index), then moves each
    entry to its members' componentwise floored mean; an entry without members stays.  Codes have a row per kept vector: vec_id, label (a string: '=' and the label, empty if there is none),
    code (two hex digits a part) and error (squared distance to the last codebooks).

    Dropped: vectors that are null or hold null or non-finite components.  Codebooks need one length: of the lengths that are a positive multiple of
    `parts` the commonest (of equally common ones the longest) is coded, vectors of other lengths are not.  Rows that share a vec_id are vectors of their own.  Scaled components of 2^26 or
    more raise an error, as their squares would not fit.  No kept vector gives no rows and empty codebooks.  entries is at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries is 1 to 256")
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))

    def whole(x):
        fits = F.abs(x.cast("double") * scale) < LIMIT - 1
        return F.when(fits, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large to be coded")).cast("long")).cast("int")

    label = F.when(F.col("label").isNotNull(), F.concat(F.lit("="), F.col("label").cast("string"))).otherwise(F.lit(""))
    rows = vectors.where(fine).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", whole).alias("v"))
    rows = written(rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)))
    length = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if length is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    width = length["size"] // parts
    kept = rows.where(F.size("v") == length["size"])
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = [np.array([r.v for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)]
    shape = books[0].shape

    salts = max(SALTS, -(-length["n"] // (entries * MEMBERS)))
    home = ["pos", "entry", F.pmod(F.xxhash64("rid"), F.lit(salts))]
    cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("v", p * width + 1, width))).alias("pos", "c")
    homes = [written(kept.select("rid", "vec_id", "label", cut).mapInArrow(_first_homes(books[0]), _PART + ", entry int").repartition(*home))]
    drop(rows)
    n, total = _owned(homes[0], "entry", shape)
    for done in range(1, rounds + 1):
        books.append(np.where(n[:, :, None] > 0, total // np.maximum(n, 1)[:, :, None], books[-1]))
        if done == rounds:
            break
        leaving = [h.mapInArrow(_residents(books, since, True), _PART + ", entry int, to int, far long") for since, h in enumerate(homes)]
        moved = reduce(DataFrame.unionByName, leaving).select("rid", "vec_id", "label", "pos", "c", F.col("entry").alias("left"), F.col("to").alias("entry"))
        homes.append(written(moved.repartition(*home)))
        (came, plus), (left, minus) = _owned(homes[-1], "entry", shape), _owned(homes[-1], "left", shape)
        n, total = n + came - left, total + plus - minus

    final = [h.mapInArrow(_residents(books, since, False), "rid long, vec_id long, label string, pos int, to int, far long") for since, h in enumerate(homes)]
    hexed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda x: F.lpad(F.lower(F.hex(x.to)), 2, "0")), "")
    codes = reduce(DataFrame.unionByName, final).groupBy("rid").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), hexed.alias("code"), F.sum("far").alias("error"))
    codes = written(codes.drop("rid"))
    drop(*homes)
    return codes, books[-1]


def compress(vectors: DataFrame, **how: int) -> DataFrame:
    """The codes of encode() with digests: vec_id, code, error, label_error (errors summed over equal labels; vectors without label form one group),
    codebooks_sha256 (of all components in decimal, by position, entry and place, joined by commas).  No kept vector gives no rows.
    """
    codes, books = encode(vectors, **how)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    per_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    left, right = spread(codes, per_label.drop("n"), "label", codes.count(), per_label)
    return left.join(right, ["label", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray, *, scale: int = 4096) -> DataFrame:
    """codes (with a column code) and the vectors their codes stand for, as column vector: entries put one behind the other, divided by scale."""
    entries = codes.sparkSession.sparkContext.broadcast(books)  # bounded: entries * components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.concatenate([entries.value[p, int(s[2 * p : 2 * p + 2], 16)] for p in range(len(s) // 2)]) / scale for s in b.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g.tolist() for g in got], pa.list_(pa.float64()))], [*b.schema.names, "vector"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(run, f"{fields}, vector array<double>")
