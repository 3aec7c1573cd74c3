"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Paths of the tables of written() that are not dropped yet, in order.
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one if all runs in this process, else an error."""
    set_to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='spark-', dir=os.environ.get('TMPDIR', '/tmp'))}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it from there: lineage ends, and a lost executor loses nothing."""
    path = f"{shared_folder(df.sparkSession)}/tallystream-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tallystream_path = path
    _paths.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _paths:
        _paths.remove(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """Write what make gives, then drop all tables that were written on the way to it."""
    before = set(_paths)
    out = written(make())
    for path in [p for p in _paths if p not in before and p != out._tallystream_path]:
        _delete(out.sparkSession, path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, t._tallystream_path)


#: Keys that count as heavy at most, and salts that their rows are dealt over.
HEAVY, SPREAD = 2048, 64


def spread(left: DataFrame, right: DataFrame, key: str, rows: int, counts: DataFrame | None = None, salts: int = SPREAD) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on key with a column salt to join on, too: rows of left with a heavy key are dealt over salts, those of right go to all.

    rows is the number of rows of left, or more; counts may give the number n of rows by key, or more, if it is known.  A key is heavy with more than rows / HEAVY of them, so there are no more than HEAVY of these to broadcast.
    """
    counts = counts if counts is not None else left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.where(F.col("n") > max(64, rows // HEAVY)).select(F.col(key).alias("heavy"))
    mark = lambda d: d.join(F.broadcast(heavy), F.col(key) == F.col("heavy"), "left")
    salt = F.when(F.col("heavy").isNotNull(), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(0)
    each = F.when(F.col("heavy").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return mark(left).withColumn("salt", salt).drop("heavy"), mark(right).withColumn("salt", F.explode(each)).drop("heavy")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
