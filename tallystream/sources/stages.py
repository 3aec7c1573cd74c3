"""Stages of iterative jobs: tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-', dir=os.environ.get('TMPDIR', '/tmp'))}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Stages:
    """Tables of one job: step() writes one and reads it back, so that lineage ends; drop() deletes it, close() all but the given ones."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._paths = spark, {}

    def step(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self._paths.pop(id(t))
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def close(self, *keep: DataFrame) -> None:
        self.drop(*[t for _, t in list(self._paths.values()) if not any(t is k for k in keep)])
