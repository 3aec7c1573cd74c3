"""From source tables to canonical streams: vocabularies, strata and pseudonyms, and readers of CSV and JSON sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mapped(rows: DataFrame, column: str, vocabulary: Mapping[str, str], name: str) -> DataFrame:
    """rows with a canonical value of a source's own word, and whether it has none: words outside the vocabulary (and null) become 'other' and are counted, never dropped."""
    words = F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair]) if vocabulary else F.create_map().cast("map<string,string>")
    found = F.try_element_at(words, F.col(column))
    return rows.withColumn(name, F.coalesce(found, F.lit("other"))).withColumn("unmapped", found.isNull())


def banded(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The name of the first band whose upper edge is above the value; null stays null."""
    out = F.when(value.isNotNull(), F.lit(last))
    for edge, label in reversed(edges):
        out = F.when(value < edge, label).otherwise(out)
    return out


def strata(rows: DataFrame, key: str, levels: Mapping[str, Column]) -> DataFrame:
    """member_ref and its strata; a level that is not known is 'unstated'."""
    return rows.select(F.col(key).alias("member_ref"), *[F.coalesce(c.cast("string"), F.lit("unstated")).alias(k) for k, c in levels.items()])


def pseudonym(ref: Column, kind: str, key: str) -> Column:
    """A reference that can't be turned back without the key: the same within a kind, unrelated between kinds and keys."""
    return F.concat(F.lit(f"{kind[:1]}_"), F.substring(F.sha2(F.concat(F.lit(f"{key}:{kind}:"), ref.cast("string")), 256), 1, 16))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV source with a header and a declared schema; a row that does not fit it fails the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON manifest (one document a file) with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
