"""A corpus pipeline: documents in, encoded documents of a weighted mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.llm.bpe import encode_decode
from tallystream.llm.langid import fit, held_out, identify
from tallystream.llm.minhash import near_duplicates
from tallystream.llm.mixing import mix, row_key
from tallystream.llm.queries import word_vocabulary
from tallystream.llm.tables import drop, settled, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is found; those without text or letters go."""
    found = identify(docs, fit(docs.where(~held_out())), rows=True)
    return found.where("lang_pred <> 'und'").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id (none counts as the largest), once.

    Documents are told apart by all their columns, so one without doc_id, or one that shares its doc_id with another text, is a
    document like any other; rows that are equal in all columns are one.
    """
    keyed = docs.withColumn("_row", row_key(docs))
    found = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), width=5, percent=80).select(F.col("doc_id").alias("_row"), "component_id").dropDuplicates(["_row"])
    named = found.join(keyed.select("_row", F.col("doc_id").cast("long").alias("_id")).dropDuplicates(["_row"]), "_row")
    first = F.min_by("_row", F.struct(F.col("_id").isNull(), "_id", "_row"))
    kept = named.groupBy("component_id").agg(first.alias("_row")).select("_row")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


#: Pieces that a shard of the mix is dealt in; a row's piece follows from its place key, which is uniform.
PIECES = 4096


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that it takes twice is there twice, one that it does not take is not.

    Rows are brought to pieces of their shards and lie there in the order of their place keys, so every shard is disjoint from the others and shuffled.
    """
    plan = mix(docs, keys=True).where("takes > 0").select(F.col("key").alias("_row"), F.explode("places").alias("_place"))
    # Equal rows are one here and are taken as often as the mix takes all of them.
    once = docs.withColumn("_row", row_key(docs)).groupBy("_row").agg(F.first(F.struct(*docs.columns)).alias("_doc"))
    drawn = once.join(plan, "_row").select("_doc.*", F.col("_place.shard").alias("_shard"), F.col("_place.key").alias("_key"))
    return drawn.repartition("_shard", F.pmod("_key", F.lit(PIECES))).sortWithinPartitions("_shard", "_key").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token counts and the digests of their ids and decoded texts."""
    return encode_decode(docs, word_vocabulary, rows=True).select("row.*", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("source_mixing", source_mix),
    ("bpe_encode_decode", encoded),
]

#: Language identification and BPE can't be written in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written and read again; what a stage wrote on its way is dropped."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not docs and hasattr(before, "_tallystream_path"):
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
