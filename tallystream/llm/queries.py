"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.llm.ann import nearest
from tallystream.llm.bpe import encode_decode
from tallystream.llm.htmltext import main_text
from tallystream.llm.jpeg import media_digests
from tallystream.llm.langid import fit, held_out, identify
from tallystream.llm.minhash import near_duplicates
from tallystream.llm.mixing import mix
from tallystream.llm.oracles import TRIE_SQL, lloyd_sql
from tallystream.llm.pii import spans_report
from tallystream.llm.prefixtrie import conversation_trie
from tallystream.llm.sharding import ring_shards
from tallystream.llm.tables import settled, table
from tallystream.llm.tokencount import token_counts
from tallystream.llm.vectorcodes import compress
from tallystream.llm.warc import derivatives, responses


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose distinct 4-word shingle sets overlap by 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of pages as WARC responses: their links, digests and bytes."""
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document in a mix of 1.5 times all documents, sources weighing 5, 2, 1 in turn."""
    plan = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return plan.select("doc_id", "size", "source", "source_size", "target", "taken", F.transform("places", lambda p: p.shard).alias("shards"))


def op9_projection_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op10_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of documents from a bounded-load ring."""
    return ring_shards(table(spark, sf_dir, "documents"), shards=8)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of documents, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_languages")


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as coefficients of progressive JPEGs and read back."""
    return media_digests(table(spark, sf_dir, "documents"))


def byte_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of documents, from counts per distinct pre-token."""
    return token_counts(table(spark, sf_dir, "documents"), byte_vocabulary, limit=512)


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of pages."""
    return main_text(table(spark, sf_dir, "pages"))


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of documents."""
    return encode_decode(table(spark, sf_dir, "documents"), word_vocabulary)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of embeddings: 8 parts, 16 entries, 6 rounds."""
    return settled(lambda: compress(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that share heads, with subtree sums."""
    return conversation_trie(table(spark, sf_dir, "conversations"), family=20, heads=4)


def op13_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents: base patterns, and what their contexts lead to."""
    return spans_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_mixture": op2_language_mixture,
    "op3_progressive_jpeg": op3_progressive_jpeg,
    "op4_token_counts": op4_token_counts,
    "op5_page_differencing": op5_page_differencing,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_source_mixing": op8_source_mixing,
    "op9_projection_forest_search": op9_projection_forest_search,
    "op10_consistent_hash_sharding": op10_consistent_hash_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_bootstrapped_pii": op13_bootstrapped_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.doc_id AND r.c < b.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
""",
    "op11_vector_codes": lloyd_sql(),
    "op12_conversation_prefix_trie": TRIE_SQL,
}
