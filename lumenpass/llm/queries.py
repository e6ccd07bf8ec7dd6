"""The registered queries of this subpackage: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenpass.llm import bpe, chat, embeddings, media, packing, quality, simhash, token_counts, token_files, toxicity
from lumenpass.llm.common import documents

#: Said by both rows of the conversation that is added to all others.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine links within labels over all vectors; what bad vectors, repeated rows and null ids give is said by ``embeddings.near_duplicates``."""
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.93)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded text of every whole text; a null text is empty, an empty one has no tokens and the digests of nothing."""
    return bpe.digest_table(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, null and empty ones included; repeated rows each have one; see ``toxicity.score_table``."""
    docs = documents(spark, sf_dir)
    return toxicity.score_table(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and checksums of every document, read back from the files; null texts hold just the end id; see ``token_files.write_files``."""
    return token_files.token_id_table(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and links of every document; null and blank texts have fingerprint zero and link; see ``simhash.simhash_table``."""
    return simhash.simhash_table(documents(spark, sf_dir), radius=4)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bin for every piece of every document; see ``packing.pack`` for nulls, long texts and repeated rows."""
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), capacity=4096)


def op7_media_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of every whole text's bytes, read back; a null text is empty and padded like any other; see ``media.text_media_table``."""
    return media.text_media_table(documents(spark, sf_dir))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the control conversation, formatted and read back; null roles and texts are empty; see ``chat.digest_conversations``."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(table.unionByName(control))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text; a null or empty one has none; see ``token_counts.count_table``."""
    return token_counts.count_table(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), limit=4096)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, null and empty ones included; repeated rows each have one; see ``quality.score_table``."""
    docs = documents(spark, sf_dir)
    return quality.score_table(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_toxicity": op3_toxicity,
    "op4_token_files": op4_token_files,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_media_tiles": op7_media_tiles,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
}

#: Quadratic within a label: for the small data that SQL is checked on.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), n AS (
  SELECT vec_id, label, len(e) AS dim, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT * FROM n WHERE norm > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b
  ON a.label = b.label AND a.dim = b.dim AND a.vec_id <> b.vec_id
    AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), low AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN degree USING (vec_id)
"""

CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, length('<|im_start|>' || replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\n') || chr(10)
      || replace(replace(text, '\\', '\\\\'), '<|', '<\\|') || '<|im_end|>' || chr(10)) AS chars,
    coalesce(before, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS ok
  FROM o
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(ok) AND arg_max(role, k) = 'assistant' AS valid
FROM f GROUP BY conv_id
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": EMBEDDING_SQL, "op8_chat_format": CHAT_SQL}
