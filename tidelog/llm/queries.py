"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, mixing, quality, secrets, toxicity
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.near_dedup import near_dedup
from tidelog.llm.neighbours import nearest
from tidelog.llm.packing import pack
from tidelog.llm.token_counts import token_counts

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("row")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra.withColumn("turn", F.col("turn").cast("long")))
    return chat.digests(chat.format_chats(turns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("row")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents")).drop("row")


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""

QUERIES = {
    "op1_additive_quantisation": op1,
    "op2_quality_discriminant": op2,
    "op3_secret_linking": op3,
    "op4_fair_queue_mixing": op4,
    "op5_bpe_token_counts": op5,
    "op6_toxicity_grammar": op6,
    "op7_chat_format": op7,
    "op8_open_window_packing": op8,
    "op9_extendible_hash_dedup": op9,
    "op10_weighted_near_dedup": op10,
}

ORACLES = {"op4_fair_queue_mixing": mixing.SQL, "op7_chat_format": chat.SQL, "op9_extendible_hash_dedup": OP9_SQL}
