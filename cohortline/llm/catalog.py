"""Registered queries of this package and the SQL that checks them, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from cohortline.llm import (bpe, chat, collocations, decontaminate, exact_dedup, extract, hard_negatives, harmonic, langid, lm,
                            near_dup, packing, sharding)
from cohortline.llm.text import documents


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract.extracted(spark.read.parquet(f"{folder}/pages.parquet"))


def op2_packed_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Packed rows as written; the ids by their digest."""
    return packing.written(documents(spark, folder)).withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predicted(documents(spark, folder))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder)).drop("first")


def op5_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scored(documents(spark, folder))


def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_groups(documents(spark, folder)).drop("group_digest")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item found in it; documents without a hit have no row."""
    return decontaminate.contaminated(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op8_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id")
    return sharding.placed(spark, docs, "doc_id", sharding.default_shards()).select("row.doc_id", "slot", "shard")


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = chat.with_control_texts(spark.read.parquet(f"{folder}/conversations.parquet"))
    return chat.read_back(chat.conversation_turns(chat.threads(rows), "conv_id", "node", "parent", "role", "text"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; every seventh row takes the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label=label)


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(documents(spark, folder))


def op13_harmonic_packing(spark: SparkSession, folder: str) -> DataFrame:
    return harmonic.piece_checksums(harmonic.sequences(documents(spark, folder)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_text, op2_packed_token_ids, op3_language_id, op4_exact_dedup, op5_lm_score, op6_minhash_near_dedup,
    op7_decontaminate, op8_bpe_codec, op9_sharding, op10_chat_format, op11_hard_negatives, op12_collocations,
    op13_harmonic_packing)} | {"pipeline": corpus_pipeline.run}
CHECKS: dict[str, str] = {"op4_exact_dedup": exact_dedup.SQL, "op6_minhash_near_dedup": near_dup.SQL,
                          "op9_sharding": sharding.SQL, "op10_chat_format": chat.SQL,
                          "op11_hard_negatives": hard_negatives.SQL, "op12_collocations": collocations.SQL}
if corpus_pipeline.ORACLE_SQL:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
