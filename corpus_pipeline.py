"""From raw documents to token ids: clear language, exact and near duplicates out, benchmark out, encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it
kept; all but the last return the columns of ``docs``. Stages are written as
Parquet and read again before the next one.

Defined cases: null, empty and letterless texts go in the first stage, as no language
can be told; of ties and repeated rows the row with the smallest id stays, once; very
long texts go through whole; columns other than id, text and language travel along,
whatever their names, up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortline.llm import bpe, decontaminate, exact_dedup, langid, near_dup
from cohortline.session import materialize


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte statistics of the labelled ones tell; texts without letters go."""
    return langid.keep_identified(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the one with the smallest id."""
    return near_dup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the text's token ids (16 bits each), their number and digests of ids and decoded text."""
    return bpe.digests(docs, with_ids=True)


STAGES = [("language_id", clear_language), ("exact_dedup", distinct_texts), ("near_dedup", distinct_contents),
          ("decontaminate", without_benchmark), ("bpe_codec", token_ids)]

# language statistics, alignment and byte-pair merges are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
