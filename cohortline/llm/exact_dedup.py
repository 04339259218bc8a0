"""Exact duplicates by 128-bit content hash, settled by comparing bytes.

Texts are equal when identical after each run of ASCII white space became one
space. Nulls count as empty; empty texts are equal to each other. A null id
sorts after every number. Rows repeated with the same id all report the same
``keep_id``; ``first`` marks exactly one row of each group, so filters drop
repeats as well.

Bytes are compared by the aggregation itself: it groups by (hash, text), so two
texts under one hash come out as two rows. Each task first reduces its own
copies to one row, so a text that fills a third of the table is one row per
task. Should any hash hold several texts, groups are formed by hash and text.

Very long texts are hashed and compared whole; columns other than id and text are not
read for this, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.llm.text import SPACES
from cohortline.session import materialize


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] = (),
                 content_hash=F.md5) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``first``.

    ``carry`` names further columns, returned as fields of a struct ``row``.
    ``content_hash`` takes the normalized text as binary.
    """
    body = normalized(F.col(f"`{text_column}`"))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        content_hash(body.cast("binary")).alias("hash"), F.sha2(body.cast("binary"), 256).alias("text_sha256"),
        *([F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row")] if carry else []))
    rows = materialize(rows, "exact-rows")

    texts = docs.select(content_hash(body.cast("binary")).alias("hash"), body.alias("body")).groupBy("hash", "body").agg(
        F.count(F.lit(1)).alias("n"))
    several = materialize(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash"),
                          "collisions")
    if several.isEmpty():
        return _settled(rows.withColumn("body", F.lit("")))
    # rare enough to pay for a second copy, this time with the texts that settle it
    whole = materialize(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        content_hash(body.cast("binary")).alias("hash"), F.sha2(body.cast("binary"), 256).alias("text_sha256"), body.alias("body"),
        *([F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]).alias("row")] if carry else [])), "exact-rows")
    return _settled(whole)


def _settled(rows: DataFrame) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("rid"))
    groups = rows.groupBy("hash", "body").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(groups, ["hash", "body"])
    return out.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), "text_sha256",
        (F.col("rid") == F.col("best.rid")).alias("first"), *(["row"] if "row" in rows.columns else []))


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with the columns they came with."""
    return exact_groups(docs, id_column, text_column, docs.columns).filter("first").select("row.*")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""
