"""Placement of documents on shards by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime
size: (offset + k * skip) modulo the size. Shards take turns; at its turn a shard
claims the first slot of its order that is still free. Every shard ends up with
the same number of slots, give or take one, and when a shard joins or leaves
most slots keep their owner. A document's slot is a hash of its key modulo the
table's size, so its shard is one look into a broadcast table of fixed size.

The table depends on shard names and its size only, never on the documents, and
has a few thousand rows; it is filled on the driver and placed by a join, all in
DataFrame operations. Null keys go to the slot of the empty key; repeated keys
and ties go to the same shard; other columns travel along as one struct, so their names
do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARDS, TABLE_SIZE = 64, 8209
MAX_TABLE = 1 << 20


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def digits(text: str, part: int) -> int:
    """60 bits of a name's hash; ``part`` 0 or 1."""
    return int(hashlib.md5(text.encode()).hexdigest()[part * 16:part * 16 + 15], 16)


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Owner of each slot, as the place of the shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(size) or size > MAX_TABLE or size < len(shards):
        raise ValueError("the table's size must be a prime, at least the number of shards and at most 2**20")
    at = [digits(s, 0) % size for s in shards]
    skip = [digits(s, 1) % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            free -= 1
            if not free:
                return owner


def slot(key: Column, size: int) -> Column:
    """Place of a key in the table: 60 bits of its hash modulo the size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % F.lit(size)


def placed(spark: SparkSession, docs: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` as a struct ``row`` with ``slot`` and ``shard`` (a shard's place in ``shards``)."""
    owners = ",".join(map(str, lookup_table(shards, size)))
    table = spark.range(0, 1, 1, 1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select(
        F.col("slot").cast("long"), F.col("shard").cast("long"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row"),
                       slot(F.col(f"`{key}`"), size).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("row", "slot", "shard")


def write_shards(spark: SparkSession, docs: DataFrame, key: str, path: str, shards: Sequence[str],
                 size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write one folder per shard; ``files_per_shard`` tasks share a shard, dealt by slot."""
    rows = placed(spark, docs, key, shards, size)
    rows.repartition(len(shards) * files_per_shard, "shard", F.col("slot") % files_per_shard).select(
        "row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)


def default_shards(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


SQL = f"""
WITH RECURSIVE shards AS (
    SELECT i, ('0x' || substr(md5('shard-' || i), 1, 15))::BIGINT % {TABLE_SIZE} AS origin,
           ('0x' || substr(md5('shard-' || i), 17, 15))::BIGINT % {TABLE_SIZE - 1} + 1 AS skip
    FROM range({SHARDS}) t(i)),
lists AS (SELECT list(origin ORDER BY i) AS origins, list(skip ORDER BY i) AS skips FROM shards),
fill(step, taken, pick) AS (
    SELECT 0, list_transform(range({TABLE_SIZE}), lambda x: false), -1::BIGINT
    UNION ALL
    SELECT step + 1, list_transform(taken, lambda t, j: t OR j = best + 1), best FROM (
        SELECT step, taken, list_filter(
            list_transform(range({TABLE_SIZE}), lambda k: (origins[step % {SHARDS} + 1] + k * skips[step % {SHARDS} + 1]) % {TABLE_SIZE}),
            lambda s: NOT taken[s + 1])[1] AS best
        FROM fill, lists WHERE step < {TABLE_SIZE}))
SELECT d.doc_id, d.slot, ((f.step - 1) % {SHARDS})::BIGINT AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents) d
JOIN fill f ON f.pick = d.slot
"""
