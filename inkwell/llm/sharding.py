"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a pseudo-random score ``-ln(u) / weight`` with
``u`` from ``md5(key:shard)``; the smallest score wins.  The choice needs the
key and the shard list only, so a new shard takes rows only into itself and a
removed one gives away only its own rows; a heavier shard gets rows in
proportion to its weight.

Edge cases: a null key is the key ``null``; repeated keys go to the same
shard and take different slots; a null text has no bytes (size 1, crc32 0);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import only, table
from inkwell.operators.ordering import rank_within

SHARDS = 8


def shard_of(key: Column, weights: list[float]) -> Column:
    """Index of the shard that ``key`` belongs to.  ``weights``: one positive
    number per shard; a shard of weight 0 gets no rows."""
    if not any(w > 0 for w in weights):
        raise ValueError("one shard at least needs a positive weight")
    k = F.coalesce(key.cast("string"), F.lit("null"))

    def score(i: int, w: float) -> Column:
        h = F.substring(F.md5(F.concat(k, F.lit(f":{i}"))), 1, 13)        # 52 bits: exact in a double
        u = (F.conv(h, 16, 10).cast("double") + 0.5) / float(2 ** 52)
        return F.struct((-F.log(u) / F.lit(float(w))).alias("s"), F.lit(i).alias("i"))

    return F.array_min(F.array(*[score(i, w) for i, w in enumerate(weights) if w > 0]))["i"].cast("int")


def assign(docs: DataFrame, weights: list[float], grown: list[float]) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.  ``slot``
    numbers the rows of a shard from 0 in the order of a hash of the key,
    by range partitions and their counts (no shard is gathered in a task)."""
    d = only(docs, "doc_id", "text")
    x = d.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("bigint").alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"))
    x = x.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")))
    r = rank_within(x, ["shard"], ["_h", "doc_id", "text_crc32"], "_rank")
    return r.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_rank") - 1).cast("bigint").alias("slot"), "grown_shard")


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
