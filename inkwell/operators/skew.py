"""Joins whose keys are very unevenly used.

``heavy_keys`` finds the most frequent keys of a table with a mergeable
summary (one aggregate; each task's summary has a fixed size), and
``lookup_join`` joins a unique right side by them: rows with a heavy key meet
the few right rows of those keys by broadcast, all others by shuffle.  So a
word such as "the" that a third of the rows share is never one task's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys treated as heavy; also the most right rows that are broadcast (but for
#: collisions of a 64-bit hash).
HEAVY = 256


def heavy_keys(df: DataFrame, keys: list[str], k: int = HEAVY, tracked: int = 8192) -> list[int]:
    """Hashes of about the ``k`` most frequent keys.  The summary tracks
    ``tracked`` of them: a key with more than 1/``tracked`` of the rows is
    never missed by much, and a miss only costs speed."""
    top = (df.select(F.xxhash64(*keys).alias("_h"))
           .agg(F.expr(f"approx_top_k(_h, {k}, {tracked})").alias("top")).first()["top"])
    return [t["item"] for t in top or []]


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", k: int = HEAVY) -> DataFrame:
    """``left`` joined to ``right``, which has one row a key at most.  ``left``
    is read more than once: pass a written table."""
    heavy = heavy_keys(left, keys, k)
    if not heavy:
        return left.join(right, keys, how)
    hot = F.xxhash64(*keys).isin(heavy)
    near = left.where(hot).join(F.broadcast(right.where(hot)), keys, how)
    return near.unionByName(left.where(~hot).join(right.where(~hot), keys, how))
