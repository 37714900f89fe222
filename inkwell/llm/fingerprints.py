"""One-permutation MinHash fingerprints with optimal densification.

Each five-word shingle of a text is hashed once; the high part of the hash
chooses one of ``BINS`` bins and each bin keeps its smallest hash.  An empty
bin takes the value of another one, found by hashing (bin, attempt) until a
filled bin is hit: the attempts do not depend on the text, so equal texts
agree and each filled bin is equally likely.  Of every bin ``BITS`` low-order
bits are stored, packed; unequal bins agree by chance once in ``2 ** BITS``,
which the estimate of the likeness subtracts.

Edge cases: a null text is an empty text; a text without words has the
fingerprint of zeros with the mark ``-`` in front, is alike (1.0) only to
another such text; a text of one to four words has one shingle; repeated rows
are rows of their own, rows of one doc_id are ordered by text; null ids come
last; a table of one row is its own next document; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import mix64, only, shingles, ship, table, words_of

BINS = 256
BITS = 4


@lru_cache(maxsize=4)
def _attempts(start: int, stop: int) -> np.ndarray:
    """The bins that the attempts start..stop of every bin point to."""
    a = np.arange(start, stop, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)
    return (mix64(a + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.uint8)    # BINS is 256


_EDGES = np.arange(BINS, dtype=np.uint64) * np.uint64(2 ** 64 // BINS)


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """Low-order bits of the densified bins of sorted hashes; None for an
    empty set."""
    if not len(hashes):
        return None
    first = np.searchsorted(hashes, _EDGES)                 # a bin is a range of hashes
    filled = first < np.append(first[1:], len(hashes))
    bins = hashes[np.minimum(first, len(hashes) - 1)]
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    start, tries = 0, _attempts(0, 8)
    while empty.size:
        to = tries[:, empty]
        hit = filled[to]
        which = hit.argmax(axis=0)
        found = hit[which, np.arange(empty.size)]
        source[empty[found]] = to[which[found], np.flatnonzero(found)]
        empty = empty[~found]
        if empty.size:
            start += len(tries)
            tries = _attempts(start, 16 * start)
    # The bin's number goes into its bits, or bins filled from one source
    # would agree by chance all together.
    own = bins[source] + np.arange(BINS, dtype=np.uint64)
    return (mix64(own) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(values: np.ndarray | None) -> str:
    """Two bins a byte, in hex; a text without words has the mark ``-``."""
    if values is None:
        return "-" + "0" * (BINS * BITS // 4)
    return ((values[::2] << 4) | values[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity, without the bins that agree by chance."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    chance = 1.0 / (1 << BITS)
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1.0 - chance))))


def edited(text: str, following: str) -> str:
    """The last half of the text gives way to the start of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) in ascending order within ranges of the id, each
    range closed by a copy (``peek``) of the first row of the range after it,
    the last by that of the first.  The text is shuffled once; the driver
    sees one id per range."""
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = only(docs, "doc_id", "text")
    cuts = d.where(F.col("doc_id").isNotNull()).approxQuantile(
        "doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    splits = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    d = d.withColumn("_id", F.col("doc_id").cast("double"))
    d = Bucketizer(splits=splits, inputCol="_id", outputCol="_r", handleInvalid="keep").transform(d)
    d = d.withColumn("_r", F.coalesce(F.col("_r").cast("int"), F.lit(len(splits)))).drop("_id")
    first = sorted((r["_r"], r["id"]) for r in d.groupBy("_r").agg(F.min("doc_id").alias("id")).collect())
    before = [(x[1], first[i - 1][0]) for i, x in enumerate(first)]      # at most one row per range
    ask = spark.createDataFrame(before or [(None, 0)], "_first long, _to int")
    peeks = (d.join(F.broadcast(ask), F.col("doc_id").eqNullSafe(F.col("_first")))
             .select("doc_id", "text", F.col("_to").alias("_r"), F.lit(1).alias("peek")))
    return (d.select("doc_id", "text", "_r", F.lit(0).alias("peek")).unionByName(peeks)
            .repartition("_r").sortWithinPartitions("_r", "peek", "doc_id", "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def of(text: str) -> np.ndarray | None:
            return sketch(shingles(words_of(text)))

        last = None                                        # id, text, sketch of the row that waits for its next
        closed = False
        for b in batches:
            rows = []
            for doc, text, peek in zip(b["doc_id"], b["text"], b["peek"]):
                if peek and closed:
                    continue                               # rows that share the first id: the first of them counts
                text = text or ""
                own = of(text)
                if last is not None:
                    doc0, text0, own0 = last
                    changed = edited(text0, text)
                    new = of(changed)
                    rows.append((doc0, len(text0), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                                 packed(own0), packed(new), likeness(own0, new), likeness(own0, own)))
                closed = bool(peek)
                last = None if peek else (None if pd.isna(doc) else int(doc), text, own)
            yield pd.DataFrame(rows, columns=cols).astype({"doc_id": "Int64"})

    return with_next(docs).mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def op8_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
