"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.session import scratch_path, table  # noqa: F401  (re-exported)
from inkwell.session import ship_package as ship  # noqa: F401

_WORD = re.compile(r"\w+")


def _written(spark) -> list[str]:
    """Scratch folders of this application that ``cut`` has written."""
    sc = spark.sparkContext
    if not hasattr(sc, "_inkwell_cuts"):
        sc._inkwell_cuts = []
    return sc._inkwell_cuts


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and continue
    from the files: several consumers share one computation, and a lost
    executor only rereads."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _written(spark).append(path)
    return spark.read.parquet(path)


def finished(spark, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``cut`` of the table that ``make`` builds; the scratch folders that were
    written on the way to it are removed once it is there."""
    written = _written(spark)
    before = len(written)
    out = cut(make(), name)
    for path in written[before:-1]:
        remove(spark, path)
    del written[before:-1]
    return out


def remove(spark, path: str | None) -> None:
    """Delete a scratch folder that nothing will read again."""
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, most_rows: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Marked for broadcast if its counted rows and bytes allow, else left to
    be joined by shuffle.  ``df`` is read for it: pass a written table."""
    parts = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("string", "binary"):
            parts.append(F.octet_length(c))
        elif kind == "array<string>":
            parts.append(F.aggregate(c, F.lit(0), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0))))
        elif kind.startswith("array"):
            parts.append(F.size(c) * 8 * max(1, kind.count(":")))
    size = sum((F.coalesce(p.cast("long"), F.lit(0)) for p in parts), F.lit(8 * len(df.columns)).cast("long"))
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if r["n"] <= most_rows and r["b"] <= most_bytes else df


def only(df: DataFrame, *cols: str) -> DataFrame:
    """The operator's own input columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def boxed(docs: DataFrame, *cols: str) -> DataFrame:
    """The whole row as one struct ``row`` next to the columns an operator
    works on, so that no other column's name can clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *[F.col(f"`{c}`") for c in cols])


def unboxed(df: DataFrame, names: list[str], **new) -> DataFrame:
    """The columns of the boxed rows again, some replaced."""
    return df.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in names])


def words_of(text: str | None) -> list[str]:
    """Lower-cased maximal runs of word characters; null has none."""
    return _WORD.findall(text.lower()) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: list[str], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words.  A text
    of fewer words, but not none, has one shingle of all its words."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    k = min(size, n)
    acc = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix64(acc + h[j:n - k + 1 + j] * np.uint64(2 * j + 0x9E3779B97F4A7C15))
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]
