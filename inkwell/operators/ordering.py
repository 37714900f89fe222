"""Order-dependent building blocks that stay balanced under skew.

``rank_within``: exact 1-based row number inside each group, without a
``Window.partitionBy(group)`` that would put a hot group in one task.  The
rows are range-partitioned by (group, order); the partition id is a
monotone bucket; per-bucket counts (a table of at most buckets + groups
rows) give offsets; a window inside each (group, bucket) gives the local
number.  The bucketed rows are checkpointed so both consumers see the
same buckets (also after an executor is lost).

``top_n_by_hash``: seeded, repeatable sampling.  The order key is
``md5(seed ':' id)`` (identical in Spark and DuckDB); a histogram of the
keys' first digits finds where the n-th key lies, and only the rows up to
there are ranked (radix selection).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import checkpoint_root


def _cols(c) -> list[str]:
    if c is None:
        return []
    return [c] if isinstance(c, str) else list(c)


def _eq_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on ``keys`` that keeps the left key columns.
    The right side is re-aliased first, so joining two frames derived from
    the same scan never yields ambiguous columns."""
    if not keys:
        raise ValueError("join needs keys")
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def running_sums(df: DataFrame, group_cols, order_cols: list[Column | str], values: dict[str, Column],
                 buckets: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Exact inclusive running sums of ``values`` (name -> column) inside each
    group in the given (total) order, with balanced tasks (see module doc).
    ``keep`` writes the bucketed rows and reads them back (else a checkpoint)."""
    g = _cols(group_cols)
    spark = df.sparkSession
    checkpoint_root(spark)
    order = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keys = [*[F.col(c) for c in g], *order]
    names = list(values)
    x = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    # Without an explicit count AQE may merge adjacent ranges on small
    # inputs; merged ranges are still contiguous, so ids stay monotone.
    ranged = x.repartitionByRange(buckets, *keys) if buckets else x.repartitionByRange(*keys)
    b = ranged.withColumn("_b", F.spark_partition_id())
    b = keep(b) if keep else b.checkpoint(eager=True)
    tot = b.groupBy(*g, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    before = wg.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.select(*g, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in names])
    upto = Window.partitionBy(*g, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = b.withColumns({f"_l_{n}": F.sum(f"_v_{n}").over(upto) for n in names})
    out = _eq_join(local, tot, [*g, "_b"])
    return out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_l_{n}") for n in names}).drop(
        "_b", *[f"_{k}_{n}" for k in "vlo" for n in names])


def running_sum(df: DataFrame, group_cols, order_cols: list[Column | str], value: Column | str,
                name: str = "running", buckets: int | None = None) -> DataFrame:
    """:func:`running_sums` of one value."""
    val = F.col(value) if isinstance(value, str) else value
    return running_sums(df, group_cols, order_cols, {name: val}, buckets)


def rank_within(df: DataFrame, group_cols, order_cols: list[Column | str], name: str = "rn",
                buckets: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by group order by order_cols)``
    computed with balanced tasks.  ``order_cols`` must make the order total
    (end with a unique id)."""
    out = running_sum(df, group_cols, order_cols, F.lit(1).cast("bigint"), name, buckets)
    return out.withColumn(name, F.col(name).cast("bigint"))


def sample_key(id_col, seed: int | str = 42) -> Column:
    """O1: repeatable shuffle key ``md5('<seed>:<id>')``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def top_n_by_hash(df: DataFrame, group_cols, n, id_col: str, seed: int | str = 42,
                  name: str = "rn", salts: int = 1 << 16) -> DataFrame:
    """Per group, the rows with the ``n`` smallest ``md5(seed:id)`` keys,
    numbered 1..n in that order (ties by id).  ``n`` is an int or the name
    of a per-group column already on ``df``.

    Exact, by radix selection: the range of the keys is cut into ``salts``
    equal buckets by their first digits, and a histogram (counted before the
    shuffle, at most ``salts`` rows a group) finds the bucket in which the n-th
    key lies; only the buckets up to that one are shuffled and ranked, so a
    task ranks n rows and what else their last bucket holds (a group's rows /
    ``salts``).  Pass slim columns and join the text to the chosen ids."""
    g = _cols(group_cols)
    most = F.lit(n) if isinstance(n, int) else F.col(n)
    start = F.conv(F.substring("_k", 1, 7), 16, 10).cast("bigint")
    x = df.withColumn("_k", sample_key(id_col, seed)).withColumn("_s", F.floor(start * salts / (1 << 28)))
    whole = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    seen = x.groupBy(*g, "_s").agg(F.count("*").alias("_c"), F.max(most).alias("_n"))
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (seen.withColumn("_before", before).where(F.col("_before") < F.col("_n"))
            .groupBy(*g).agg(F.max("_s").alias("_last")))
    # One row a group.
    kept = (_eq_join(x, last, g) if g else x.withColumn("_last", last.select("_last").scalar())).where(
        F.col("_s") <= F.col("_last"))
    kept = kept.withColumn(name, F.row_number().over(whole.orderBy("_k", id_col)).cast("bigint"))
    return kept.where(F.col(name) <= most).drop("_k", "_s", "_last")


def largest_remainder(counts: DataFrame, group_cols, strata_col: str, total: Column,
                      name: str = "take") -> DataFrame:
    """Split an integer ``total`` per group across strata in proportion to
    their ``cnt``: floors first, then one more to the largest remainders
    (ties: smaller stratum value first).  ``counts`` has group, stratum,
    ``cnt``; small (strata x groups rows)."""
    g = _cols(group_cols)
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    c = counts.withColumn("_N", F.sum("cnt").over(wg)).withColumn("_T", total)
    exact = F.col("_T") * F.col("cnt") / F.col("_N")
    c = c.withColumn("_fl", F.floor(exact).cast("bigint")).withColumn("_rem", exact - F.floor(exact))
    c = c.withColumn("_left", F.col("_T") - F.sum("_fl").over(wg))
    c = c.withColumn("_r", F.row_number().over(wg.orderBy(F.desc("_rem"), F.col(strata_col))))
    return c.withColumn(name, (F.col("_fl") + (F.col("_r") <= F.col("_left")).cast("bigint"))).drop(
        "_N", "_T", "_fl", "_rem", "_left", "_r")


def ceil_frac(n: Column, frac: float) -> Column:
    """``ceil(n * frac)`` with the float product done once, as in Python."""
    return F.ceil(n.cast("double") * F.lit(float(frac))).cast("bigint")

