"""Array maths as Spark expressions.

Functions named ``with_*`` stage the computation over several
projections, so the per-row maximum and log-sum-exp are computed once per
row instead of once per array element inside a lambda."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_log_softmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """M2: ``x - max - ln(sum(exp(x - max)))`` over an array column."""
    arr = F.col(col).cast("array<double>")
    x = df.withColumn("_arr", arr).withColumn("_mx", F.array_max("_arr"))
    x = x.withColumn("_lse", F.col("_mx") + F.ln(F.aggregate(
        "_arr", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_mx")))))
    return x.withColumn(out, F.transform("_arr", lambda v: v - F.col("_lse"))).drop("_arr", "_mx", "_lse")


def with_softmax(df: DataFrame, col: str, out: str) -> DataFrame:
    """M1: ``exp(log_softmax(x))``."""
    return with_log_softmax(df, col, "_ls").withColumn(
        out, F.transform("_ls", lambda v: F.exp(v))).drop("_ls")


def kl_from_log_probs(target_lp, input_lp) -> Column:
    """KL(target || input) = sum exp(t) * (t - i) over two log-probability
    arrays; P15: both are cut to the shorter length first."""
    t, i = _c(target_lp), _c(input_lp)
    n = F.least(F.size(t), F.size(i))
    terms = F.zip_with(F.slice(t, 1, n), F.slice(i, 1, n), lambda a, b: F.exp(a) * (a - b))
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def argmax(arr) -> Column:
    """0-based index of the first maximum."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def array_sum(arr) -> Column:
    return F.aggregate(_c(arr), F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return array_sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def round_array(arr, digits: int = 6) -> Column:
    return F.transform(_c(arr), lambda v: F.round(v, digits))
