"""Corpus curation.

All operators are ``DataFrame -> DataFrame``.  Row order is never implied:
where the reference relies on list order, an explicit order column is used
(document id, or a seeded md5 key)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.ordering import (_eq_join, ceil_frac, largest_remainder,
                                        rank_within, sample_key, top_n_by_hash)


# --- U2 / U3: keep-first de-duplication --------------------------------------

def _digest(cols: list[str]) -> F.Column:
    """256-bit hash of a tuple of columns; nulls and lengths are part of it."""
    parts = [F.when(F.col(c).isNull(), F.lit("n;")).otherwise(
        F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in cols]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def keep_first(df: DataFrame, key_cols, order_col: str = "doc_id") -> DataFrame:
    """One row per key, the one with the smallest ``order_col`` (the
    first occurrence).  A hash aggregate of (digest of the key, smallest
    order) with map-side combine: a key repeated in a third of the rows
    reduces before the shuffle, and no text is a shuffle key.  The payload is
    joined back for the chosen rows; rows that repeat key and order are one."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    x = df.withColumn("_h", _digest(keys))
    best = x.groupBy("_h").agg(F.min(order_col).alias(order_col))
    return _eq_join(x, best, ["_h", order_col]).dropDuplicates(["_h", order_col]).drop("_h")


# --- P4: wide to long ----------------------------------------------------------

def wide_to_long(df: DataFrame, id_cols, value_cols: dict[str, int], value_name: str = "text",
                 label_name: str = "result") -> DataFrame:
    """Each ``value_col -> label`` becomes its own labelled row."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    parts = [df.select(*ids, F.col(c).alias(value_name), F.lit(lab).alias(label_name))
             for c, lab in value_cols.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- P9: long-text preference ------------------------------------------------

def prefer_long(df: DataFrame, n_col: str, group_cols, min_words: int = 250) -> DataFrame:
    """Keep rows with more than ``min_words`` words, but only in groups
    where at least one such row exists (else the group is kept whole).
    The flag is a per-group aggregate joined back on the group key."""
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    flag = df.groupBy(*g).agg(F.max((F.col(n_col) > min_words).cast("int")).alias("_any_long"))
    return (_eq_join(df, flag, g)
            .where((F.col(n_col) > min_words) | (F.col("_any_long") == 0)).drop("_any_long"))


# --- O3 / O5 / O4: exact seeded sampling and splits ---------------------------

def sample_per_class(df: DataFrame, n: int, class_cols, id_col: str, seed=42,
                     strict: bool = True) -> DataFrame:
    """O3: exactly ``n`` rows per class (smallest md5 keys).  Like the
    reference, asking for more rows than a class has is an error."""
    out = top_n_by_hash(df, class_cols, n, id_col, seed)
    if strict:
        cls = [class_cols] if isinstance(class_cols, str) else list(class_cols)
        short = df.groupBy(*cls).agg(F.count("*").alias("_cnt"))
        # A filter (not a dropped column) so the check is really evaluated.
        ok = F.when(F.col("_cnt") < n, F.raise_error(
            F.lit(f"cannot take a larger sample than population ({n})")).cast("boolean")).otherwise(F.lit(True))
        out = _eq_join(out, short, cls).where(ok).drop("_cnt")
    return out


def absolute_split(df: DataFrame, strata_cols, sizes: list[tuple[str, int]], id_col: str,
                   seed=42, rest: str | None = "rest", strict: bool = True) -> DataFrame:
    """Per stratum, the first ``sizes[0][1]`` rows in seeded
    order go to split ``sizes[0][0]``, the next ones to the next split, and
    the remainder to ``rest`` (or are dropped when ``rest`` is None).  Every
    row lands in exactly one split, so the remainder is the anti-join of
    the chosen rows and needs no second pass.  A stratum with fewer rows than
    the sizes ask for is an error, or with ``strict=False`` fills the splits
    in order."""
    total = sum(s for _, s in sizes)
    st = [strata_cols] if isinstance(strata_cols, str) else list(strata_cols)
    # Only the chosen rows are ranked (a top-n per stratum on slim columns);
    # everything else is the remainder, found by a left join on the id.
    chosen = top_n_by_hash(df.select(id_col, *st), st, total, id_col, seed).select(id_col, "rn")
    ranked = df.join(chosen, id_col, "left" if rest is not None else "inner")
    if strict:
        short = df.groupBy(*st).agg(F.count("*").alias("_cnt"))
        ok = F.when(F.col("_cnt") < total, F.raise_error(
            F.lit(f"a stratum has fewer rows than the splits ask for ({total})")).cast("boolean")).otherwise(F.lit(True))
        ranked = _eq_join(ranked, short, st).where(ok).drop("_cnt")
    split = None
    lo = 0
    for name, size in sizes:
        cond = (F.col("rn") > lo) & (F.col("rn") <= lo + size)
        split = F.when(cond, F.lit(name)) if split is None else split.when(cond, F.lit(name))
        lo += size
    split = split.otherwise(F.lit(rest))
    return ranked.withColumn("split", split)



def stratified_fraction_split(df: DataFrame, class_col: str, id_col: str, test_frac: float,
                              seed=42, names=("train", "test"), group_cols=None) -> DataFrame:
    """``ceil(n * test_frac)`` rows go to the test side, divided over
    the classes in proportion (largest remainder); inside a class the rows
    with the smallest md5 keys are taken.  (id, group, class) must be unique."""
    g = [] if group_cols is None else ([group_cols] if isinstance(group_cols, str) else list(group_cols))
    counts = df.groupBy(*g, class_col).agg(F.count("*").alias("cnt"))
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    take = largest_remainder(counts, g, class_col, ceil_frac(F.sum("cnt").over(wg), test_frac))
    slim = _eq_join(df.select(id_col, *g, class_col), take.select(*g, class_col, "take"), [*g, class_col])
    ranked = rank_within(slim.withColumn("_k", sample_key(id_col, seed)), [*g, class_col], ["_k", id_col])
    side = ranked.select(id_col, *g, class_col, F.when(F.col("rn") <= F.col("take"), F.lit(names[1]))
                         .otherwise(F.lit(names[0])).alias("split"))
    return df.join(side, [id_col, *g, class_col])


def group_fraction_split(df: DataFrame, group_col: str, class_col: str, test_frac: float, seed=42,
                         names=("train", "test")) -> DataFrame:
    """O4 by whole groups: all rows of a ``group_col`` value (a context, a
    conversation) go to the same side, so no group leaks between the sides.

    Groups are put in order of their make-up (size, then rows of each class,
    then a seeded md5 key), and every 1/``test_frac``-th goes to the test side.
    So each stretch of alike groups gives its share, and the classes of both
    sides stand in proportion to within one group of each kind.  Ranks are
    exact and counted over balanced ranges; rows join their group's side."""
    n, d = Fraction(str(test_frac)).as_integer_ratio()
    cls = F.coalesce(F.col(class_col).cast("string"), F.lit(""))
    counts = df.groupBy(F.col(group_col).alias("_g"), cls.alias("_c")).agg(F.count("*").alias("_n"))
    kind = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_n"))),
                                    lambda s: F.concat(s["_c"], F.lit(":"), s["_n"].cast("string"))), ",")
    groups = counts.groupBy("_g").agg(F.sum("_n").alias("_size"), kind.alias("_kind"))     # a few classes a group
    ranked = rank_within(groups.withColumn("_k", sample_key("_g", seed)), None, ["_size", "_kind", "_k", "_g"], "_r")
    share = lambda r: F.floor(r * n / F.lit(d))
    side = ranked.select(F.col("_g").alias(group_col), F.when(share(F.col("_r")) > share(F.col("_r") - 1), F.lit(names[1]))
                         .otherwise(F.lit(names[0])).alias("split"))
    return _eq_join(df, side, [group_col])


# --- J7: equal-length matching --------------------------------------------------

def match_by_length(df: DataFrame, n_col: str, label_col: str = "result",
                    id_col: str = "doc_id") -> DataFrame:
    """Pair the k-th human text with the k-th machine text of the
    same word count (file order = ``id_col``), up to the smaller side.
    Output keeps both rows of each pair with ``pair_k`` and the sort key
    of the reference's alternating output (first-seen count, k, label)."""
    ranked = rank_within(df, [n_col, label_col], [id_col], name="pair_k")
    sides = ranked.groupBy(n_col).agg(
        F.sum((F.col(label_col) == 0).cast("long")).alias("_h"),
        F.sum((F.col(label_col) == 1).cast("long")).alias("_m"),
        F.min(id_col).alias("first_seen"))
    return (_eq_join(ranked.where(F.col(label_col).isin(0, 1)), sides, [n_col])
            .where(F.col("pair_k") <= F.least("_h", "_m")).drop("_h", "_m"))


# --- J13: leakage audit -----------------------------------------------------------

def overlap(test: DataFrame, train: DataFrame, key: str = "text") -> DataFrame:
    """Test rows whose key also occurs in the training rows: semi join
    on a 256-bit hash, distinct on the training side, so a common text is one
    row there and no text is a join key."""
    seen = train.select(F.sha2(F.col(key).cast("string").cast("binary"), 256).alias("_h")).distinct()
    return test.withColumn("_h", F.sha2(F.col(key).cast("string").cast("binary"), 256)).join(
        seen, "_h", "left_semi").drop("_h")


# --- A1 / A2 / A4 / A5 -----------------------------------------------------------

def length_stats(df: DataFrame, n_col: str, group_cols) -> DataFrame:
    """A1: min / max / mean word count per group."""
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    return df.groupBy(*g).agg(F.min(n_col).alias("min_words"), F.max(n_col).alias("max_words"),
                              F.avg(n_col).alias("mean_words"), F.count("*").alias("n"))


def length_histogram(df: DataFrame, n_col: str, group_cols, width: int = 100, bins: int = 25) -> DataFrame:
    """A2: ``bins`` bins of ``width`` from 0; values past the last edge are
    dropped, the last edge itself falls in the last bin; empty bins are
    reported with count 0 (left join from the bin table)."""
    g = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    hi = width * bins
    b = F.when(F.col(n_col) == hi, F.lit(bins - 1)).otherwise(F.floor(F.col(n_col) / width)).cast("int")
    counts = (df.where((F.col(n_col) >= 0) & (F.col(n_col) <= hi))
                .groupBy(*g, b.alias("bin")).agg(F.count("*").alias("count")))
    grid = df.select(*g).distinct().select(*g, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(counts, [*g, "bin"], "left")
                .select(*g, "bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"),
                        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


def texts_by_length(df: DataFrame, n_col: str, label_col: str = "result") -> DataFrame:
    """A4: texts grouped by (word count, class) — as rows with a count."""
    return df.groupBy(n_col, label_col).agg(F.count("*").alias("n_texts"))


def mean_words(texts_col) -> F.Column:
    """A5 helper: mean ``split()`` word count of an array of texts."""
    arr = F.col(texts_col) if isinstance(texts_col, str) else texts_col
    n = F.aggregate(F.transform(arr, lambda t: F.size(T.words(t))), F.lit(0).cast("bigint"),
                    lambda a, x: a + x)
    return F.try_divide(n.cast("double"), F.size(arr).cast("double"))
