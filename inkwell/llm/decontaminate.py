"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``WINDOW`` consecutive words of a benchmark item.  Both sides keep,
of every run of ``WINDOW - GRAM + 1`` consecutive word grams (``GRAM`` words
each, hashed), the smallest hash, the last of equal ones.  A run is exactly the
grams of one window, so every shared window has a kept gram at the same place
on both sides: none is missed.  The kept grams are joined; around each hit the
up to six windows that hold the gram are compared with the item windows, word
by word, and the words of the equal ones are marked.

Items of fewer words than ``WINDOW`` have one window, the whole item; for each
such length that occurs, all runs of that many words are joined.

Work per text, not per copy: hits are kept by the hash of the text, so they
are found once per distinct text and joined back to all rows.

Edge cases: null and empty texts and texts without words have no words and no
hits; items without words have no window; items that repeat or share windows
all count, a null id is written ``null``; repeated rows get equal results; an empty benchmark hits nothing;
extra columns are ignored (``clean`` keeps them, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import boxed, cut, only, table, unboxed

WINDOW = 10
GRAM = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"                 # what separates lower-case words
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A counted side of at most so many rows (about 100 bytes each) is broadcast.
BROADCAST_ROWS = 50_000
_PLACE = 31                     # low bits of a packed gram that hold its place (an array is no longer)


def words(text: Column) -> Column:
    """Words of a text: A-Z in lower case, then runs of digits, a-z and
    anything outside ASCII.  Null has none."""
    t = F.coalesce(text, F.lit(""))
    lower = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t))
    return F.array_remove(F.split(lower, _BETWEEN, -1), "")


def _key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _upto(n: Column) -> Column:
    """0 .. n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _pairs(a: str, b: Column, how) -> Column:
    """Column ``a`` with another array, element by element."""
    return F.zip_with(F.col(a), b, lambda x, y: how(x, y))


def _from(a: str, k: int) -> Column:
    """Column ``a`` from its element k (0-based) on."""
    return F.slice(a, k + 1, F.size(a))


def winnowed(texts: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of ``keep``, h, at: the smallest gram hash (the last of equal
    ones) of each run of grams in a row of the words ``w``, each place once.
    A gram is packed in a long, hash bits above its place counted backwards, so
    that one minimum finds both.  Hashes of 5 words and minima of 6 grams are
    built by doubling: a few passes over arrays of longs, no sub-arrays."""
    low, run = (1 << _PLACE) - 1, WINDOW - GRAM + 1
    assert (GRAM, run) == (5, 6)
    d = texts.where(F.size("w") >= WINDOW).withColumn("_1", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("_2", _pairs("_1", _from("_1", 1), F.xxhash64))
    d = d.withColumn("_4", _pairs("_2", _from("_2", 2), F.xxhash64))
    grams = F.slice(_pairs("_4", _from("_1", 4), F.xxhash64), 1, F.size("w") - (GRAM - 1))
    d = d.withColumn("_v", F.transform(grams, lambda h, i: F.shiftleft(h, _PLACE) + (F.lit(low) - i)))
    d = d.withColumn("_m2", _pairs("_v", _from("_v", 1), F.least))
    d = d.withColumn("_m4", _pairs("_m2", _from("_m2", 2), F.least))
    least = F.slice(_pairs("_m4", _from("_m2", 4), F.least), 1, F.size("_v") - (run - 1))
    return d.select(*keep, F.explode(F.array_distinct(least)).alias("_p")).select(
        *keep, F.shiftright("_p", _PLACE).alias("h"),
        (F.lit(low) - F.col("_p").bitwiseAND(F.lit(low).cast("bigint"))).cast("int").alias("at"))


def _windows(items: DataFrame, size: int) -> DataFrame:
    """win (the words), items (ids as strings) of all windows of ``size``."""
    return (_runs(items, "item_id", size).select("win", "item_id").distinct()
            .groupBy("win").agg(F.collect_list("item_id").alias("items")))


def _runs(texts: DataFrame, key: str, n: int) -> DataFrame:
    """All runs of ``n`` words of ``w``: key, start, win."""
    runs = F.transform(_upto(F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i + 1, n), " "))
    return texts.select(key, F.posexplode(runs).alias("start", "win"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its counted rows allow, else joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (hash of a text), n_hit, items (sorted ids): per text with hits."""
    items = only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
                                                      words(F.col("text")).alias("w"))
    items = cut(items.where(F.size("w") > 0), "items")
    raw = only(docs, "text").where(F.col("text").isNotNull()).withColumn("key", _key(F.col("text")))
    texts = raw.select("key", words(F.col("text")).alias("w"))

    # Kept grams that both sides have, once per distinct text.
    prints = _small(winnowed(items, ["item_id"]).select("h").distinct())
    met = winnowed(texts, ["key"]).join(prints, "h", "left_semi").select("key", "at").distinct()
    near = cut(met.groupBy("key").agg(F.collect_list("at").alias("ats")), "near")

    # The windows around them, compared word by word.
    starts = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(
        F.greatest(a - (WINDOW - GRAM), F.lit(0)), F.least(a, F.size("w") - WINDOW)))))
    once = raw.join(_small(near), "key").dropDuplicates(["key"])
    tried = (once.select("key", "ats", words(F.col("text")).alias("w")).select("key", "w", starts.alias("starts"))
             .select("key", F.explode(F.transform("starts", lambda s: F.struct(
                 s.alias("start"), F.array_join(F.slice("w", s + 1, WINDOW), " ").alias("win")))).alias("x"))
             .select("key", "x.start", "x.win"))
    found = tried.join(_small(_windows(items, WINDOW)), "win").select(
        "key", "start", F.lit(WINDOW).alias("size"), "items")
    short = items.select(F.size("w").alias("n")).where(F.col("n") < WINDOW).distinct().collect()
    for n in sorted(r["n"] for r in short):                # at most WINDOW - 1 lengths
        wins = _small(_windows(items.where(F.size("w") == n), n))
        found = found.unionByName(_runs(texts, "key", n).join(wins, "win").select(
            "key", "start", F.lit(n).alias("size"), "items").distinct())

    marks = F.flatten(F.transform(F.collect_list(F.struct("start", "size")),
                                  lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))
    return found.groupBy("key").agg(
        F.size(F.array_distinct(marks)).cast("bigint").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with _n_words, _n_hit and _items (ids sorted as strings)."""
    found = hits(docs, benchmark).select(F.col("key").alias("_key"), F.col("n_hit").alias("_n_hit"),
                                         F.col("items").alias("_items"))
    d = docs.withColumns({
        "_key": _key(F.col("`text`")),
        "_n_words": F.size(F.array_remove(F.split(F.coalesce(F.col("`text`"), F.lit("")), _BETWEEN_ANY_CASE, -1),
                                          "")).cast("bigint")})
    return d.join(_small(cut(found, "hits")), "_key", "left").withColumns({
        "_n_hit": F.coalesce("_n_hit", F.lit(0).cast("bigint")),
        "_items": F.coalesce("_items", F.array().cast("array<string>"))}).drop("_key")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with their columns."""
    marked = decontaminated(boxed(docs, "text"), benchmark)
    return unboxed(marked.where(F.col("_n_hit") == 0), docs.columns)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontaminated(only(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return d.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
                    F.size("_items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
                    (F.col("_n_hit") > 0).alias("contaminated"))
