"""Draws from counted distributions and the sampled curvature
built on them (X2, A12).

``alias_tables`` turns the counts of each context into an alias table: one row
a token, its own share of the slot (``cut``, out of the context's total) and
the token that owns the rest (``other``).  A draw is then one look-up by
(context, slot), whatever the size of the context.  The classic construction
pairs under-full with over-full slots one after another; here the same pairing
comes from prefix sums: the rest of an under-full slot belongs to the first
over-full one whose running excess passes the running deficit before the slot,
and an over-full slot keeps what the deficits up to its closing have left.  All
in whole numbers, so any engine builds the same table.

Draws are counter-based: the md5 of (seed, document, position, number) is the
random number, so a retried task, or another engine, draws the same tokens."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators import lm as LM
from inkwell.session import ship_package

#: Name of the whole vocabulary's table among those of the contexts.
UNIGRAM = ""


def alias_tables(dist: DataFrame, group: str, item: str, weight: str) -> DataFrame:
    """Rows (group, slot, item, cut, other, slots, total) of positive whole
    ``weight``; ``weight`` times the size of a group must fit in 63 bits.
    Windows hold one group's items (for a token model at most V+1)."""
    g = Window.partitionBy(group)
    x = dist.select(group, F.col(item).alias("item"), F.col(weight).cast("long").alias("_w"))
    x = x.withColumns({"slots": F.count("*").over(g), "total": F.sum("_w").over(g),
                       "slot": F.row_number().over(g.orderBy("item")).cast("long") - 1})
    x = x.withColumn("_own", F.col("_w") * F.col("slots")).withColumn("_over", F.col("_own") > F.col("total"))
    upto = Window.partitionBy(group, "_over").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    # Running deficit of the under-full slots, running excess of the others.
    x = x.withColumn("_run", F.sum(F.abs(F.col("_own") - F.col("total"))).over(upto))
    at = F.when(F.col("_over"), F.col("_run")).otherwise(F.col("_run") - (F.col("total") - F.col("_own")))
    merged = g.orderBy("_at", F.desc("_over"), "item")
    x = x.withColumn("_at", at).withColumns({
        "other": F.coalesce(F.first(F.when(F.col("_over"), F.col("item")), ignorenulls=True)
                            .over(merged.rowsBetween(1, Window.unboundedFollowing)), F.col("item")),
        "_done": F.max(F.when(~F.col("_over"), F.col("_run"))).over(merged.rowsBetween(Window.unboundedPreceding, -1))})
    cut = F.when(F.col("_over"), F.col("total") + F.col("_run") - F.col("_done")).otherwise(F.col("_own"))
    return x.select(group, "slot", "item", cut.alias("cut"), "other", "slots", "total")


def token_tables(model: LM.TokenModel) -> DataFrame:
    """Alias tables (ctx, ...) of every context with seen pairs, and of the
    vocabulary with add-one counts under the name ``UNIGRAM``."""
    uni = model.vocab.select(F.lit(UNIGRAM).alias("ctx"), F.col("token").alias("tok"), (F.col("c") + 1).alias("c"))
    return alias_tables(model.bigrams.select("ctx", "tok", "c").unionByName(uni), "ctx", "tok", "c")


def random_number(seed, *cols, start: int = 1, digits: int = 15) -> Column:
    """A whole number of ``digits`` hexadecimal digits of md5(seed:col:...)."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))
    return F.conv(F.substring(key, start, digits), 16, 10).cast("long")


def draw(rows: DataFrame, tables: DataFrame, ctx: str, number: str, out: str, bounded: bool = True) -> DataFrame:
    """``rows`` with the token ``out`` that ``number`` draws from the table of
    ``ctx`` (rows without such a table go).  Look-ups by context and by
    (context, slot); the tables of a bounded vocabulary are broadcast."""
    small = F.broadcast if bounded else (lambda df: df)
    sizes = tables.select(F.col("ctx").alias(ctx), "slots", "total").distinct()
    x = rows.join(small(sizes), ctx).withColumn("_r", F.col(number) % (F.col("slots") * F.col("total")))
    x = x.withColumns({"slot": F.expr("_r div total"), "_rest": F.col("_r") % F.col("total")})
    t = tables.select(F.col("ctx").alias(ctx), "slot", "item", "cut", "other")
    x = x.join(small(t), [ctx, "slot"])
    return x.select(*rows.columns, F.when(F.col("_rest") < F.col("cut"), F.col("item")).otherwise(F.col("other")).alias(out))


def _reference_context(model, rows: DataFrame, number: Column, lam_ref: float) -> DataFrame:
    """The table a draw of the reference distribution comes from: the
    context's own with probability lam_ref, else the vocabulary's; contexts
    without seen pairs have only the latter."""
    seen = model.bigrams.select("ctx", F.lit(True).alias("_seen")).distinct()
    x = model.lookup(rows, seen, ["ctx"], "left")
    own = F.col("_seen").isNotNull() & (number < int(lam_ref * (1 << 32)))
    return x.withColumn("_from", F.when(own, F.col("ctx")).otherwise(F.lit(UNIGRAM))).drop("_seen")


def sampled_tokens(model: LM.TokenModel, positions: DataFrame, n_draws: int, seed=0, lam_ref: float = 0.5) -> DataFrame:
    """(doc_id, pos, draw, ctx, sample) of ``n_draws`` draws from the
    reference distribution at each position (doc_id, pos, ctx)."""
    x = positions.select("doc_id", "pos", "ctx", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))).alias("draw"))
    x = x.withColumn("_n", random_number(seed, "doc_id", "pos", "draw"))
    x = _reference_context(model, x, random_number(seed, "doc_id", "pos", "draw", start=16, digits=8), lam_ref)
    return draw(x, token_tables(model), "_from", "_n", "sample", bool(model.n_vocab)).select("doc_id", "pos", "draw", "ctx", "sample")


def _drawer(model: LM.TokenModel, index: LM.RankIndex, pairs: int, lam_ref: float):
    """The task side of :func:`sampled_curvature`: the draws of an Arrow batch
    of positions (doc_id, _c, _true, _key) as array look-ups.  The executors
    hold the alias tables and ln p of every pair as numbers; an index is only
    built for a vocabulary for which both are small (``INDEX_BYTES``)."""
    spark = model.vocab.sparkSession
    ship_package(spark)
    vocab = index.vocab.select("token", "pos", "lb", "lu")

    def at(name: str, out: str) -> DataFrame:
        return F.broadcast(vocab.select(F.col("token").alias(name), F.col("pos").alias(out)))

    t = token_tables(model).join(at("ctx", "_c"), "ctx", "left").join(at("item", "_i"), "item").join(at("other", "_o"), "other")
    v = vocab.toPandas().sort_values("pos")
    n = len(v)
    # The vocabulary's own table comes behind those of its n tokens.
    t = t.select(F.coalesce("_c", F.lit(n)).alias("_c"), "slot", "cut", "_i", "_o", "slots", "total")
    t = t.where("total is not null").toPandas().sort_values(["_c", "slot"])
    first = t[t["slot"] == 0]
    start, slots, total = (np.zeros(n + 1, np.int64) for _ in range(3))
    start[first["_c"]] = np.flatnonzero(t["slot"] == 0)
    slots[first["_c"]], total[first["_c"]] = first["slots"], first["total"]
    lp = np.where((slots[:n] > 0)[:, None], v["lb"].to_numpy(float), v["lu"].to_numpy(float))
    seen = index.pairs.select("key", "lp").toPandas()
    lp[seen["key"] // (index.n_vocab + 1), seen["key"] % (index.n_vocab + 1)] = seen["lp"]
    shared = spark.sparkContext.broadcast((start, slots, total, t["cut"].to_numpy(), t["_i"].to_numpy(np.int32),
                                           t["_o"].to_numpy(np.int32), lp))

    def run(batches):
        start, slots, total, cut, item, other, lp = shared.value
        ends = [str(k).encode() for k in range(2 * pairs)]
        for b in batches if total[-1] else ():             # an empty vocabulary draws nothing
            got = []
            for key in b.column("_key").to_pylist():
                m = hashlib.md5(key.encode())
                for end in ends:
                    d = m.copy()
                    d.update(end)
                    got.append(d.digest())
            bits = np.frombuffer(b"".join(got), ">u8").reshape(-1, 2).astype(np.uint64)
            # Digits 1 to 15 of the digest are the number, 16 to 23 choose the table.
            number = (bits[:, 0] >> np.uint64(4)).astype(np.int64)
            choice = (bits[:, 0] & np.uint64(15)) << np.uint64(28) | bits[:, 1] >> np.uint64(36)
            ctx = np.repeat(b.column("_c").to_numpy(), 2 * pairs)
            own = (slots[ctx] > 0) & (choice < np.uint64(int(lam_ref * (1 << 32))))
            table = np.where(own, ctx, len(slots) - 1)
            number %= slots[table] * total[table]
            row = start[table] + number // total[table]
            token = np.where(number % total[table] < cut[row], item[row], other[row])
            pair = lp[ctx, token].reshape(-1, pairs, 2)
            one, two = pair[..., 0], pair[..., 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_true"), pa.array((one + two).sum(1)),
                                              pa.array(((one - two) ** 2).sum(1))], names=["doc_id", "_true", "_m", "_v"])

    return run


def sampled_curvature(model: LM.TokenModel, texts: DataFrame, pairs: int = 4, lam: float = 0.9, lam_ref: float = 0.5,
                      seed=0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """X2, sampled branch: the curvature with mean and variance estimated from
    draws of the reference distribution instead of the closed form.

    Positions are independent, so a document's mean and variance are sums over
    its positions.  Draws come in pairs (a, b): (a + b) / 2 estimates the mean
    of a position and (a - b)^2 / 2 its variance, both without bias, and both
    add up.  So a document's estimate merges from partial sums of any rows, and
    no draw is a row (see :func:`_drawer`); needs a model with a rank index (bounded V)."""
    index = LM.rank_index(model, lam, lam_ref)
    if index is None:
        raise ValueError("the sampled curvature needs a bounded vocabulary")
    x = index.scored(LM.positions(texts, id_col, text_col)).select("doc_id", "pos", "ctx_word", F.col("lp").alias("_true"))
    places = F.broadcast(index.vocab.select(F.col("token").alias("ctx_word"), F.col("pos").alias("_c")))
    unk = index.vocab.where(F.col("token") == LM.UNK).first()["pos"]
    x = x.join(places, "ctx_word", "left").select(
        "doc_id", F.coalesce("_c", F.lit(unk)).alias("_c"), "_true", F.concat_ws(":", F.lit(str(seed)), "doc_id", "pos", F.lit("")).alias("_key"))
    kind = x.schema["doc_id"].dataType.simpleString()
    # Per position: twice the sum of its pairs' means and of their variances.
    x = x.mapInArrow(_drawer(model, index, pairs, lam_ref), f"doc_id {kind}, _true double, _m double, _v double")
    s = x.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("_true").alias("_sl"),
                                (F.sum("_m") / (2 * pairs)).alias("_sm"), (F.sum("_v") / (2 * pairs)).alias("_sv"))
    s = s.select("doc_id", "n_tokens", F.try_divide(F.col("_sl") - F.col("_sm"), F.sqrt("_sv")).alias("curvature"))
    return texts.select(F.col(id_col).alias("doc_id")).join(s, "doc_id", "left")
