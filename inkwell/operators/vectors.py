"""Per-layer vectors and KL-based layer choice (SURVEY D8, D9, D11, P14,
J1, J2, A13, A14, A16, A28, W6, X8, M8).

Long layout: ``doc_id, layer, pos, vec ARRAY<DOUBLE>`` (one row per
document, layer and token position; the reference's ``[N, L*dim]`` matrix
becomes L rows per document).  Stored partitioned by ``layer``, a fixed
layer pick is a partition-pruned scan.  KL needs each mid layer next to
the two anchor layers of the same (doc, pos): anchors are pivoted into
one row per (doc, pos) and joined — a join on (doc, pos), so every
document's rows meet in one task without any cross product."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import maths as M


def split_layers(df: DataFrame, vec_col: str, n_layers: int, dim: int, id_col: str = "doc_id",
                 pos: int | None = 0) -> DataFrame:
    """D8 -> long layout: cut a concatenated ``[L*dim]`` vector into L
    rows of ``dim`` values (P14 per layer).  A vector shorter than
    ``L*dim`` raises instead of yielding empty layers."""
    v = F.col(vec_col).cast("array<double>")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n_layers - 1)),
                        lambda l: F.struct(l.alias("layer"), F.slice(v, l * dim + 1, dim).alias("vec")))
    checked = F.when(F.size(v) >= n_layers * dim, parts).otherwise(
        F.raise_error(F.lit(f"vector shorter than {n_layers} x {dim}")))
    out = df.select(F.col(id_col).alias("doc_id"), F.inline(checked))
    return out.withColumn("pos", F.lit(pos)) if pos is not None else out


def layer_projection(long: DataFrame, layer: int, n_layers: int | None = None) -> DataFrame:
    """Vectors of one layer (a filter; partition-pruned when stored
    by layer).  Asking for a layer past the end raises."""
    if n_layers is not None and not (0 <= layer < n_layers):
        raise IndexError(f"layer {layer} outside 0..{n_layers - 1}")
    return long.where(F.col("layer") == layer)


def last_valid_pool(hidden: DataFrame, mask_col: str = "mask") -> DataFrame:
    """Per (doc, layer) the vector of the last position whose mask is
    1 (covers left- and right-padded batches alike)."""
    return (hidden.where(F.col(mask_col) == 1)
                  .groupBy("doc_id", "layer")
                  .agg(F.max_by("vec", "pos").alias("vec"), F.max("pos").alias("pos")))


def kl_by_layer(logits: DataFrame, first_layer: int, last_layer: int, mid_layers: list[int],
                last_position_only: bool = False) -> DataFrame:
    """KL(first || mid) + KL(last || mid) for each mid layer,
    summed over the vocabulary, averaged over positions ("batchmean" over
    tokens).  Input ``doc_id, layer, pos, vec`` holds per-layer logits
    (hidden states after the output head; identity head in fixtures)."""
    x = logits
    if last_position_only:
        w = Window.partitionBy("doc_id")
        x = x.withColumn("_mp", F.max("pos").over(w)).where(F.col("pos") == F.col("_mp")).drop("_mp")
    x = M.with_log_softmax(x, "vec", "lp").select("doc_id", "layer", "pos", "lp")
    anchors = (x.where(F.col("layer").isin(first_layer, last_layer))
                .groupBy("doc_id", "pos")
                .agg(F.max(F.when(F.col("layer") == first_layer, F.col("lp"))).alias("first_lp"),
                     F.max(F.when(F.col("layer") == last_layer, F.col("lp"))).alias("last_lp")))
    mids = x.where(F.col("layer").isin(*mid_layers))
    j = mids.join(anchors, ["doc_id", "pos"])
    kl = M.kl_from_log_probs("first_lp", "lp") + M.kl_from_log_probs("last_lp", "lp")
    return j.groupBy("doc_id", "layer").agg((F.sum(kl) / F.count("*")).alias("kl"))


def kl_in_row(df: DataFrame, vec_col: str, n_layers: int, dim: int, first_layer: int, last_layer: int,
              mid_layers: list[int], id_col: str = "doc_id") -> DataFrame:
    """A13/A28 for vectors stored as one ``[L*dim]`` array of one position:
    log-softmax of every layer and both KL terms inside the row, so only
    (doc_id, layer, kl) leaves it and nothing is shuffled."""
    v = F.col(vec_col).cast("array<double>")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_layers - 1)), lambda k: F.slice(v, k * dim + 1, dim))
    x = df.select(F.col(id_col).alias("doc_id"), F.when(F.size(v) >= n_layers * dim, cut).otherwise(
        F.raise_error(F.lit(f"vector shorter than {n_layers} x {dim}"))).alias("_l"))
    tops = F.transform("_l", lambda a: F.struct(a.alias("a"), F.array_max(a).alias("m")))
    sums = F.transform(tops, lambda s: F.struct(s["a"].alias("a"), (s["m"] + F.ln(F.aggregate(
        s["a"], F.lit(0.0), lambda acc, e: acc + F.exp(e - s["m"])))).alias("z")))
    x = x.select("doc_id", F.transform(sums, lambda s: F.transform(s["a"], lambda e: e - s["z"])).alias("_lp"))
    first, last = F.get("_lp", F.lit(first_layer)), F.get("_lp", F.lit(last_layer))
    kls = F.transform(F.array(*[F.lit(k) for k in mid_layers]), lambda k: F.struct(k.alias("layer"), (
        M.kl_from_log_probs(first, F.get("_lp", k)) + M.kl_from_log_probs(last, F.get("_lp", k))).alias("kl")))
    return x.select("doc_id", F.inline(kls))


def best_layer(kl: DataFrame, digits: int = 10) -> DataFrame:
    """Layer of the largest KL per document, first maximum wins.  KL
    is rounded to ``digits`` before comparing so near-ties decide the same
    way whatever engine summed the terms."""
    key = F.struct(F.round("kl", digits), -F.col("layer"))
    return kl.groupBy("doc_id").agg(F.max_by("layer", key).alias("best_layer"),
                                    F.max("kl").alias("max_kl"))


def select_layer(long: DataFrame, mode: int, kl: DataFrame | None = None) -> DataFrame:
    """``mode >= 0`` picks that layer for every document (P14);
    ``mode == -1`` picks each document's max-KL layer (J2: equi-join on
    (doc_id, layer), no per-row Python)."""
    if mode >= 0:
        return layer_projection(long, mode)
    if kl is None:
        raise ValueError("max-KL mode needs the KL table")
    best = best_layer(kl).select("doc_id", F.col("best_layer").alias("layer"))
    return long.join(best, ["doc_id", "layer"])


def project_logits(hidden: DataFrame, weight, vec_col: str = "vec", out: str = "logits") -> DataFrame:
    """M8: logits = hidden @ W for a (dim x vocab) weight matrix, as an
    Arrow-batched pandas UDF (numpy matmul per batch).  The weight is
    shipped once per executor through a broadcast variable; its size is
    dim x vocab, fixed by the model, not by the data."""
    w = np.asarray(weight, dtype="float64")
    bw = hidden.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("array<double>")
    def _matmul(v: pd.Series) -> pd.Series:
        mat = np.stack(v.to_numpy()) if len(v) else np.zeros((0, bw.value.shape[0]))
        return pd.Series(list(mat @ bw.value))

    return hidden.withColumn(out, _matmul(F.col(vec_col).cast("array<double>")))


def concat_layers(long: DataFrame, out: str = "vec") -> DataFrame:
    """The long layout back to one ``[L*dim]`` vector per (doc, pos):
    layers in order, concatenated.  One group per (doc, pos) holds that
    document position's L layers only."""
    g = long.groupBy("doc_id", "pos").agg(F.sort_array(F.collect_list(F.struct("layer", "vec"))).alias("_l"))
    return g.select("doc_id", "pos", F.flatten(F.transform("_l", lambda s: s["vec"])).alias(out))
