"""Evaluation.

Exact ROC / precision-recall / AUROC with ties, computed from cumulative
true/false positive counts over *distinct* scores (W3).

Scale design.  A window ``partitionBy(group).orderBy(score)`` would put a
whole group in one task; one generator may hold a third of all rows, so
the running sums are built in two passes instead:

1. pre-aggregate to one row per (group, distinct score) (map-side combine);
2. range-partition that table by (group, score) and tag each row with its
   partition id: ids are monotone in (group, score), so each id is a
   contiguous score interval ("bucket");
3. the bucketed table is checkpointed to the shared checkpoint folder, so
   both of its consumers see the same buckets and a lost executor never
   re-samples the range bounds;
4. per-bucket totals (at most ``buckets + groups`` rows) give each bucket's
   offset with a window over that small table;
5. running sums inside each bucket (a window on (group, bucket): one
   bucket per task) plus the offset give the exact group-wide sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.ordering import rank_within
from inkwell.session import checkpoint_root


def _cols(group_cols) -> list[str]:
    if group_cols is None:
        return []
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how="inner") -> DataFrame:
    from inkwell.operators.ordering import _eq_join
    return _eq_join(left, right, keys, how)


def score_counts(df: DataFrame, group_cols, score: str = "score",
                 label: str = "label") -> DataFrame:
    """One row per (group, distinct score) with positive/negative counts.
    Rows with a null score or a label other than 0/1 are ignored (the
    reference's label split drops other labels silently)."""
    g = _cols(group_cols)
    lab = F.col(label).cast("int")
    return (df.where(F.col(score).isNotNull() & lab.isin(0, 1))
              .groupBy(*g, F.col(score).cast("double").alias("score"))
              .agg(F.sum((lab == 1).cast("long")).alias("npos"),
                   F.sum((lab == 0).cast("long")).alias("nneg")))


def cumulative_counts(counts: DataFrame, group_cols, buckets: int | None = None) -> DataFrame:
    """Add ``tp``/``fp`` = positives/negatives with score >= this score
    in the group, the group totals ``P``/``N``, and ``idx`` = 0-based
    position of the score in descending order, plus ``next_npos`` /
    ``next_nneg`` = counts at the next lower distinct score (null at the
    end).  Input: output of :func:`score_counts`."""
    g = _cols(group_cols)
    spark = counts.sparkSession
    checkpoint_root(spark)
    keys = [*[F.col(c) for c in g], F.col("score").desc()]
    # Without an explicit count AQE may merge adjacent ranges on small
    # inputs; merged ranges are still contiguous, so ids stay monotone.
    ranged = counts.repartitionByRange(buckets, *keys) if buckets else counts.repartitionByRange(*keys)
    bucketed = (ranged
                      .withColumn("_b", F.spark_partition_id())
                      .checkpoint(eager=True))

    top = F.struct(F.col("npos"), F.col("nneg"))
    tot = bucketed.groupBy(*g, "_b").agg(
        F.sum("npos").alias("_bp"), F.sum("nneg").alias("_bn"), F.count("*").alias("_bc"),
        F.max_by(top, F.col("score")).alias("_top"))
    wg = Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))
    before = wg.orderBy(F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
    tot = (tot.withColumn("_op", F.coalesce(F.sum("_bp").over(before), F.lit(0)))
              .withColumn("_on", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
              .withColumn("_oc", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
              .withColumn("P", F.sum("_bp").over(wg))
              .withColumn("N", F.sum("_bn").over(wg))
              .withColumn("_next_top", F.lead("_top").over(wg.orderBy("_b")))
              .drop("_top", "_bp", "_bn", "_bc"))

    local = Window.partitionBy(*g, "_b").orderBy(F.col("score").desc())
    run = local.rowsBetween(Window.unboundedPreceding, 0)
    rows = (bucketed
            .withColumn("_lp", F.sum("npos").over(run))
            .withColumn("_ln", F.sum("nneg").over(run))
            .withColumn("_lc", F.row_number().over(local))
            .withColumn("_nxt", F.lead(top).over(local)))
    out = _null_safe_join(rows, tot, [*g, "_b"])
    nxt = F.coalesce(F.col("_nxt"), F.col("_next_top"))
    return out.select(
        *g, "score", "npos", "nneg",
        (F.col("_op") + F.col("_lp")).alias("tp"),
        (F.col("_on") + F.col("_ln")).alias("fp"),
        (F.col("_oc") + F.col("_lc") - 1).alias("idx"),
        "P", "N",
        nxt["npos"].alias("next_npos"), nxt["nneg"].alias("next_nneg"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def auroc(df: DataFrame, group_cols=None, score: str = "score", label: str = "label",
          digits: int | None = None, buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve per group, ties counted half.
    Null when a group lacks one of the classes (ANSI-safe)."""
    g = _cols(group_cols)
    cum = cumulative_counts(score_counts(df, g, score, label), g, buckets)
    area = F.sum(F.col("nneg") * (F.col("tp") - F.col("npos") / 2.0))
    res = cum.groupBy(*g).agg(
        _safe_div(area, F.max("P") * F.max("N")).alias("auroc"),
        F.max("P").cast("bigint").alias("n_pos"),
        F.max("N").cast("bigint").alias("n_neg"))
    res = res.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("auroc")))
    if digits is not None:
        res = res.withColumn("auroc", F.round("auroc", digits))
    return res


def roc_curve(df: DataFrame, group_cols=None, score: str = "score", label: str = "label",
              drop_intermediate: bool = True, buckets: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) points in descending threshold order, with
    the (0, 0) start (threshold null).  As in the reference's curve, points
    collinear with both neighbours are dropped (``drop_intermediate``);
    the first and last points are always kept."""
    g = _cols(group_cols)
    cum = cumulative_counts(score_counts(df, g, score, label), g, buckets)
    if drop_intermediate:
        same_next = (F.col("next_npos") == F.col("npos")) & (F.col("next_nneg") == F.col("nneg"))
        cum = cum.where((F.col("idx") == 0) | F.col("next_npos").isNull() | ~same_next)
    pts = cum.select(*g, F.col("score").alias("threshold"),
                     _safe_div(F.col("fp"), F.col("N")).alias("fpr"),
                     _safe_div(F.col("tp"), F.col("P")).alias("tpr"),
                     (F.col("idx") + 1).alias("point"))
    start = cum.where(F.col("idx") == 0).select(
        *g, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"), F.lit(0).cast("bigint").alias("point"))
    return start.unionByName(pts)


def thinned_roc(df: DataFrame, group_cols=None, score: str = "score", label: str = "label",
                buckets: int | None = None) -> DataFrame:
    """A17 with every point dropped that lies on the straight line between
    its neighbours, looking one step back (the point's own counts) and one
    ahead (the next score's): runs of any slope shrink to their ends, and the
    area under the curve stays the same number.  Rows (group, ``k`` from 0,
    threshold, fp, tp, P, N); row 0 is the start, with threshold null."""
    g = _cols(group_cols)
    cum = cumulative_counts(score_counts(df, g, score, label), g, buckets)
    bend = F.col("npos") * F.col("next_nneg") != F.col("nneg") * F.col("next_npos")
    kept = cum.where(F.col("next_npos").isNull() | bend)
    kept = rank_within(kept, g, [F.desc("score")], "k").select(
        *g, "k", F.col("score").alias("threshold"), "fp", "tp", "P", "N")
    zero = F.lit(0).cast("bigint")
    start = kept.where("k = 1").select(*g, zero.alias("k"), F.lit(None).cast("double").alias("threshold"),
                                       zero.alias("fp"), zero.alias("tp"), "P", "N")
    return start.unionByName(kept)


def curve_area(points: DataFrame, group_cols=None) -> DataFrame:
    """The area under :func:`thinned_roc` curves by trapezoids; neighbours
    meet by their number (an equi-join, so a long curve is not one task's)."""
    g = _cols(group_cols)
    before = points.select(*g, (F.col("k") + 1).alias("k"), F.col("fp").alias("_fp"), F.col("tp").alias("_tp"))
    x = _null_safe_join(points, before, [*g, "k"])
    area = F.sum((F.col("fp") - F.col("_fp")) * (F.col("tp") + F.col("_tp")))
    return x.groupBy(*g).agg(_safe_div(area, 2 * F.max("P") * F.max("N")).alias("area"), F.count("*").alias("n_points"))


def pr_curve(df: DataFrame, group_cols=None, score: str = "score", label: str = "label",
             buckets: int | None = None) -> DataFrame:
    """(threshold, precision, recall) per distinct threshold and the
    end anchor (recall 0, precision 1, threshold null)."""
    g = _cols(group_cols)
    cum = cumulative_counts(score_counts(df, g, score, label), g, buckets)
    pts = cum.select(*g, F.col("score").alias("threshold"),
                     _safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                     F.when(F.col("P") > 0, _safe_div(F.col("tp"), F.col("P")))
                      .otherwise(F.lit(1.0)).alias("recall"))
    anchor = cum.where(F.col("idx") == 0).select(
        *g, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return anchor.unionByName(pts)


def pr_auc(df: DataFrame, group_cols=None, score: str = "score", label: str = "label",
           buckets: int | None = None) -> DataFrame:
    """Trapezoid area under the PR curve (anchored at recall 0,
    precision 1) and ``loss = 1 - pr_auc``; null without positives."""
    g = _cols(group_cols)
    cum = cumulative_counts(score_counts(df, g, score, label), g, buckets)
    tp_prev = F.col("tp") - F.col("npos")
    fp_prev = F.col("fp") - F.col("nneg")
    p_here = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    p_prev = F.when(tp_prev + fp_prev == 0, F.lit(1.0)).otherwise(_safe_div(tp_prev, tp_prev + fp_prev))
    seg = _safe_div(F.col("npos"), F.col("P")) * (p_here + p_prev) / 2.0
    res = cum.groupBy(*g).agg(F.sum(seg).alias("pr_auc"), F.max("P").alias("_P"))
    res = res.withColumn("pr_auc", F.when(F.col("_P") > 0, F.col("pr_auc"))).drop("_P")
    return res.withColumn("loss", 1.0 - F.col("pr_auc"))


def class_stats(df: DataFrame, group_cols=None, score: str = "score", label: str = "label") -> DataFrame:
    """Mean and population std of the score per class."""
    g = _cols(group_cols)
    return df.groupBy(*g, F.col(label).alias("label")).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"),
        F.count(score).alias("n"))


def accuracy(df: DataFrame, group_cols=None, pred: str = "pred", label: str = "label") -> DataFrame:
    """Share of rows whose predicted class equals the label."""
    g = _cols(group_cols)
    return df.groupBy(*g).agg(
        F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"),
        F.count("*").alias("n"))


def cross_entropy(df: DataFrame, group_cols=None, prob_pos: str = "prob", label: str = "label") -> DataFrame:
    """Mean ``-ln p(label)`` for a two-class probability column."""
    g = _cols(group_cols)
    p_label = F.when(F.col(label) == 1, F.col(prob_pos)).otherwise(1.0 - F.col(prob_pos))
    return df.groupBy(*g).agg(F.avg(-F.ln(p_label)).alias("loss"))


def macro_mean(cells: DataFrame, families: DataFrame, family_col: str, value: str = "auroc") -> DataFrame:
    """Unweighted mean of per-cell values by family; a family with no
    cell (or only null cells) reports null.  ``families`` lists every
    family to report, so empty ones survive the left join."""
    return (families.join(cells, family_col, "left")
                    .groupBy(family_col).agg(F.avg(value).alias(f"mean_{value}"),
                                             F.count(value).alias("n_cells")))


def roc_pr_summary(df: DataFrame, group_cols=None, score: str = "score", label: str = "label",
                   buckets: int | None = None) -> DataFrame:
    """A18 + A20 from one cumulative pass: ``auroc``, ``pr_auc``, ``loss``
    (= 1 - pr_auc) and the class counts per group."""
    g = _cols(group_cols)
    cum = cumulative_counts(score_counts(df, g, score, label), g, buckets)
    tp_prev = F.col("tp") - F.col("npos")
    fp_prev = F.col("fp") - F.col("nneg")
    p_here = _safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    p_prev = F.when(tp_prev + fp_prev == 0, F.lit(1.0)).otherwise(_safe_div(tp_prev, tp_prev + fp_prev))
    res = cum.groupBy(*g).agg(
        F.sum(F.col("nneg") * (F.col("tp") - F.col("npos") / 2.0)).alias("_area"),
        F.sum(_safe_div(F.col("npos"), F.col("P")) * (p_here + p_prev) / 2.0).alias("_pr"),
        F.max("P").cast("bigint").alias("n_pos"), F.max("N").cast("bigint").alias("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return res.select(
        *g, F.when(both, _safe_div(F.col("_area"), F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        F.when(F.col("n_pos") > 0, F.col("_pr")).alias("pr_auc"),
        F.when(F.col("n_pos") > 0, 1.0 - F.col("_pr")).alias("loss"), "n_pos", "n_neg")
