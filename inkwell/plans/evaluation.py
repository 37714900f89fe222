"""Evaluation queries (A17-A23, W3) over labelled documents.

The detector under test here is the simplest one the reference studies:
text length (``split(' ')`` words, E1) as the machine score.  Groups are
language (``dataset``) and source (``generator``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import evaluate as ev
from inkwell.plans.registry import register
from inkwell.plans.sqlfrag import LABELLED_DOCS, auroc_sql, space_word_count
from inkwell.sources.tables import labelled_documents


def length_scored(spark, sf_dir):
    d = labelled_documents(spark, sf_dir)
    return d.select("doc_id", "lang", "source", F.col("result").alias("label"),
                    T.space_word_count("text").cast("double").alias("score"))


_SCORED_SQL = f"""(SELECT doc_id, lang, source, result AS label,
        CAST({space_word_count('text')} AS DOUBLE) AS score FROM {LABELLED_DOCS})"""


def a18_auroc_by_lang(spark, sf_dir):
    return ev.auroc(length_scored(spark, sf_dir), "lang", digits=6)


register("a18_auroc_by_lang", auroc_sql(_SCORED_SQL, ["lang"]))(a18_auroc_by_lang)


@register("a18_auroc_by_lang_source", auroc_sql(_SCORED_SQL, ["lang", "source"]))
def a18_auroc_by_lang_source(spark, sf_dir):
    return ev.auroc(length_scored(spark, sf_dir), ["lang", "source"], digits=6)


@register("a17_roc_curve_by_lang", f"""
WITH a AS (SELECT lang, score, SUM(label) AS npos, SUM(1 - label) AS nneg
           FROM {_SCORED_SQL} GROUP BY lang, score),
c AS (SELECT *, SUM(npos) OVER w AS tp, SUM(nneg) OVER w AS fp,
             ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC) - 1 AS idx,
             LEAD(npos) OVER (PARTITION BY lang ORDER BY score DESC) AS next_npos,
             LEAD(nneg) OVER (PARTITION BY lang ORDER BY score DESC) AS next_nneg,
             SUM(npos) OVER (PARTITION BY lang) AS P, SUM(nneg) OVER (PARTITION BY lang) AS N
      FROM a WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM c WHERE idx = 0 OR next_npos IS NULL OR NOT (next_npos = npos AND next_nneg = nneg))
SELECT lang, CAST(NULL AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr, CAST(0 AS BIGINT) AS point
FROM c WHERE idx = 0
UNION ALL
SELECT lang, score AS threshold, ROUND(CASE WHEN N > 0 THEN fp / N END, 6) AS fpr,
       ROUND(CASE WHEN P > 0 THEN tp / P END, 6) AS tpr, CAST(idx + 1 AS BIGINT) AS point FROM k""")
def a17_roc_curve_by_lang(spark, sf_dir):
    c = ev.roc_curve(length_scored(spark, sf_dir), "lang")
    return c.select("lang", "threshold", F.round("fpr", 6).alias("fpr"),
                    F.round("tpr", 6).alias("tpr"), "point")


@register("a19_pr_curve_by_lang", f"""
WITH a AS (SELECT lang, score, SUM(label) AS npos, SUM(1 - label) AS nneg
           FROM {_SCORED_SQL} GROUP BY lang, score),
c AS (SELECT *, SUM(npos) OVER w AS tp, SUM(nneg) OVER w AS fp,
             ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC) - 1 AS idx,
             SUM(npos) OVER (PARTITION BY lang) AS P
      FROM a WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT lang, CAST(NULL AS DOUBLE) AS threshold, 1.0 AS precision, 0.0 AS recall FROM c WHERE idx = 0
UNION ALL
SELECT lang, score AS threshold, ROUND(tp / (tp + fp), 6) AS precision,
       ROUND(CASE WHEN P > 0 THEN tp / P ELSE 1.0 END, 6) AS recall FROM c""")
def a19_pr_curve_by_lang(spark, sf_dir):
    c = ev.pr_curve(length_scored(spark, sf_dir), "lang")
    return c.select("lang", "threshold", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"))


@register("a20_pr_auc_by_lang", f"""
WITH a AS (SELECT lang, score, SUM(label) AS npos, SUM(1 - label) AS nneg
           FROM {_SCORED_SQL} GROUP BY lang, score),
c AS (SELECT *, SUM(npos) OVER w AS tp, SUM(nneg) OVER w AS fp,
             SUM(npos) OVER (PARTITION BY lang) AS P
      FROM a WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
s AS (SELECT lang, P, npos / P * (tp / (tp + fp)
          + CASE WHEN tp - npos + fp - nneg = 0 THEN 1.0
                 ELSE (tp - npos) / (tp - npos + fp - nneg) END) / 2.0 AS seg FROM c WHERE P > 0)
SELECT l.lang, ROUND(s2.pr_auc, 6) AS pr_auc, ROUND(1 - s2.pr_auc, 6) AS loss
FROM (SELECT DISTINCT lang FROM c) l
LEFT JOIN (SELECT lang, SUM(seg) AS pr_auc FROM s GROUP BY lang) s2 ON l.lang = s2.lang""")
def a20_pr_auc_by_lang(spark, sf_dir):
    r = ev.pr_auc(length_scored(spark, sf_dir), "lang")
    return r.select("lang", F.round("pr_auc", 6).alias("pr_auc"), F.round("loss", 6).alias("loss"))


@register("a22_macro_auroc_by_source", f"""
WITH cells AS ({auroc_sql(_SCORED_SQL, ["lang", "source"])}),
fam AS (SELECT DISTINCT source FROM documents)
SELECT fam.source, ROUND(AVG(cells.auroc), 6) AS mean_auroc, CAST(COUNT(cells.auroc) AS BIGINT) AS n_cells
FROM fam LEFT JOIN cells ON fam.source = cells.source GROUP BY fam.source""")
def a22_macro_auroc_by_source(spark, sf_dir):
    cells = ev.auroc(length_scored(spark, sf_dir), ["lang", "source"])
    fams = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
    r = ev.macro_mean(cells, fams, "source")
    return r.select("source", F.round("mean_auroc", 6).alias("mean_auroc"), "n_cells")


# Generator names of the fixture: the number in ``source`` picks one.
NAMES = ["GPT3-davinci", "ChatGPT", "GPT4-turbo", "claude-instant", "gpt-3.5-turbo-0125", "other-model"]
_NAME_SQL = "CASE CAST(substr(source, 4) AS INTEGER) % 6 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
_FAMILY_SQL = f"""CASE WHEN lower({_NAME_SQL}) LIKE '%gpt3%' OR lower({_NAME_SQL}) LIKE '%chatgpt%' THEN 'gpt3.5'
  WHEN lower({_NAME_SQL}) LIKE '%gpt4%' THEN 'gpt4' WHEN lower({_NAME_SQL}) LIKE '%claude%' THEN 'claude3'
  WHEN lang = 'es' THEN 'counseling' WHEN lower({_NAME_SQL}) LIKE '%gpt-3.5-turbo%' THEN 'gpt-3.5-turbo'
  WHEN lower({_NAME_SQL}) LIKE '%gpt-4%' THEN 'gpt-4' END"""


@register("a22_macro_auroc_by_family", f"""
WITH cells AS (SELECT x.*, {_FAMILY_SQL} AS family FROM ({auroc_sql(_SCORED_SQL, ["lang", "source"])}) x),
fam AS (SELECT UNNEST({T.FAMILIES["wide"]!r}) AS family)
SELECT fam.family, ROUND(AVG(cells.auroc), 6) AS mean_auroc, CAST(COUNT(cells.auroc) AS BIGINT) AS n_cells
FROM fam LEFT JOIN cells ON fam.family = cells.family GROUP BY fam.family""")
def a22_macro_auroc_by_family(spark, sf_dir):
    """P18 + E20 + A22: cells rolled up by generator family, the wide
    variant with ``es`` standing for the counselling data."""
    number = F.substring("source", 4, 9).cast("int") % len(NAMES)
    cells = ev.auroc(length_scored(spark, sf_dir), ["lang", "source"])
    cells = cells.withColumn("name", F.get(F.array(*[F.lit(n) for n in NAMES]), number))
    dataset = F.when(F.col("lang") == "es", F.lit("counseling")).otherwise(F.col("lang"))
    cells = cells.withColumn("family", T.generator_family("name", "wide", dataset)).where("family is not null")
    fams = spark.createDataFrame([(x,) for x in T.FAMILIES["wide"]], "family string")
    r = ev.macro_mean(cells, fams, "family")
    return r.select("family", F.round("mean_auroc", 6).alias("mean_auroc"), "n_cells")


@register("a23_score_stats_by_class", f"""
SELECT lang, label, ROUND(AVG(score), 6) AS mean, ROUND(STDDEV_POP(score), 6) AS std,
       CAST(COUNT(score) AS BIGINT) AS n
FROM {_SCORED_SQL} GROUP BY lang, label""")
def a23_score_stats_by_class(spark, sf_dir):
    r = ev.class_stats(length_scored(spark, sf_dir), "lang")
    return r.select("lang", "label", F.round("mean", 6).alias("mean"),
                    F.round("std", 6).alias("std"), "n")


# Accuracy of the reference's long-text rule (> 250 words = machine).
@register("a21_length_rule_accuracy", f"""
SELECT lang, ROUND(AVG(CASE WHEN (CASE WHEN score > 250 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 6)
         AS accuracy, CAST(COUNT(*) AS BIGINT) AS n
FROM {_SCORED_SQL} GROUP BY lang""")
def a21_length_rule_accuracy(spark, sf_dir):
    s = length_scored(spark, sf_dir).withColumn("pred", (F.col("score") > 250).cast("int"))
    r = ev.accuracy(s, "lang")
    return r.select("lang", F.round("accuracy", 6).alias("accuracy"), "n")


SELECTED_LANGS = ["en", "es"]
_SEL_SQL = f"(SELECT * FROM {_SCORED_SQL} WHERE lang IN ({', '.join(repr(x) for x in SELECTED_LANGS)}))"


@register("p20_auroc_selected_languages", auroc_sql(_SEL_SQL, ["lang"]))
def p20_auroc_selected_languages(spark, sf_dir):
    """P20 + E24: restrict to chosen languages (validated against the
    supported language codes); the filter reaches the parquet scan."""
    bad = [x for x in SELECTED_LANGS if x not in T.LANGUAGES]
    if bad:
        raise ValueError(f"unsupported language codes {bad}")
    s = length_scored(spark, sf_dir).where(F.col("lang").isin(*SELECTED_LANGS))
    return ev.auroc(s, "lang", digits=6)
