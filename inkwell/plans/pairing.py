"""Pairing queries: J6 pairs, X13 pair sampling (xsum-style and pubmed-
style), E15 word-budget truncation with perturbations and A5 means."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import curate as C
from inkwell.operators import pair as PR
from inkwell.plans.registry import register
from inkwell.plans.sqlfrag import reduce_words_sql, sql_str, word_count, words
from inkwell.session import table

PAIRS_SQL = """(SELECT u.conv_id * 100 + u.turn AS pair_id, u.text AS original, a.text AS sampled
 FROM conversations u JOIN conversations a
   ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 WHERE u.role = 'user')"""

TRUNC_MAX_WORDS = 50


def pairs(spark, sf_dir):
    return PR.turn_pairs(table(spark, sf_dir, "conversations"))


@register("j6_turn_pairs", f"""
SELECT pair_id, md5(original) AS original_md5, md5(sampled) AS sampled_md5,
       {word_count('original')} AS original_words, {word_count('sampled')} AS sampled_words
FROM {PAIRS_SQL}""")
def j6_turn_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select(
        "pair_id", F.md5("original").alias("original_md5"), F.md5("sampled").alias("sampled_md5"),
        T.word_count("original").alias("original_words"), T.word_count("sampled").alias("sampled_words"))


def _trim_sql(o: str, s: str) -> str:
    lo = f"len(string_split({o}, ' '))"
    ls = f"len(string_split({s}, ' '))"
    n = f"LEAST({lo}, {ls})"
    return (f"array_to_string(string_split({o}, ' ')[1:{n}], ' ')",
            f"array_to_string(string_split({s}, ' ')[1:{n}], ' ')")


_O_X, _S_X = _trim_sql("original", "s")


@register("x13_pair_sampling_xsum", f"""
WITH q AS (SELECT pair_id, original, sampled AS reply,
                  array_to_string({words('original')}[1:30], ' ') AS prefix FROM {PAIRS_SQL}),
r AS (SELECT *, CASE WHEN starts_with(reply, substring(prefix, 1, 20)) THEN reply
                     ELSE prefix || ' ' || reply END AS s,
             {sql_str(PR.CHAT_PROMPTS['xsum'] + ' ')} ||
               array_to_string(string_split(prefix, ' ')[1:len(string_split(prefix, ' ')) - 1], ' ') AS user_msg
      FROM q)
SELECT pair_id, {word_count('s')} >= 55 AS accepted, md5({_O_X}) AS original_md5, md5({_S_X}) AS sampled_md5,
       md5(user_msg) AS prompt_md5
FROM r""")
def x13_pair_sampling_xsum(spark, sf_dir):
    p = pairs(spark, sf_dir).withColumn("prefix", PR.prompt_prefix(F.col("original"), "xsum"))
    p = p.withColumn("messages", PR.chat_prompt("xsum", F.col("prefix")))
    out = PR.finish_pairs(p.withColumnRenamed("sampled", "reply"), "xsum")
    return out.select("pair_id", "accepted", F.md5("original_out").alias("original_md5"),
                      F.md5("sampled_out").alias("sampled_md5"),
                      F.md5(F.col("messages")[1]["content"]).alias("prompt_md5"))


_O_P, _S_P = _trim_sql("o", "s")


@register("x13_pair_sampling_pubmed", f"""
WITH q AS (SELECT pair_id, 'Question: ' || original || ' Answer:<<<SEP>>>' || sampled AS qa,
                  sampled || ' Question: ' || original || ' Question: ' || sampled AS reply FROM {PAIRS_SQL}),
p AS (SELECT *, split_part(qa, '<<<SEP>>>', 1) AS prefix FROM q),
r AS (SELECT *, CASE WHEN starts_with(reply, substring(prefix, 1, 20)) THEN reply
                     ELSE prefix || ' ' || reply END AS s0,
             replace(qa, '<<<SEP>>>', ' ') AS o FROM p),
t AS (SELECT *, CASE WHEN len(string_split(s0, 'Question:')) - 1 >= 2
                     THEN array_to_string(string_split(s0, 'Question:')[1:2], 'Question:') ELSE s0 END AS s FROM r)
SELECT pair_id, {word_count('s')} >= 30 AS accepted, md5({_O_P}) AS original_md5, md5({_S_P}) AS sampled_md5,
       md5(prefix) AS prompt_md5
FROM t""")
def x13_pair_sampling_pubmed(spark, sf_dir):
    p = pairs(spark, sf_dir)
    p = p.select("pair_id", T.qa_template("original", "sampled").alias("original"),
                 F.concat_ws(" Question: ", "sampled", "original", "sampled").alias("reply"))
    p = p.withColumn("prefix", PR.prompt_prefix(F.col("original"), "pubmed"))
    out = PR.finish_pairs(p, "pubmed")
    return out.select("pair_id", "accepted", F.md5("original_out").alias("original_md5"),
                      F.md5("sampled_out").alias("sampled_md5"), F.md5("prefix").alias("prompt_md5"))


def _pert_sql(t: str, i: int) -> str:
    w = words(t)
    return f"array_to_string(list_concat({w}[1:{i - 1}], {w}[{i + 1}:]), ' ')"


@register("e15_truncated_pairs_a5", f"""
WITH p AS {PAIRS_SQL},
v AS (SELECT pair_id * 10 + 0 AS id, original AS text FROM p
      UNION ALL SELECT pair_id * 10 + 1, sampled FROM p
      UNION ALL SELECT pair_id * 10 + 2, {_pert_sql('original', 1)} FROM p
      UNION ALL SELECT pair_id * 10 + 3, {_pert_sql('original', 2)} FROM p
      UNION ALL SELECT pair_id * 10 + 4, {_pert_sql('original', 3)} FROM p
      UNION ALL SELECT pair_id * 10 + 5, {_pert_sql('sampled', 1)} FROM p
      UNION ALL SELECT pair_id * 10 + 6, {_pert_sql('sampled', 2)} FROM p
      UNION ALL SELECT pair_id * 10 + 7, {_pert_sql('sampled', 3)} FROM p),
{reduce_words_sql('v', 'id', 'text', TRUNC_MAX_WORDS, 'r')},
n AS (SELECT id // 10 AS pair_id, id % 10 AS k, text, {word_count('text')} AS nw FROM r)
SELECT pair_id,
       MAX(CASE WHEN k = 0 THEN md5(text) END) AS original_md5,
       MAX(CASE WHEN k = 1 THEN md5(text) END) AS sampled_md5,
       MAX(CASE WHEN k = 0 THEN nw END) AS original_words,
       MAX(CASE WHEN k = 1 THEN nw END) AS sampled_words,
       ROUND(AVG(CASE WHEN k BETWEEN 2 AND 4 THEN nw END), 6) AS perturbed_original_words,
       ROUND(AVG(CASE WHEN k BETWEEN 5 AND 7 THEN nw END), 6) AS perturbed_sampled_words
FROM n GROUP BY pair_id""")
def e15_truncated_pairs_a5(spark, sf_dir):
    """F7 rows (pairs + word-dropped perturbations), E15 truncation of all
    four fields, A5 word means (nested: mean over the perturbations)."""
    p = pairs(spark, sf_dir).select(
        "pair_id", "original", "sampled",
        PR.perturbed(F.col("original")).alias("perturbed_original"),
        PR.perturbed(F.col("sampled")).alias("perturbed_sampled"))
    red = lambda c: T.reduce_words(c, TRUNC_MAX_WORDS)
    r = p.select("pair_id", red(F.col("original")).alias("original"), red(F.col("sampled")).alias("sampled"),
                 F.transform("perturbed_original", red).alias("perturbed_original"),
                 F.transform("perturbed_sampled", red).alias("perturbed_sampled"))
    return r.select(
        "pair_id", F.md5("original").alias("original_md5"), F.md5("sampled").alias("sampled_md5"),
        T.word_count("original").alias("original_words"), T.word_count("sampled").alias("sampled_words"),
        F.round(C.mean_words("perturbed_original"), 6).alias("perturbed_original_words"),
        F.round(C.mean_words("perturbed_sampled"), 6).alias("perturbed_sampled_words"))


BATCH, MIN_WORDS_XSUM = 50, 55


@register("a25_batch_quality_gate", f"""
WITH r AS (SELECT pair_id, {word_count('sampled')} AS n_words, ROW_NUMBER() OVER (ORDER BY pair_id) AS rn
           FROM {PAIRS_SQL}),
b AS (SELECT (rn - 1) // {BATCH} AS batch, n_words FROM r
      WHERE rn <= ((SELECT COUNT(*) FROM r) // {BATCH}) * {BATCH})
SELECT CAST(batch AS BIGINT) AS batch, CAST(COUNT(*) AS BIGINT) AS n, MIN(n_words) AS min_words,
       MIN(n_words) >= {MIN_WORDS_XSUM} AS accepted
FROM b GROUP BY batch""")
def a25_batch_quality_gate(spark, sf_dir):
    """O9 + A25: pairs in batches of 50 in pair order (only whole batches),
    the minimum word count of each batch's samples and the reference's
    accept rule (every sample has at least 55 words).  The pair order is an
    exact global row number built with balanced tasks."""
    from inkwell.operators.ordering import rank_within
    p = pairs(spark, sf_dir).select("pair_id", T.word_count("sampled").alias("n_words"))
    r = rank_within(p, None, ["pair_id"])
    n = r.select(F.count("*")).scalar()
    r = r.where(F.col("rn") <= F.floor(n / BATCH) * BATCH)
    b = r.groupBy(F.floor((F.col("rn") - 1) / BATCH).cast("bigint").alias("batch")).agg(
        F.count("*").alias("n"), F.min("n_words").alias("min_words"))
    return b.withColumn("accepted", F.col("min_words") >= MIN_WORDS_XSUM)
