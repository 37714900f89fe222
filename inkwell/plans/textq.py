"""String-function queries (E1-E8, E14-E17, E22-E23, P6, P11) over the
whole document and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import pair as PR
from inkwell.plans.registry import register
from inkwell.plans.sqlfrag import (detokenise, fold, reduce_words_sql, remove_tags,
                                  space_word_count, strip, word_count, words)
from inkwell.session import table

REDUCE_MAX_WORDS = 150


@register("e_text_normalisation", f"""
SELECT doc_id,
       {space_word_count('text')} AS n_space_words,
       {word_count('text')} AS n_words,
       md5({strip('text')}) AS strip_md5,
       md5({fold('text')}) AS fold_md5,
       md5(translate(text, chr(160) || chr(10), '  ')) AS e5_md5,
       md5(array_to_string({words('text')}[1:30], ' ')) AS prompt30_md5,
       md5(array_to_string(string_split(text, ' ')[1:len(string_split(text, ' ')) - 1], ' ')) AS drop_last_md5,
       CAST(len({words('text')}[1:300]) AS BIGINT) AS n_tokens_300,
       {strip('text')} = '' AS is_blank
FROM documents""")
def e_text_normalisation(spark, sf_dir):
    # The word list is computed once per row and reused by every column
    # (lambda-based expressions are not merged by subexpression elimination).
    d = table(spark, sf_dir, "documents").select("doc_id", "text", T.words("text").alias("_w"))
    return d.select(
        "doc_id",
        T.space_word_count("text").alias("n_space_words"),
        F.size("_w").cast("bigint").alias("n_words"),
        F.md5(T.py_strip("text")).alias("strip_md5"),
        F.md5(F.array_join("_w", " ")).alias("fold_md5"),
        F.md5(T.nbsp_newline_to_space("text")).alias("e5_md5"),
        F.md5(F.array_join(F.slice("_w", 1, 30), " ")).alias("prompt30_md5"),
        F.md5(T.drop_last_word("text")).alias("drop_last_md5"),
        F.size(F.slice("_w", 1, 300)).cast("bigint").alias("n_tokens_300"),
        T.is_blank("text").alias("is_blank"))


_STORY_SQL = """(SELECT u.conv_id * 100 + u.turn AS pair_id,
        '[ WP ] ' || replace(u.text, chr(10), ' ') AS prompt,
        replace(replace(replace(a.text, ',', ' ,'), '.', ' .'), chr(10), ' <newline> ') AS story
 FROM conversations u JOIN conversations a
   ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
 WHERE u.role = 'user')"""


def writing_stories(spark, sf_dir):
    """F17 derived from the conversations: a tagged one-line prompt and a
    story in tokenised form (space before ',' and '.', ``<newline>``)."""
    pairs = PR.turn_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select(
        "pair_id",
        F.concat(F.lit("[ WP ] "), F.replace("original", F.lit("\n"), F.lit(" "))).alias("prompt"),
        F.replace(F.replace(F.replace("sampled", F.lit(","), F.lit(" ,")), F.lit("."), F.lit(" .")),
                  F.lit("\n"), F.lit(" <newline> ")).alias("story"))


@register("e7_detokenised_stories", f"""
WITH s AS (SELECT pair_id, {detokenise("(" + remove_tags('prompt') + " || ' ' || story)")} AS text FROM {_STORY_SQL})
SELECT pair_id, md5(text) AS text_md5, {word_count('text')} AS n_words FROM s
WHERE NOT contains(text, 'nsfw') AND NOT contains(text, 'NSFW')""")
def e7_detokenised_stories(spark, sf_dir):
    s = writing_stories(spark, sf_dir).select("pair_id", T.prompt_story("prompt", "story").alias("text"))
    s = s.where(~F.col("text").contains("nsfw") & ~F.col("text").contains("NSFW"))  # P11
    return s.select("pair_id", F.md5("text").alias("text_md5"), T.word_count("text").alias("n_words"))


@register("e14_reduce_words", f"""
WITH {reduce_words_sql('documents', 'doc_id', 'text', REDUCE_MAX_WORDS, 'r')}
SELECT id AS doc_id, md5(text) AS text_md5, {word_count('text')} AS n_words FROM r""")
def e14_reduce_words(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = d.select("doc_id", T.reduce_words("text", REDUCE_MAX_WORDS).alias("text"))
    return r.select("doc_id", F.md5("text").alias("text_md5"), T.word_count("text").alias("n_words"))


# A text that every detokenisation rule changes, put before each document.
PROBE = ("Well , it 's .. so ? yes ! on ; at : `` q '' x''y ( a ) do n't and i go and i'm \\' here <newline> z\n y "
         "she ’ s .")
BLANK = " \n\t  "


def _derived_sql() -> str:
    probe = " || ".join(f"'{p.replace(chr(39), chr(39) * 2)}'" for p in PROBE.split("\n")[:1])
    rest = PROBE.split("\n")[1].replace("'", "''")
    return (f"(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(160) || chr(10) || chr(9) || ' ' || chr(8195) "
            f"WHEN 1 THEN 'a nsfw tale ' || text WHEN 2 THEN replace(text, ' ', chr(160)) "
            f"ELSE {probe} || chr(10) || '{rest}' || ' ' || text END AS text FROM documents)")


@register("e7_p6_p11_derived_texts", f"""
SELECT doc_id, {strip('text')} = '' AS is_blank, NOT (contains(text, 'nsfw') OR contains(text, 'NSFW')) AS kept,
       md5(translate(text, chr(160) || chr(10), '  ')) AS e5_md5, md5({detokenise('text')}) AS e7_md5
FROM {_derived_sql()}""")
def e7_p6_p11_derived_texts(spark, sf_dir):
    """P6, P11, E5 and all rules of E7 on texts where they take effect:
    blank ones, flagged ones, no-break spaces, every tokenised spacing."""
    k = F.col("doc_id") % 4
    text = (F.when(k == 0, F.lit(BLANK)).when(k == 1, F.concat(F.lit("a nsfw tale "), "text"))
             .when(k == 2, F.replace("text", F.lit(" "), F.lit(" "))).otherwise(F.concat(F.lit(PROBE + " "), "text")))
    d = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return d.select("doc_id", T.is_blank("text").alias("is_blank"),
                    (~(F.col("text").contains("nsfw") | F.col("text").contains("NSFW"))).alias("kept"),
                    F.md5(T.nbsp_newline_to_space("text")).alias("e5_md5"), F.md5(T.detokenise("text")).alias("e7_md5"))


@register("e19_prefix_repair", f"""
WITH p AS (SELECT u.conv_id * 100 + u.turn AS pair_id, u.text AS original, a.text AS sampled
           FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
           WHERE u.role = 'user'),
r AS (SELECT pair_id, array_to_string({words('original')}[1:12], ' ') AS prefix, sampled FROM p),
s AS (SELECT pair_id, prefix, CASE WHEN pair_id % 3 = 0 THEN prefix || ' ' || sampled ELSE sampled END AS reply FROM r)
SELECT pair_id, starts_with(reply, prefix[1:20]) AS repeats,
       md5(CASE WHEN starts_with(reply, prefix[1:20]) THEN reply ELSE prefix || ' ' || reply END) AS reply_md5 FROM s""")
def e19_prefix_repair(spark, sf_dir):
    """E19 with replies that repeat their prefix (every third pair) and
    replies that do not."""
    p = PR.turn_pairs(table(spark, sf_dir, "conversations"))
    p = p.select("pair_id", T.first_words("original", 12).alias("prefix"), "sampled")
    p = p.withColumn("reply", F.when(F.col("pair_id") % 3 == 0, F.concat("prefix", F.lit(" "), "sampled"))
                     .otherwise(F.col("sampled")))
    return p.select("pair_id", F.startswith("reply", F.substring("prefix", 1, 20)).alias("repeats"),
                    F.md5(T.prefix_repair("reply", "prefix")).alias("reply_md5"))


@register("e21_path_keys", """
SELECT doc_id, lang IN ('en', 'de', 'es') AND doc_id % 2 = 0 AS multilingual,
       CASE WHEN doc_id % 2 = 0 THEN 'multi' ELSE 'xsum' END AS dataset, source AS generator,
       CASE WHEN doc_id % 2 = 0 AND lang IN ('en', 'de', 'es') THEN lang END AS language FROM documents""")
def e21_path_keys(spark, sf_dir):
    """Dataset, generator and language out of file names of both
    layouts (a language folder or none; codes outside the list are not one)."""
    d = table(spark, sf_dir, "documents")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data/test/"), "lang", F.lit("/multi_"), "source", F.lit(".json"))
                  ).otherwise(F.concat(F.lit("exp/data/xsum_"), "source", F.lit(".raw_data.json")))
    x = d.select("doc_id", T.path_key(path).alias("k"))
    return x.select("doc_id", F.col("k.language").isNotNull().alias("multilingual"), "k.dataset", "k.generator", "k.language")
