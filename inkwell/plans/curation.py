"""Curation queries: de-duplication, corpus building, seeded sampling and
splits, length matching, leakage audit, length statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import curate as C
from inkwell.operators.ordering import top_n_by_hash
from inkwell.plans.registry import register
from inkwell.plans.sqlfrag import (LABELLED_CONV, LABELLED_DOCS, fold, frac_split_sql, md5_key,
                                  space_word_count, strip, word_count)
from inkwell.sources.tables import labelled_conversations, labelled_documents
from inkwell.session import materialize, table

# Parameters of the registered runs.  The reference's sizes (5,000 / 200 /
# 50; 500 per class; 100/75/75 per class) exceed the fixture tables, so the
# split and sample sizes here are scaled to the fixtures.
CORPUS_HEAD, CORPUS_SAMPLES, CORPUS_BATCH, TOKEN_CAP, LONG_WORDS = 5000, 200, 50, 512, 250
COUNSEL_N = 15
LANG_SPLITS = [("test", 4), ("valid", 3), ("train", 3)]
GEN_TEST_MAX = 200


@register("u2_dedupe_documents", """
SELECT d.doc_id, d.lang, d.source, md5(d.text) AS text_md5
FROM documents d JOIN (SELECT MIN(doc_id) AS doc_id FROM documents GROUP BY text) f
  ON d.doc_id = f.doc_id""")
def u2_dedupe_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return C.keep_first(d, "text", "doc_id").select("doc_id", "lang", "source",
                                                      F.md5("text").alias("text_md5"))


def corpus_builder(docs, group="lang", seed=0):
    """Dedupe -> strip -> fold -> prefer long -> seeded head -> token
    cap -> n samples -> whole batches (per dataset group)."""
    docs = docs.select("doc_id", "text", group)
    # Slim rows (id, group, word count) go through the chain; the text is
    # normalised and joined for the chosen rows only.
    d = C.keep_first(docs.withColumn("n_words", T.word_count("text")), "text", "doc_id")
    d = materialize(d.select("doc_id", group, "n_words"))
    d = C.prefer_long(d, "n_words", group, LONG_WORDS)
    d = top_n_by_hash(d, group, CORPUS_HEAD, "doc_id", seed).drop("rn")
    d = d.where(F.col("n_words") <= TOKEN_CAP)
    d = materialize(top_n_by_hash(d, group, CORPUS_SAMPLES, "doc_id", seed))
    cnt = d.groupBy(group).agg(F.count("*").alias("_cnt"))
    d = (d.join(cnt, group)
          .where(F.col("rn") <= F.floor(F.col("_cnt") / CORPUS_BATCH) * CORPUS_BATCH).drop("_cnt"))
    return d.join(docs.select("doc_id", T.fold_ws(T.py_strip("text")).alias("text")), "doc_id")


@register("x12_corpus_builder", f"""
WITH f AS (SELECT MIN(doc_id) AS doc_id FROM documents GROUP BY text),
d AS (SELECT doc.doc_id, doc.lang, {fold(strip('doc.text'))} AS text
      FROM documents doc JOIN f ON doc.doc_id = f.doc_id),
w AS (SELECT *, {word_count('text')} AS n_words FROM d),
l AS (SELECT w.*, MAX(CASE WHEN n_words > {LONG_WORDS} THEN 1 ELSE 0 END) OVER (PARTITION BY lang) AS any_long FROM w),
k AS (SELECT * FROM l WHERE n_words > {LONG_WORDS} OR any_long = 0),
r1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY {md5_key('doc_id', 0)}, doc_id) AS rn1 FROM k),
c AS (SELECT * FROM r1 WHERE rn1 <= {CORPUS_HEAD} AND n_words <= {TOKEN_CAP}),
r2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY {md5_key('doc_id', 0)}, doc_id) AS rn FROM c),
s AS (SELECT * FROM r2 WHERE rn <= {CORPUS_SAMPLES}),
n AS (SELECT lang, COUNT(*) AS cnt FROM s GROUP BY lang)
SELECT s.lang, CAST(s.rn AS BIGINT) AS rn, s.doc_id, s.n_words, md5(s.text) AS text_md5
FROM s JOIN n ON s.lang = n.lang WHERE s.rn <= (n.cnt // {CORPUS_BATCH}) * {CORPUS_BATCH}""")
def x12_corpus_builder(spark, sf_dir):
    d = corpus_builder(table(spark, sf_dir, "documents"))
    return d.select("lang", "rn", "doc_id", "n_words", F.md5("text").alias("text_md5"))


def counselling_pairs(spark, sf_dir):
    """wide rows (context, human response, machine response) from
    consecutive user/assistant turns; the response may be missing."""
    conv = table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("Response"))
    a = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), (F.col("turn") - 1).alias("a_turn"), F.col("text").alias("LLM"))
    return (u.join(a, (u.conv_id == a.a_conv) & (u.turn == a.a_turn), "left")
             .select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"),
                     F.col("conv_id").alias("Context"), "Response", "LLM"))


def counselling_splits(spark, sf_dir, n=COUNSEL_N):
    """The counselling preprocessor: P5, P6, E5, P4, U3, O3, U1, O1, O4 x2."""
    w = counselling_pairs(spark, sf_dir).na.drop(subset=["Response", "LLM"])
    w = w.where(~T.is_blank("Response") & ~T.is_blank("LLM"))
    w = (w.withColumn("Response", T.nbsp_newline_to_space("Response"))
          .withColumn("LLM", T.nbsp_newline_to_space("LLM")))
    long = C.wide_to_long(w, ["pair_id", "Context"], {"Response": "0", "LLM": "1"})
    long = C.keep_first(long, ["Context", "result"], "pair_id")
    # The sample feeds both splits and their join-backs: write it once.
    slim = C.sample_per_class(long.select("pair_id", "result"), n, "result", "pair_id", seed=42).drop("rn")
    s = materialize(long.join(slim, ["pair_id", "result"]))
    s1 = C.stratified_fraction_split(s, "result", "pair_id", 0.2, seed="s1")
    test = s1.where(F.col("split") == "test")
    s2 = C.stratified_fraction_split(s1.where(F.col("split") == "train").drop("split"), "result",
                                     "pair_id", 0.1, seed="s2", names=("train", "valid"))
    return test.unionByName(s2)


@register("o4_counselling_splits", f"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
w AS (SELECT u.conv_id * 100 + u.turn AS pair_id, u.conv_id AS context, u.text AS response, a.text AS llm
      FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
c AS (SELECT pair_id, context, translate(response, chr(160) || chr(10), '  ') AS response,
             translate(llm, chr(160) || chr(10), '  ') AS llm FROM w
      WHERE response IS NOT NULL AND llm IS NOT NULL AND {strip('response')} <> '' AND {strip('llm')} <> ''),
l AS (SELECT pair_id, context, response AS text, '0' AS result FROM c
      UNION ALL SELECT pair_id, context, llm AS text, '1' AS result FROM c),
f AS (SELECT l.* FROM l JOIN (SELECT context, result, MIN(pair_id) AS pid FROM l GROUP BY context, result) m
      ON l.pair_id = m.pid AND l.result = m.result),
s AS (SELECT * FROM (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY result ORDER BY {md5_key('pair_id', 42)}, pair_id) AS rn
                     FROM f) WHERE rn <= {COUNSEL_N}),
{frac_split_sql('s', 'result', 'pair_id', 0.2, 's1', 'sp1')},
tr AS (SELECT pair_id, context, text, result FROM sp1 WHERE NOT is_test),
{frac_split_sql('tr', 'result', 'pair_id', 0.1, 's2', 'sp2')}
SELECT pair_id, result, 'test' AS split, md5(text) AS text_md5 FROM sp1 WHERE is_test
UNION ALL
SELECT pair_id, result, CASE WHEN is_test THEN 'valid' ELSE 'train' END AS split, md5(text) AS text_md5 FROM sp2""")
def o4_counselling_splits(spark, sf_dir):
    s = counselling_splits(spark, sf_dir)
    return s.select("pair_id", "result", "split", F.md5("text").alias("text_md5"))


def context_splits(spark, sf_dir):
    """O4 by context: whole conversations to test (20 %), of the rest to
    valid (10 %) and train."""
    conv = labelled_conversations(spark, sf_dir)
    s = materialize(C.group_fraction_split(conv, "conv_id", "result", 0.2, seed="t", names=("rest", "test")))
    rest = C.group_fraction_split(s.where(F.col("split") == "rest").drop("split"), "conv_id", "result", 0.1, seed="v",
                                  names=("train", "valid"))
    return s.where(F.col("split") == "test").unionByName(rest)


def _context_sql() -> str:
    """CTE ``sp`` (doc_id, conv_id, result, text, split)."""
    def split(src: str, seed: str, n: int, d: int, out: str) -> str:
        return f"""
{out}_c AS (SELECT conv_id, CAST(result AS VARCHAR) AS c, COUNT(*) AS n FROM {src} GROUP BY conv_id, result),
{out}_g AS (SELECT conv_id, SUM(n) AS size, string_agg(c || ':' || n, ',' ORDER BY c) AS kind FROM {out}_c GROUP BY conv_id),
{out}_r AS (SELECT conv_id, ROW_NUMBER() OVER (ORDER BY size, kind, {md5_key('conv_id', seed)}, conv_id) AS r FROM {out}_g),
{out} AS (SELECT s.*, (r * {n}) // {d} > ((r - 1) * {n}) // {d} AS picked FROM {src} s JOIN {out}_r g ON g.conv_id = s.conv_id)"""
    return f"""cv AS {LABELLED_CONV},{split('cv', 't', 1, 5, 'ct')},
rs AS (SELECT doc_id, conv_id, result, text FROM ct WHERE NOT picked),{split('rs', 'v', 1, 10, 'cw')},
sp AS (SELECT doc_id, conv_id, result, text, 'test' AS split FROM ct WHERE picked
       UNION ALL SELECT doc_id, conv_id, result, text, CASE WHEN picked THEN 'valid' ELSE 'train' END FROM cw)"""


@register("o4_context_splits", f"""WITH {_context_sql()} SELECT doc_id, conv_id, result, split FROM sp""")
def o4_context_splits(spark, sf_dir):
    return context_splits(spark, sf_dir).select("doc_id", "conv_id", "result", "split")


@register("j13_context_overlap", f"""WITH {_context_sql()},
{frac_split_sql('cv', 'result', 'doc_id', 0.2, 't', 'bt').lstrip()},
b AS (SELECT 'by_context' AS split_by, conv_id, split FROM sp
      UNION ALL SELECT 'by_text', conv_id, CASE WHEN is_test THEN 'test' ELSE 'train' END FROM bt)
SELECT t.split_by, CAST(COUNT(*) AS BIGINT) AS n_test, CAST(COUNT(x.conv_id) AS BIGINT) AS n_overlap
FROM b t LEFT JOIN (SELECT DISTINCT split_by, conv_id FROM b WHERE split = 'train') x
  ON x.split_by = t.split_by AND x.conv_id = t.conv_id
WHERE t.split = 'test' GROUP BY t.split_by""")
def j13_context_overlap(spark, sf_dir):
    """J13 by context: test rows whose conversation also has training rows,
    for the split by whole contexts (none) and the split by texts."""
    conv = labelled_conversations(spark, sf_dir)
    by_text = C.stratified_fraction_split(conv, "result", "doc_id", 0.2, seed="t").select("conv_id", "split")
    both = materialize(context_splits(spark, sf_dir).select(F.lit("by_context").alias("split_by"), "conv_id", "split")
                       .unionByName(by_text.select(F.lit("by_text").alias("split_by"), "conv_id", "split")))
    key = both.withColumn("key", F.concat_ws(":", "split_by", F.col("conv_id").cast("string")))
    test = key.where(F.col("split") == "test")
    shared = C.overlap(test, key.where(F.col("split") == "train"), "key").groupBy("split_by").agg(F.count("*").alias("n_overlap"))
    return (test.groupBy("split_by").agg(F.count("*").alias("n_test")).join(shared, "split_by", "left")
                .select("split_by", "n_test", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap")))


@register("o3_sample_per_class", f"""
WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY result ORDER BY {md5_key('doc_id', 7)}, doc_id) AS rn
           FROM {LABELLED_CONV})
SELECT doc_id, result, CAST(rn AS BIGINT) AS rn FROM s WHERE rn <= {COUNSEL_N}""")
def o3_sample_per_class(spark, sf_dir):
    d = labelled_conversations(spark, sf_dir)
    return C.sample_per_class(d, COUNSEL_N, "result", "doc_id", seed=7).select("doc_id", "result", "rn")


def _split_case(rn: str) -> str:
    lo, parts = 0, []
    for name, size in LANG_SPLITS:
        parts.append(f"WHEN {rn} > {lo} AND {rn} <= {lo + size} THEN '{name}'")
        lo += size
    return "CASE " + " ".join(parts) + " ELSE 'rest' END"


_LANG_SPLIT_SQL = f"""(SELECT doc_id, text, result, lang, source, {_split_case('rn')} AS split FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, result ORDER BY {md5_key('doc_id', 42)}, doc_id) AS rn
    FROM {LABELLED_DOCS}))"""


def language_splits(spark, sf_dir):
    # Consumers read several splits of it: write the assignment once.
    docs = labelled_documents(spark, sf_dir).select("doc_id", "lang", "source", "result",
                                                    F.sha2(F.col("text").cast("binary"), 256).alias("text_h"))
    return materialize(C.absolute_split(docs, ["lang", "result"], LANG_SPLITS,
                                        "doc_id", seed=42, strict=False))      # small fixtures have short strata


@register("o5_language_splits", f"SELECT doc_id, lang, result, split FROM {_LANG_SPLIT_SQL}")
def o5_language_splits(spark, sf_dir):
    return language_splits(spark, sf_dir).select("doc_id", "lang", "result", "split")


@register("o6_generator_test_sets", f"""
WITH sp AS {_LANG_SPLIT_SQL},
h AS (SELECT doc_id, lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY {md5_key('doc_id', 42)}, doc_id) AS rn
      FROM sp WHERE result = 0 AND split = 'rest'),
hc AS (SELECT lang, COUNT(*) AS nh FROM h GROUP BY lang),
g AS (SELECT lang, source, COUNT(*) AS ng FROM sp WHERE result = 1 GROUP BY lang, source),
z AS (SELECT g.lang, g.source, LEAST({GEN_TEST_MAX}, 2 * COALESCE(hc.nh, 0), 2 * g.ng) // 2 AS half
      FROM g LEFT JOIN hc ON g.lang = hc.lang),
m AS (SELECT sp.doc_id, sp.lang, sp.source,
             ROW_NUMBER() OVER (PARTITION BY sp.lang, sp.source ORDER BY {md5_key('sp.doc_id', 42)}, sp.doc_id) AS rn
      FROM sp WHERE result = 1)
SELECT z.lang, z.source AS generator, h.doc_id, 0 AS result FROM z JOIN h ON z.lang = h.lang WHERE h.rn <= z.half
UNION ALL
SELECT z.lang, z.source AS generator, m.doc_id, 1 AS result FROM z JOIN m ON z.lang = m.lang AND z.source = m.source
WHERE m.rn <= z.half""")
def o6_generator_test_sets(spark, sf_dir):
    sp = language_splits(spark, sf_dir)
    humans = sp.where((F.col("result") == 0) & (F.col("split") == "rest")).select("doc_id", "lang")
    hc = humans.groupBy("lang").agg(F.count("*").alias("nh"))
    llm = sp.where(F.col("result") == 1).select("doc_id", "lang", "source")
    g = llm.groupBy("lang", "source").agg(F.count("*").alias("ng"))
    z = (g.join(hc, "lang", "left")
          .select("lang", "source", F.floor(F.least(F.lit(GEN_TEST_MAX), 2 * F.coalesce("nh", F.lit(0)),
                                                   2 * F.col("ng")) / 2).cast("bigint").alias("half")))
    # Humans: at most GEN_TEST_MAX/2 per language are ever needed.
    h = top_n_by_hash(humans, "lang", GEN_TEST_MAX // 2, "doc_id", seed=42)
    hs = (h.join(z, "lang").where(F.col("rn") <= F.col("half"))
           .select("lang", F.col("source").alias("generator"), "doc_id", F.lit(0).alias("result")))
    ms = top_n_by_hash(llm.join(z, ["lang", "source"]), ["lang", "source"], "half", "doc_id", seed=42)
    ms = ms.select("lang", F.col("source").alias("generator"), "doc_id", F.lit(1).alias("result"))
    return hs.unionByName(ms)


@register("j7_length_matched_pairs", f"""
WITH c AS (SELECT doc_id, result, {space_word_count('text')} AS n_words FROM {LABELLED_CONV}),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_words, result ORDER BY doc_id) AS pair_k FROM c),
s AS (SELECT n_words, SUM(CASE WHEN result = 0 THEN 1 ELSE 0 END) AS h,
             SUM(CASE WHEN result = 1 THEN 1 ELSE 0 END) AS m, MIN(doc_id) AS first_seen FROM c GROUP BY n_words)
SELECT r.n_words, CAST(r.pair_k AS BIGINT) AS pair_k, r.result, r.doc_id, s.first_seen
FROM r JOIN s ON r.n_words = s.n_words WHERE r.pair_k <= LEAST(s.h, s.m)""")
def j7_length_matched_pairs(spark, sf_dir):
    d = labelled_conversations(spark, sf_dir).select(
        "doc_id", "result", T.space_word_count("text").alias("n_words"))
    return C.match_by_length(d, "n_words").select("n_words", "pair_k", "result", "doc_id", "first_seen")


@register("j13_split_overlap_audit", f"""
WITH sp AS {_LANG_SPLIT_SQL},
t AS (SELECT * FROM sp WHERE split = 'test'),
o AS (SELECT * FROM t WHERE text IN (SELECT text FROM sp WHERE split = 'train'))
SELECT t.lang, CAST(COUNT(*) AS BIGINT) AS n_test,
       CAST((SELECT COUNT(*) FROM o WHERE o.lang = t.lang) AS BIGINT) AS n_overlap
FROM t GROUP BY t.lang""")
def j13_split_overlap_audit(spark, sf_dir):
    sp = language_splits(spark, sf_dir)
    test = sp.where(F.col("split") == "test")
    ov = C.overlap(test, sp.where(F.col("split") == "train"), "text_h")
    n_ov = ov.groupBy("lang").agg(F.count("*").alias("n_overlap"))
    return (test.groupBy("lang").agg(F.count("*").alias("n_test")).join(n_ov, "lang", "left")
                .select("lang", "n_test", F.coalesce("n_overlap", F.lit(0)).alias("n_overlap")))


_CONV_LEN = f"(SELECT doc_id, result, {space_word_count('text')} AS n_words FROM {LABELLED_CONV})"


def conv_lengths(spark, sf_dir):
    return labelled_conversations(spark, sf_dir).select(
        "doc_id", "result", T.space_word_count("text").alias("n_words"))


@register("a1_length_stats_by_class", f"""
SELECT result, MIN(n_words) AS min_words, MAX(n_words) AS max_words, ROUND(AVG(n_words), 6) AS mean_words,
       CAST(COUNT(*) AS BIGINT) AS n FROM {_CONV_LEN} GROUP BY result""")
def a1_length_stats_by_class(spark, sf_dir):
    s = C.length_stats(conv_lengths(spark, sf_dir), "n_words", "result")
    return s.withColumn("mean_words", F.round("mean_words", 6))


@register("w8_head80_length_stats", f"""
WITH h AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY result ORDER BY doc_id) AS rn
                          FROM {_CONV_LEN}) WHERE rn <= 80)
SELECT result, MIN(n_words) AS min_words, MAX(n_words) AS max_words, ROUND(AVG(n_words), 6) AS mean_words,
       CAST(COUNT(*) AS BIGINT) AS n FROM h GROUP BY result""")
def w8_head80_length_stats(spark, sf_dir):
    d = conv_lengths(spark, sf_dir)
    # First 80 rows of each class in file order: a distributed top-k
    # per class value (the classes are the fixed labels 0 and 1).
    heads = [d.where(F.col("result") == c).orderBy("doc_id").limit(80) for c in (0, 1)]
    s = C.length_stats(heads[0].unionByName(heads[1]), "n_words", "result")
    return s.withColumn("mean_words", F.round("mean_words", 6))


@register("a2_length_histogram", f"""
WITH b AS (SELECT result, CASE WHEN n_words = 2500 THEN 24 ELSE CAST(FLOOR(n_words / 100) AS INTEGER) END AS bin
           FROM {_CONV_LEN} WHERE n_words >= 0 AND n_words <= 2500),
g AS (SELECT r.result, CAST(x.bin AS INTEGER) AS bin FROM (SELECT DISTINCT result FROM {_CONV_LEN}) r,
      (SELECT range AS bin FROM range(25)) x),
c AS (SELECT result, bin, COUNT(*) AS cnt FROM b GROUP BY result, bin)
SELECT g.result, g.bin, g.bin * 100 AS lo, (g.bin + 1) * 100 AS hi, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.result = c.result AND g.bin = c.bin""")
def a2_length_histogram(spark, sf_dir):
    return C.length_histogram(conv_lengths(spark, sf_dir), "n_words", "result")


@register("a3_class_counts_by_dataset", f"""
SELECT dataset, result, CAST(COUNT(*) AS BIGINT) AS n FROM {LABELLED_DOCS} GROUP BY dataset, result""")
def a3_class_counts_by_dataset(spark, sf_dir):
    return labelled_documents(spark, sf_dir).groupBy("dataset", "result").agg(F.count("*").alias("n"))


@register("a4_texts_by_length", f"""
SELECT n_words, result, CAST(COUNT(*) AS BIGINT) AS n_texts FROM {_CONV_LEN} GROUP BY n_words, result""")
def a4_texts_by_length(spark, sf_dir):
    return C.texts_by_length(conv_lengths(spark, sf_dir), "n_words")


@register("p10_translation_band_filter", f"""
WITH t AS (SELECT doc_id, lang, {{'en': CASE WHEN lang = 'en' THEN text END,
                                   'de': CASE WHEN lang = 'de' THEN text END}} AS translation FROM documents),
p AS (SELECT doc_id, 'en' AS pick, translation.en AS text FROM t
      UNION ALL SELECT doc_id, 'de' AS pick, translation.de AS text FROM t)
SELECT doc_id, pick, {word_count('text')} AS n_words FROM p
WHERE text IS NOT NULL AND {word_count('text')} > 100 AND {word_count('text')} < 150""")
def p10_translation_band_filter(spark, sf_dir):
    """P13 + P10: pick one language from a translation struct, keep texts of
    strictly between 100 and 150 words."""
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", F.struct(F.when(F.col("lang") == "en", F.col("text")).alias("en"),
                                    F.when(F.col("lang") == "de", F.col("text")).alias("de")).alias("translation"))
    parts = [t.select("doc_id", F.lit(k).alias("pick"), F.col("translation").getField(k).alias("text"))
             for k in ("en", "de")]
    p = parts[0].unionByName(parts[1]).where(F.col("text").isNotNull())
    p = p.withColumn("n_words", T.word_count("text"))
    return p.where((F.col("n_words") > 100) & (F.col("n_words") < 150)).select("doc_id", "pick", "n_words")


MIXED_PER_CLASS = 25


@register("o7_mixed_training_set", f"""
WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY result ORDER BY {md5_key('doc_id', 'mixed')}, doc_id) AS rn
           FROM {LABELLED_DOCS})
SELECT doc_id, lang, result, CAST(rn AS BIGINT) AS rn FROM s WHERE rn <= {MIXED_PER_CLASS}""")
def o7_mixed_training_set(spark, sf_dir):
    """A language-mixed training set, the same number of rows per class
    drawn across all languages — seeded, so it is repeatable (the
    reference's draw is not)."""
    d = labelled_documents(spark, sf_dir)
    s = C.sample_per_class(d, MIXED_PER_CLASS, "result", "doc_id", seed="mixed")
    return s.select("doc_id", "lang", "result", "rn")
