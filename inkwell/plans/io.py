"""Source/sink queries: each writes data derived from the driver tables to
a fresh folder under the shared checkpoint folder with the engine's
writers, reads it back with the engine's readers, and returns what the
reference's pipeline would compute from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import evaluate as ev
from inkwell.operators import lm as LM
from inkwell.operators import pair as PR
from inkwell.operators import vectors as VE
from inkwell.plans import criteria as CR
from inkwell.plans import vectorq as VQ
from inkwell.plans.curation import counselling_pairs
from inkwell.plans.pairing import PAIRS_SQL
from inkwell.plans.registry import register
from inkwell.plans.sqlfrag import (LABELLED_CONV, LABELLED_DOCS, auroc_sql, detokenise, pr_auc_sql,
                                  remove_tags, space_word_count, word_count, words)
from inkwell.plans.textq import _STORY_SQL, writing_stories
from inkwell.session import materialize, scratch_path, table
from inkwell.sources import files as FS
from inkwell.sources.tables import labelled_conversations, labelled_documents


@register("s1_s14_labelled_json_roundtrip", f"""
SELECT result, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM({word_count('text')}) AS BIGINT) AS n_words
FROM {LABELLED_CONV} GROUP BY result""")
def s1_s14_labelled_json_roundtrip(spark, sf_dir):
    """S14 write (string labels, D2) then S1 read with a declared schema."""
    path = scratch_path(spark, "labelled-json")
    d = labelled_conversations(spark, sf_dir).select("text", F.col("result").cast("string").alias("result"))
    FS.write_labelled_json(d, path, partition_by=None)
    back = FS.read_labelled_json(spark, path)
    human, machine = FS.label_split(back)
    both = human.unionByName(machine)
    return both.groupBy("result").agg(F.count("*").alias("n"), F.sum(T.word_count("text")).alias("n_words"))


@register("s3_csv_multiline_roundtrip", """
SELECT u.conv_id * 100 + u.turn AS pair_id, u.conv_id AS Context, md5(u.text) AS response_md5, md5(a.text) AS llm_md5
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")
def s3_csv_multiline_roundtrip(spark, sf_dir):
    """S3: quoted multi-line texts survive a CSV write/read unchanged."""
    path = scratch_path(spark, "counselling-csv")
    FS.write_csv(counselling_pairs(spark, sf_dir), path)
    back = FS.read_csv(spark, path, "pair_id long, Context long, Response string, LLM string")
    return back.select("pair_id", "Context", F.md5("Response").alias("response_md5"),
                       F.md5("LLM").alias("llm_md5"))


_FILE_STORY = detokenise("(" + remove_tags("prompt || chr(10)") + " || ' ' || story || chr(10))")


@register("s4_writing_prompt_files", f"""
WITH s AS (SELECT {_FILE_STORY} AS text FROM {_STORY_SQL})
SELECT md5(text) AS text_md5, {word_count('text')} AS n_words FROM s
WHERE NOT contains(text, 'nsfw') AND NOT contains(text, 'NSFW')""")
def s4_writing_prompt_files(spark, sf_dir):
    """S4 + J3 + E6-E8 + P11: prompts and stories as two line-aligned text
    files; read back, joined by line, detokenised, filtered."""
    st = writing_stories(spark, sf_dir)
    path = scratch_path(spark, "wp")
    FS.write_aligned(st, path, ["pair_id"], ["prompt", "story"])
    pairs = FS.read_aligned(spark, path, ["prompt", "story"])
    line = lambda c: F.concat(F.col(c), F.lit("\n"))  # noqa: E731  (lines keep their break, as the reader's rules expect)
    t = pairs.select(T.prompt_story(line("prompt"), line("story")).alias("text"))
    t = t.where(~F.col("text").contains("nsfw") & ~F.col("text").contains("NSFW"))
    return t.select(F.md5("text").alias("text_md5"), T.word_count("text").alias("n_words"))


LINES = 64


@register("s4_aligned_files", f"""
WITH r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY pair_id) - 1 AS n FROM {_STORY_SQL})
SELECT CAST(n // {LINES} AS INTEGER) AS file_no, MIN(n) AS first_line, CAST(COUNT(*) AS BIGINT) AS n_lines,
       md5(string_agg(md5(prompt) || md5(story), ',' ORDER BY n)) AS lines_md5
FROM r GROUP BY n // {LINES}""")
def s4_aligned_files(spark, sf_dir):
    """S4 sink: files of 64 lines, as many as the rows need, with their
    manifest; read back line by line."""
    st = writing_stories(spark, sf_dir)
    path = scratch_path(spark, "aligned")
    FS.write_aligned(st, path, ["pair_id"], ["prompt", "story"], LINES)
    back = FS.read_aligned(spark, path, ["prompt", "story"])
    pairs = back.select(F.expr(f"cast(line_no div {LINES} as int)").alias("file_no"),
                        F.struct("line_no", F.concat(F.md5("prompt"), F.md5("story")).alias("m")).alias("l"))
    sums = pairs.groupBy("file_no").agg(F.md5(F.array_join(F.transform(      # the lines of one file
        F.array_sort(F.collect_list("l")), lambda x: x["m"]), ",")).alias("lines_md5"))
    return spark.read.parquet(f"{path}/manifest").join(sums, "file_no").select("file_no", "first_line", "n_lines", "lines_md5")


@register("s5_s17_pairs_roundtrip", f"""
SELECT pair_id, md5(original) AS original_md5, md5(sampled) AS sampled_md5, 50 AS batch_size FROM {PAIRS_SQL}""")
def s5_s17_pairs_roundtrip(spark, sf_dir):
    """S17 write (pairs + run arguments) then S5/S6 read."""
    prefix = scratch_path(spark, "pairs")
    pairs = PR.turn_pairs(table(spark, sf_dir, "conversations"))
    FS.write_pairs(pairs, prefix, {"dataset": "conversations", "n_samples": 200, "batch_size": 50, "seed": 0})
    back, args = FS.read_pairs(spark, prefix)
    return back.select("pair_id", F.md5("original").alias("original_md5"), F.md5("sampled").alias("sampled_md5"),
                       args.select("batch_size").scalar().alias("batch_size"))


@register("s7_s20_partitioned_fanout", f"""
SELECT lang AS dataset, source AS generator, result, CAST(COUNT(*) AS BIGINT) AS n FROM {LABELLED_DOCS}
GROUP BY lang, source, result""")
def s7_s20_partitioned_fanout(spark, sf_dir):
    """S20 one folder per language x generator; S7 glob read; E21 keys
    from the path."""
    path = scratch_path(spark, "fanout")
    d = labelled_documents(spark, sf_dir).select("text", "result", "lang", "source")
    FS.write_labelled_json(d, path, partition_by=["lang", "source"])
    back = FS.read_with_path(spark, f"{path}/*/*/*.json", "text string, result int")
    return (back.select(FS.hive_key("path", "lang").alias("dataset"),
                        FS.hive_key("path", "source").alias("generator"), "result")
                .groupBy("dataset", "generator", "result").agg(F.count("*").alias("n")))


@register("s16_layer_partitioned_roundtrip", f"""
SELECT vec_id AS doc_id, list_transform(embedding[{VQ.LAST * VQ.DIM + 1}:{VQ.LAST * VQ.DIM + VQ.DIM}],
                                        lambda x: ROUND(CAST(x AS DOUBLE), 6)) AS vec
FROM embeddings""")
def s16_layer_partitioned_roundtrip(spark, sf_dir):
    """S16 write vectors partitioned by layer; the last-layer read is a
    partition-pruned scan (P14)."""
    from inkwell.functions import maths as M
    path = scratch_path(spark, "vectors")
    FS.write_by_layer(VQ.long_vectors(spark, sf_dir), path)
    last = VE.layer_projection(spark.read.parquet(path), VQ.LAST, VQ.N_LAYERS)
    return last.select("doc_id", M.round_array("vec").alias("vec"))


_LEN_SCORED = f"(SELECT lang, result AS label, {space_word_count('text')} AS score FROM {LABELLED_DOCS})"


@register("s18_results_append", f"""
WITH a AS ({auroc_sql(_LEN_SCORED, ['lang'])})
SELECT CAST(NULL AS VARCHAR) AS sampling_model_name, 'length' AS scoring_model_name,
       'documents/' || lang AS dataset_path, ROUND(auroc, 4) AS auroc, b.batch
FROM a, (SELECT 'first' AS batch UNION ALL SELECT 'second') b""")
def s18_results_append(spark, sf_dir):
    """Two runs append result records to one store; a missing store
    reads as empty."""
    path = scratch_path(spark, "results")
    assert FS.read_results(spark, path).count() == 0
    scored = labelled_documents(spark, sf_dir).select(
        "lang", F.col("result").alias("label"), T.space_word_count("text").cast("double").alias("score"))
    recs = ev.auroc(scored, "lang").select(
        F.lit(None).cast("string").alias("sampling_model_name"), F.lit("length").alias("scoring_model_name"),
        F.concat(F.lit("documents/"), F.col("lang")).alias("dataset_path"), F.round("auroc", 4).alias("auroc"))
    for batch in ("first", "second"):
        FS.append_results(recs.withColumn("batch", F.lit(batch)), path)
    return FS.read_results(spark, path)


def pair_texts(spark, sf_dir):
    """Originals (label 0) and samples (label 1) of the J6 pairs as one
    text table (id = pair_id * 10 + label)."""
    p = PR.turn_pairs(table(spark, sf_dir, "conversations"))
    return (p.select((F.col("pair_id") * 10).alias("doc_id"), F.col("original").alias("text"), F.lit(0).alias("label"))
             .unionByName(p.select((F.col("pair_id") * 10 + 1).alias("doc_id"), F.col("sampled").alias("text"),
                                   F.lit(1).alias("label"))))


_PAIR_TEXTS = f"""(SELECT pair_id * 10 AS doc_id, original AS text, 0 AS label FROM {PAIRS_SQL}
 UNION ALL SELECT pair_id * 10 + 1, sampled, 1 FROM {PAIRS_SQL})"""
_PAIR_LONG = "(" + " UNION ALL ".join(
    f"SELECT '{k}_threshold' AS name, {k} AS score, t.label FROM crit JOIN {_PAIR_TEXTS} t USING (doc_id)"
    for k in LM.CRITERIA) + ")"


@register("s19_criterion_results", f"""WITH {CR.crit_sql(_PAIR_TEXTS)},
r AS ({auroc_sql(_PAIR_LONG, ['name'])}),
p AS ({pr_auc_sql(_PAIR_LONG, ['name'])})
SELECT r.name, (SELECT CAST(COUNT(*) AS BIGINT) FROM {PAIRS_SQL}) AS n_samples, ROUND(r.auroc, 6) AS roc_auc,
       ROUND(p.pr_auc, 6) AS pr_auc, ROUND(1 - p.pr_auc, 6) AS loss
FROM r JOIN p ON r.name = p.name""")
def s19_criterion_results(spark, sf_dir):
    """X1 on (original, sampled) pairs, one nested result record per
    criterion (S19: name, info, metrics, pr_metrics, loss) written as JSON
    and read back.  Curves stay in their own long tables (A17/A19)."""
    texts = pair_texts(spark, sf_dir)
    crit = LM.criteria(CR.model_for(spark, sf_dir), texts, CR.LAM, CR.LAM_REF)
    long = LM.long_criteria(crit.join(texts.select("doc_id", "label"), "doc_id"), ["doc_id", "label"])
    long = long.withColumn("name", F.concat("criterion", F.lit("_threshold")))
    summary = ev.roc_pr_summary(long, "name")          # ROC and PR from one pass
    n = texts.where(F.col("label") == 0).select(F.count("*")).scalar()
    rec = summary.select(
        "name", F.struct(n.alias("n_samples")).alias("info"),
        F.struct(F.col("auroc").alias("roc_auc")).alias("metrics"),
        F.struct(F.col("pr_auc")).alias("pr_metrics"), F.col("loss"))
    path = scratch_path(spark, "experiment-results")
    rec.write.mode("overwrite").json(path)
    back = spark.read.schema(rec.schema).json(path)
    return back.select("name", F.col("info.n_samples").cast("bigint").alias("n_samples"),
                       F.round("metrics.roc_auc", 6).alias("roc_auc"), F.round("pr_metrics.pr_auc", 6).alias("pr_auc"),
                       F.round("loss", 6).alias("loss"))


@register("s19_curve_tables", f"""WITH {CR.crit_sql(_PAIR_TEXTS)},
s AS (SELECT name, CAST(score AS DOUBLE) AS score, label FROM {_PAIR_LONG} WHERE score IS NOT NULL),
r AS ({auroc_sql(_PAIR_LONG, ['name'])}),
n AS (SELECT name, score, SUM(label) AS p, SUM(1 - label) AS q FROM s GROUP BY name, score),
l AS (SELECT *, LEAD(p) OVER w AS np, LEAD(q) OVER w AS nq FROM n WINDOW w AS (PARTITION BY name ORDER BY score DESC))
SELECT r.name, ROUND(r.auroc, 6) AS roc_auc, ROUND(r.auroc, 6) AS curve_area,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM l WHERE l.name = r.name AND (np IS NULL OR p * nq <> q * np)) AS n_points,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM s WHERE s.name = r.name) AS n_predictions,
       (SELECT ROUND(SUM(score), 3) FROM s WHERE s.name = r.name) AS predictions_sum
FROM r""")
def s19_curve_tables(spark, sf_dir):
    """S19 as related tables: result records, and beside them the curve
    points and the predictions of each criterion as child tables in folders
    by name; the areas of the stored curves are those of A18."""
    texts = pair_texts(spark, sf_dir)
    crit = LM.criteria(CR.model_for(spark, sf_dir), texts, CR.LAM, CR.LAM_REF)
    long = LM.long_criteria(crit.join(texts.select("doc_id", "label"), "doc_id"), ["doc_id", "label"])
    long = materialize(long.select(F.concat("criterion", F.lit("_threshold")).alias("name"), "doc_id", "label", "score")
                       .where(F.col("score").isNotNull()))
    root = scratch_path(spark, "experiment")
    ev.auroc(long, "name").withColumnRenamed("auroc", "roc_auc").write.parquet(f"{root}/results")
    ev.thinned_roc(long, "name").write.partitionBy("name").parquet(f"{root}/curves")
    long.write.partitionBy("name").parquet(f"{root}/predictions")
    back = {t: spark.read.parquet(f"{root}/{t}") for t in ("results", "curves", "predictions")}
    areas = ev.curve_area(back["curves"], "name")
    told = back["predictions"].groupBy("name").agg(F.count("*").alias("n_predictions"), F.round(F.sum("score"), 3).alias("predictions_sum"))
    return back["results"].join(areas, "name").join(told, "name").select(
        "name", F.round("roc_auc", 6).alias("roc_auc"), F.round("area", 6).alias("curve_area"), "n_points", "n_predictions",
        "predictions_sum")


# The source registry over the fixture tables.
def source_registry(spark, sf_dir):
    """Name -> DataFrame factory of texts; unknown names raise."""
    def language(lang):
        d = table(spark, sf_dir, "documents")
        t = d.select(F.struct(F.when(F.col("lang") == "en", F.col("text")).alias("en"),
                              F.when(F.col("lang") == "de", F.col("text")).alias("de")).alias("translation"))
        x = t.select(F.col("translation").getField(lang).alias("text")).where(F.col("text").isNotNull())
        n = T.word_count("text")
        return x.where((n > 100) & (n < 150))

    def pubmed():
        p = PR.turn_pairs(table(spark, sf_dir, "conversations"))
        return p.select(T.qa_template("original", "sampled").alias("text"))

    def writing():
        s = writing_stories(spark, sf_dir).select(T.prompt_story("prompt", "story").alias("text"))
        return s.where(~F.col("text").contains("nsfw") & ~F.col("text").contains("NSFW"))

    return {"writing": writing, "english": lambda: language("en"), "german": lambda: language("de"),
            "pubmed": pubmed}


def load_source(spark, sf_dir, name):
    reg = source_registry(spark, sf_dir)
    if name not in reg:
        raise ValueError(f"Unknown dataset {name}")
    return reg[name]()


@register("s8_source_registry_counts", f"""
WITH t AS (SELECT lang, text FROM documents WHERE lang IN ('en', 'de'))
SELECT CASE lang WHEN 'en' THEN 'english' ELSE 'german' END AS source, CAST(COUNT(*) AS BIGINT) AS n
FROM t WHERE {word_count('text')} > 100 AND {word_count('text')} < 150 GROUP BY lang
UNION ALL SELECT 'pubmed', CAST(COUNT(*) AS BIGINT) FROM {PAIRS_SQL}
UNION ALL SELECT 'writing', CAST(COUNT(*) AS BIGINT) FROM (
    SELECT {detokenise("(" + remove_tags('prompt') + " || ' ' || story)")} AS text FROM {_STORY_SQL})
  WHERE NOT contains(text, 'nsfw') AND NOT contains(text, 'NSFW')""")
def s8_source_registry_counts(spark, sf_dir):
    out = None
    for name in ("writing", "english", "german", "pubmed"):
        c = load_source(spark, sf_dir, name).select(F.lit(name).alias("source"), F.lit(1).alias("_one"))
        out = c if out is None else out.unionByName(c)
    return out.groupBy("source").agg(F.count("*").alias("n"))


# Fixture: each language plays one named corpus with its own text column.
NAMED = {"en": "xsum", "de": "squad", "fr": "fluoroscopy", "es": "story"}


@register("s9_text_column_pick", f"""
SELECT CASE lang {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items())} END AS dataset,
       CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(length(text)) AS BIGINT) AS n_chars
FROM documents WHERE lang IN ({", ".join(repr(k) for k in NAMED)}) GROUP BY lang""")
def s9_text_column_pick(spark, sf_dir):
    """The text column by the corpus name, by lookup or the name
    itself."""
    from inkwell.sources.tables import DATASET_KEYS, pick_text
    out = None
    for lang, name in NAMED.items():
        d = table(spark, sf_dir, "documents").where(F.col("lang") == lang)
        d = d.select(F.col("text").alias(DATASET_KEYS.get(name, name)), F.lit("other").alias("other"))
        x = pick_text(d, name).select(F.lit(name).alias("dataset"), F.length("text").alias("l"))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("l").cast("bigint").alias("n_chars"))


@register("s6_perturbed_pairs_roundtrip", f"""
WITH p AS (SELECT pair_id, original, sampled, {words('original')} AS wo, {words('sampled')} AS ws FROM {PAIRS_SQL})
SELECT pair_id, md5(original) AS original_md5,
       [{", ".join(f"md5(array_to_string(wo[1:{i - 1}] || wo[{i + 1}:len(wo)], ' '))" for i in (1, 2, 3))}] AS po_md5,
       [{", ".join(f"md5(array_to_string(ws[1:{i - 1}] || ws[{i + 1}:len(ws)], ' '))" for i in (1, 2, 3))}] AS ps_md5 FROM p""")
def s6_perturbed_pairs_roundtrip(spark, sf_dir):
    """Pairs with perturbed variants written as records and read."""
    from inkwell.operators.pair import perturbed
    prefix = scratch_path(spark, "perturbed")
    p = PR.turn_pairs(table(spark, sf_dir, "conversations"))
    FS.write_pairs(p.withColumn("perturbed_original", perturbed("original"))
                    .withColumn("perturbed_sampled", perturbed("sampled")), prefix, {"n_perturbations": 3})
    d, args = FS.read_pairs(spark, prefix, perturbed=True, rows=True)
    md5s = lambda c: F.transform(c, lambda x: F.md5(x))
    return d.select("pair_id", F.md5("original").alias("original_md5"), md5s("perturbed_original").alias("po_md5"),
                    md5s("perturbed_sampled").alias("ps_md5"))
