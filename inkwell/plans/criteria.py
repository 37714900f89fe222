"""Zero-shot criteria queries.

Token model: trained on the whole ``documents`` table (V = 1000 words,
scoring lam 0.9, reference lam 0.5).  Scored sets: labelled conversations
(user = human, assistant = machine) and labelled documents.  The oracle
SQL computes the same model *densely* (every context x every token, with
window ranks) — a brute-force check of the sparse Spark computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import evaluate as ev
from inkwell.operators import lm as LM
from inkwell.operators import sampling as SP
from inkwell.plans.registry import register
from inkwell.plans.sqlfrag import LABELLED_CONV, LABELLED_DOCS, auroc_sql, words
from inkwell.session import table
from inkwell.sources.tables import labelled_conversations, labelled_documents

V, LAM, LAM_REF = 1000, 0.9, 0.5

# Two-Gaussian calibration of the curvature criterion per
# (sampling model, scoring model) pair: mu0, sigma0 (human), mu1, sigma1.
CALIBRATION = [
    ("gpt-j-6B_gpt-neo-2.7B", 0.2713, 0.9366, 2.2334, 1.8731),
    ("gpt-neo-2.7B_gpt-neo-2.7B", -0.2489, 0.9968, 1.8983, 1.9935),
    ("falcon-7b_falcon-7b-instruct", -0.0707, 0.9520, 2.9306, 1.9039),
]
MODEL_PAIR = "gpt-neo-2.7B_gpt-neo-2.7B"


def _d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _pairs_sql(src: str, with_id: bool) -> str:
    """Adjacent word pairs of each text, zipped inside the row (no
    positional self-join, whose per-document intermediate is quadratic)."""
    idc = "doc_id, " if with_id else ""
    return (f"(SELECT {idc}p[1] AS wa, p[2] AS wb FROM (SELECT {idc}"
            f"UNNEST(list_zip(W[1:len(W) - 1], W[2:len(W)])) AS p "
            f"FROM (SELECT {idc}{words('text')} AS W FROM {src})))")


def lm_sql(scored: str, vocabulary: int = V) -> str:
    """CTEs: dense model over ``documents`` and per-position rows for the
    ``scored`` relation (doc_id, text).  Ends with CTE ``j``."""
    return f"""
tw AS (SELECT UNNEST({words('text')}) AS word FROM documents),
cnt AS (SELECT word, COUNT(*) AS c FROM tw GROUP BY word),
top AS (SELECT word AS token, c FROM cnt WHERE word <> '{LM.UNK}' ORDER BY c DESC, word LIMIT {vocabulary}),
tot AS (SELECT SUM(c) AS N, LEAST(COUNT(*) FILTER (WHERE word <> '{LM.UNK}'), {vocabulary}) + 1 AS V1 FROM cnt),
voc AS (SELECT token, c FROM top
        UNION ALL SELECT '{LM.UNK}', (SELECT N FROM tot) - (SELECT COALESCE(SUM(c), 0) FROM top)),
U AS (SELECT token, c, (c + 1) / (SELECT N + V1 FROM tot) AS u FROM voc),
bg AS (SELECT COALESCE(ta.token, '{LM.UNK}') AS ctx, COALESCE(tb.token, '{LM.UNK}') AS tok, COUNT(*) AS c
       FROM {_pairs_sql('documents', False)} tp
       LEFT JOIN top ta ON tp.wa = ta.token LEFT JOIN top tb ON tp.wb = tb.token
       GROUP BY COALESCE(ta.token, '{LM.UNK}'), COALESCE(tb.token, '{LM.UNK}')),
cc AS (SELECT ctx, SUM(c) AS cc FROM bg GROUP BY ctx),
dense AS (SELECT x.token AS ctx, y.token AS tok, y.u, COALESCE(bg.c, 0) AS c, cc.cc
          FROM U x CROSS JOIN U y
          LEFT JOIN bg ON bg.ctx = x.token AND bg.tok = y.token
          LEFT JOIN cc ON cc.ctx = x.token),
pd AS (SELECT ctx, tok,
              CASE WHEN cc IS NULL THEN u ELSE {_d(LAM)} * c / cc + {_d(1.0 - LAM)} * u END AS p,
              CASE WHEN cc IS NULL THEN u ELSE {_d(LAM_REF)} * c / cc + {_d(1.0 - LAM_REF)} * u END AS q
       FROM dense),
rk AS (SELECT ctx, tok, ln(p) AS lp, ROW_NUMBER() OVER (PARTITION BY ctx ORDER BY p DESC, tok) AS rank FROM pd),
cs0 AS (SELECT ctx, -SUM(p * ln(p)) AS entropy, SUM(q * ln(p)) AS mean, SUM(q * ln(p) * ln(p)) AS m2
        FROM pd GROUP BY ctx),
cs AS (SELECT ctx, entropy, mean, m2 - mean * mean AS var FROM cs0),
sp AS (SELECT sp0.doc_id, COALESCE(ta.token, '{LM.UNK}') AS ctx, COALESCE(tb.token, '{LM.UNK}') AS tok
       FROM {_pairs_sql(scored, True)} sp0
       LEFT JOIN top ta ON sp0.wa = ta.token LEFT JOIN top tb ON sp0.wb = tb.token),
j AS (SELECT sp.doc_id, sp.ctx, sp.tok, rk.lp, rk.rank, cs.entropy, cs.mean, cs.var
      FROM sp JOIN rk ON rk.ctx = sp.ctx AND rk.tok = sp.tok JOIN cs ON cs.ctx = sp.ctx)"""


def sparse_sql(scored: str) -> str:
    """As :func:`lm_sql` for a vocabulary of every word, without the dense
    table: unseen tokens of a context enter by sums over the vocabulary and
    ranks by counting, with plain inequalities among the seen pairs and one
    sort of the vocabulary with the asked values."""
    head = lm_sql(scored, 1 << 60).split("dense AS (")[0]
    tail = "sp AS (" + lm_sql(scored, 1 << 60).split("sp AS (")[1].split("j AS (")[0]
    lam, back, ref, rback = _d(LAM), _d(1.0 - LAM), _d(LAM_REF), _d(1.0 - LAM_REF)
    return head + tail + f"""
seen AS (SELECT bg.ctx, bg.tok, {lam} * bg.c / cc.cc + {back} * U.u AS p, {back} * U.u AS b,
                {ref} * bg.c / cc.cc + {rback} * U.u AS q, {rback} * U.u AS bq
         FROM bg JOIN cc ON cc.ctx = bg.ctx JOIN U ON U.token = bg.tok),
tots AS (SELECT SUM({back} * u * ln({back} * u)) AS g1, SUM({rback} * u * ln({back} * u)) AS g2,
                SUM({rback} * u * ln({back} * u) * ln({back} * u)) AS g3, SUM(u * ln(u)) AS k1, SUM(u * ln(u) * ln(u)) AS k2 FROM U),
cs AS (SELECT ctx, -(e + g1) AS entropy, m + g2 AS mean, m2 + g3 - (m + g2) * (m + g2) AS var
       FROM (SELECT ctx, SUM(p * ln(p) - b * ln(b)) AS e, SUM(q * ln(p) - bq * ln(b)) AS m,
                    SUM(q * ln(p) * ln(p) - bq * ln(b) * ln(b)) AS m2 FROM seen GROUP BY ctx), tots),
qv AS (SELECT s.ctx, s.tok, cc.cc IS NOT NULL AS known,
              CASE WHEN cc.cc IS NULL THEN U.u ELSE {lam} * COALESCE(bg.c, 0) / cc.cc + {back} * U.u END AS v
       FROM (SELECT DISTINCT ctx, tok FROM sp) s JOIN U ON U.token = s.tok
       LEFT JOIN cc ON cc.ctx = s.ctx LEFT JOIN bg ON bg.ctx = s.ctx AND bg.tok = s.tok),
near AS (SELECT q.ctx, q.tok, COUNT(*) FILTER (WHERE n.p > q.v OR (n.p = q.v AND n.tok < q.tok))
                - COUNT(*) FILTER (WHERE n.b > q.v OR (n.b = q.v AND n.tok < q.tok)) AS a
         FROM qv q JOIN seen n ON n.ctx = q.ctx GROUP BY q.ctx, q.tok),
lanes AS (SELECT lane, ctx, tok, SUM(w) OVER (PARTITION BY lane ORDER BY v DESC, tok, w ROWS UNBOUNDED PRECEDING) AS g
          FROM (SELECT true AS lane, NULL AS ctx, token AS tok, {back} * u AS v, 1 AS w FROM U
                UNION ALL SELECT false, NULL, token, u, 1 FROM U
                UNION ALL SELECT known, ctx, tok, v, 0 FROM qv)),
rk AS (SELECT q.ctx, q.tok, ln(q.v) AS lp, 1 + l.g + COALESCE(n.a, 0) AS rank
       FROM qv q JOIN lanes l ON l.ctx = q.ctx AND l.tok = q.tok LEFT JOIN near n ON n.ctx = q.ctx AND n.tok = q.tok),
j AS (SELECT sp.doc_id, sp.ctx, sp.tok, rk.lp, rk.rank, COALESCE(cs.entropy, -k1) AS entropy, COALESCE(cs.mean, k1) AS mean,
             COALESCE(cs.var, k2 - k1 * k1) AS var
      FROM sp JOIN rk ON rk.ctx = sp.ctx AND rk.tok = sp.tok LEFT JOIN cs ON cs.ctx = sp.ctx, tots)"""


def crit_sql(scored: str, vocabulary: int | None = V) -> str:
    """CTE ``crit``: per-document criteria of ``scored`` (all docs kept)."""
    return f"""{lm_sql(scored, vocabulary) if vocabulary else sparse_sql(scored)},
agg AS (SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_tokens, AVG(lp) AS likelihood, -AVG(rank) AS rank,
               -AVG(ln(rank)) AS logrank, AVG(entropy) AS entropy,
               (SUM(lp) - SUM(mean)) / SQRT(SUM(var)) AS curvature FROM j GROUP BY doc_id),
crit AS (SELECT s.doc_id, agg.n_tokens, agg.likelihood, agg.rank, agg.logrank, agg.entropy, agg.curvature
         FROM {scored} s LEFT JOIN agg ON s.doc_id = agg.doc_id)"""


def model_for(spark, sf_dir, vocabulary: int | None = V):
    """The token model of ``sf_dir``'s documents, as a cached artifact
    (S11): read from the model store under the shared checkpoint folder,
    trained and written there on a miss."""
    return LM.load_or_train(spark, table(spark, sf_dir, "documents"), f"{sf_dir}/documents.parquet", V=vocabulary)


def conv_criteria(spark, sf_dir, vocabulary: int | None = V):
    texts = labelled_conversations(spark, sf_dir)
    crit = LM.criteria(model_for(spark, sf_dir, vocabulary), texts, LAM, LAM_REF)
    return crit.join(texts.select("doc_id", "result"), "doc_id")


def _r(c: str):
    return F.round(c, 6).alias(c)


@register("x4_context_stats", f"""WITH {lm_sql(LABELLED_CONV)}
SELECT cs.ctx, ROUND(cs.entropy, 6) AS entropy, ROUND(cs.mean, 6) AS mean, ROUND(cs.var, 6) AS var,
       CAST(COALESCE(cc.cc, 0) AS BIGINT) AS cc
FROM cs LEFT JOIN cc ON cs.ctx = cc.ctx""")
def x4_context_stats(spark, sf_dir):
    m = model_for(spark, sf_dir)
    cs = LM.context_stats(m, LAM, LAM_REF)
    k = LM.vocab_constants(m, LAM, LAM_REF)
    dent, dmean, dvar = LM.default_stats(k)
    ctxs = m.vocab.select(F.col("token").alias("ctx")).join(
        m.bigrams.select("ctx", "cc").distinct(), "ctx", "left")
    seen = ctxs.join(F.broadcast(cs.where(F.col("ctx").isNotNull())), "ctx", "left")
    out = seen.select(
        "ctx",
        F.coalesce("entropy", dent).alias("entropy"),
        F.coalesce("mean", dmean).alias("mean"),
        F.coalesce("var", dvar).alias("var"),
        F.coalesce("cc", F.lit(0)).cast("bigint").alias("cc"))
    return out.select("ctx", _r("entropy"), _r("mean"), _r("var"), "cc")


@register("w1_pair_ranks", f"""WITH {lm_sql(LABELLED_CONV)}
SELECT DISTINCT ctx, tok, ROUND(lp, 6) AS lp, CAST(rank AS BIGINT) AS rank FROM j""")
def w1_pair_ranks(spark, sf_dir):
    m = model_for(spark, sf_dir)
    pos = m.map_words(LM.positions(labelled_conversations(spark, sf_dir)))
    ps = LM.pair_stats(m, pos.select("ctx", "tok").distinct(), LAM)
    return ps.select("ctx", "tok", _r("lp"), "rank")


@register("x1_criteria_conversations", f"""WITH {crit_sql(LABELLED_CONV)}
SELECT c.doc_id, l.result, c.n_tokens, ROUND(c.likelihood, 6) AS likelihood, ROUND(c.rank, 6) AS rank,
       ROUND(c.logrank, 6) AS logrank, ROUND(c.entropy, 6) AS entropy, ROUND(c.curvature, 6) AS curvature
FROM crit c JOIN {LABELLED_CONV} l ON c.doc_id = l.doc_id""")
def x1_criteria_conversations(spark, sf_dir):
    c = conv_criteria(spark, sf_dir)
    return c.select("doc_id", "result", "n_tokens", *[_r(k) for k in LM.CRITERIA])


SMALL_V = 150


@register("x1_criteria_small_vocabulary", f"""WITH {crit_sql(LABELLED_CONV, SMALL_V)}
SELECT c.doc_id, c.n_tokens, ROUND(c.likelihood, 6) AS likelihood, ROUND(c.rank, 6) AS rank,
       ROUND(c.logrank, 6) AS logrank, ROUND(c.entropy, 6) AS entropy, ROUND(c.curvature, 6) AS curvature FROM crit c""")
def x1_criteria_small_vocabulary(spark, sf_dir):
    """The criteria under another vocabulary size (V is a parameter)."""
    c = conv_criteria(spark, sf_dir, SMALL_V)
    return c.select("doc_id", "n_tokens", *[_r(k) for k in LM.CRITERIA])


@register("x1_criteria_whole_vocabulary", f"""WITH {crit_sql(LABELLED_CONV, None)}
SELECT c.doc_id, l.result, c.n_tokens, ROUND(c.likelihood, 6) AS likelihood, ROUND(c.rank, 6) AS rank,
       ROUND(c.logrank, 6) AS logrank, ROUND(c.entropy, 6) AS entropy, ROUND(c.curvature, 6) AS curvature
FROM crit c JOIN {LABELLED_CONV} l ON c.doc_id = l.doc_id""")
def x1_criteria_whole_vocabulary(spark, sf_dir):
    """The criteria with every word of ``documents`` in the vocabulary."""
    c = conv_criteria(spark, sf_dir, None)
    return c.select("doc_id", "result", "n_tokens", *[_r(k) for k in LM.CRITERIA])


_CRIT_LONG = "(" + " UNION ALL ".join(
    f"SELECT '{k}' AS criterion, {k} AS score, result AS label FROM crit JOIN {LABELLED_CONV} l USING (doc_id)"
    for k in LM.CRITERIA) + ")"


@register("x1_criteria_auroc", f"""WITH {crit_sql(LABELLED_CONV)},
a AS ({auroc_sql(_CRIT_LONG, ['criterion'])})
SELECT * FROM a""")
def x1_criteria_auroc(spark, sf_dir):
    long = LM.long_criteria(conv_criteria(spark, sf_dir), ["doc_id", "result as label"])
    return ev.auroc(long, "criterion", digits=6)


@register("a23_criteria_class_stats", f"""WITH {crit_sql(LABELLED_CONV)}
SELECT l.result AS label, ROUND(AVG(c.curvature), 6) AS mean, ROUND(STDDEV_POP(c.curvature), 6) AS std,
       CAST(COUNT(c.curvature) AS BIGINT) AS n
FROM crit c JOIN {LABELLED_CONV} l ON c.doc_id = l.doc_id GROUP BY l.result""")
def a23_criteria_class_stats(spark, sf_dir):
    c = conv_criteria(spark, sf_dir).select(F.col("curvature").alias("score"), F.col("result").alias("label"))
    r = ev.class_stats(c)
    return r.select("label", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@register("a24_calibration_fit", f"""WITH {crit_sql(LABELLED_CONV)},
s AS (SELECT l.result, AVG(c.curvature) AS mu, STDDEV_SAMP(c.curvature) AS sd
      FROM crit c JOIN {LABELLED_CONV} l ON c.doc_id = l.doc_id WHERE c.curvature IS NOT NULL GROUP BY l.result)
SELECT ROUND((SELECT mu FROM s WHERE result = 0), 6) AS mu0, ROUND((SELECT sd FROM s WHERE result = 0), 6) AS sigma0,
       ROUND((SELECT mu FROM s WHERE result = 1), 6) AS mu1,
       ROUND(2 * (SELECT sd FROM s WHERE result = 0), 6) AS sigma1""")
def a24_calibration_fit(spark, sf_dir):
    """Class means and spreads on a development set; the machine
    spread is set to twice the human one, as in the reference's rule."""
    c = conv_criteria(spark, sf_dir).where(F.col("curvature").isNotNull())
    s = c.groupBy().agg(
        F.avg(F.when(F.col("result") == 0, F.col("curvature"))).alias("mu0"),
        F.stddev_samp(F.when(F.col("result") == 0, F.col("curvature"))).alias("sigma0"),
        F.avg(F.when(F.col("result") == 1, F.col("curvature"))).alias("mu1"))
    s = s.withColumn("sigma1", 2 * F.col("sigma0"))
    return s.select(*[F.round(k, 6).alias(k) for k in ("mu0", "sigma0", "mu1", "sigma1")])


def calibration_table(spark):
    """The fixed calibration rows as a small DataFrame."""
    return spark.createDataFrame(CALIBRATION, "model_pair string, mu0 double, sigma0 double, "
                                              "mu1 double, sigma1 double")


def posterior(x, mu0, sigma0, mu1, sigma1):
    """M4: p(machine | x) = pdf1 / (pdf0 + pdf1) for two normals, computed
    in log space so far tails give 0/1 instead of 0/0."""
    l0 = -((x - mu0) ** 2) / (2 * sigma0 ** 2) - F.ln(sigma0)
    l1 = -((x - mu1) ** 2) / (2 * sigma1 ** 2) - F.ln(sigma1)
    return 1.0 / (1.0 + F.exp(l0 - l1))


def detector_probability(spark, crit, model_pair: str = MODEL_PAIR):
    """(prob, crit, n_tokens) per text, with the calibration row joined
    by model-pair key; a missing key raises (J9)."""
    cal = calibration_table(spark).where(F.col("model_pair") == model_pair)
    x = crit.withColumn("model_pair", F.lit(model_pair)).join(F.broadcast(cal), "model_pair", "left")
    ok = F.when(F.col("mu0").isNull(), F.raise_error(F.lit(f"unknown model pair {model_pair}")).cast("boolean")
                ).otherwise(F.lit(True))
    x = x.where(ok)
    return x.withColumn("prob", posterior(F.col("curvature"), F.col("mu0"), F.col("sigma0"),
                                          F.col("mu1"), F.col("sigma1")))


def _post_sql(x: str) -> str:
    name, mu0, s0, mu1, s1 = [c for c in CALIBRATION if c[0] == MODEL_PAIR][0]
    l0 = f"(-(({x}) - {_d(mu0)}) * (({x}) - {_d(mu0)}) / (2 * {_d(s0)} * {_d(s0)}) - ln({_d(s0)}))"
    l1 = f"(-(({x}) - {_d(mu1)}) * (({x}) - {_d(mu1)}) / (2 * {_d(s1)} * {_d(s1)}) - ln({_d(s1)}))"
    return f"1.0 / (1.0 + exp({l0} - {l1}))"


_DOC_PROB = f"(SELECT c.doc_id, l.lang, l.result AS label, {_post_sql('c.curvature')} AS prob FROM crit c JOIN {LABELLED_DOCS} l ON c.doc_id = l.doc_id)"


@register("x3_detector_auroc_by_lang", f"""WITH {crit_sql(LABELLED_DOCS)},
a AS ({auroc_sql(_DOC_PROB, ['lang'], score='prob')})
SELECT lang, '{MODEL_PAIR.split('_')[0]}' AS sampling_model_name, '{MODEL_PAIR.split('_')[1]}' AS scoring_model_name,
       'documents/' || lang AS dataset_path, ROUND(auroc, 4) AS auroc, n_pos, n_neg FROM a""")
def x3_detector_auroc_by_lang(spark, sf_dir):
    """X3 + A18 + M6 + D14: detection AUROC of the calibrated probability
    per language, as result records (rounded to 4 places)."""
    docs = labelled_documents(spark, sf_dir)
    crit = LM.criteria(model_for(spark, sf_dir), docs, LAM, LAM_REF)
    scored = detector_probability(spark, crit).join(docs.select("doc_id", "lang", F.col("result").alias("label")),
                                                    "doc_id")
    a = ev.auroc(scored, "lang", score="prob")
    samp, scor = MODEL_PAIR.split("_")
    return a.select("lang", F.lit(samp).alias("sampling_model_name"), F.lit(scor).alias("scoring_model_name"),
                    F.concat(F.lit("documents/"), F.col("lang")).alias("dataset_path"),
                    F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg")


def _md5_number(parts: str, start: int = 1, digits: int = 15) -> str:
    return f"CAST('0x' || substr(md5({parts}), {start}, {digits}) AS BIGINT)"


def draws_sql(scored: str, n_draws: int, seed: int) -> str:
    """CTE ``dr`` (doc_id, pos, draw, ctx, sample, tok) of draws from the
    reference distribution; needs the CTEs of :func:`lm_sql`."""
    key = f"'{seed}:' || doc_id || ':' || pos || ':' || draw"
    return f"""
al0 AS (SELECT ctx, tok, c FROM bg UNION ALL SELECT '', token, c + 1 FROM U),
al1 AS (SELECT ctx, tok, COUNT(*) OVER (PARTITION BY ctx) AS slots, CAST(SUM(c) OVER (PARTITION BY ctx) AS BIGINT) AS total,
               ROW_NUMBER() OVER (PARTITION BY ctx ORDER BY tok) - 1 AS slot, c FROM al0),
al2 AS (SELECT *, CAST(c * slots AS BIGINT) AS own, c * slots > total AS heavy FROM al1),
al3 AS (SELECT *, SUM(abs(own - total)) OVER (PARTITION BY ctx, heavy ORDER BY tok ROWS UNBOUNDED PRECEDING) AS run FROM al2),
al4 AS (SELECT *, CASE WHEN heavy THEN run ELSE run - (total - own) END AS k FROM al3),
al5 AS (SELECT *, first_value(CASE WHEN heavy THEN tok END IGNORE NULLS) OVER
                    (PARTITION BY ctx ORDER BY k, heavy DESC, tok ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
               MAX(CASE WHEN NOT heavy THEN run END) OVER
                    (PARTITION BY ctx ORDER BY k, heavy DESC, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM al4),
al AS (SELECT ctx, slot, tok, CASE WHEN heavy THEN total + run - done ELSE own END AS cut, COALESCE(nxt, tok) AS other, slots, total FROM al5),
ps0 AS (SELECT doc_id, p[1] AS wa, p[2] AS wb, p[3] AS pos FROM (SELECT doc_id, UNNEST(list_transform(range(2, len(W) + 1),
          lambda i: [W[i - 1], W[i], CAST(i AS VARCHAR)])) AS p FROM (SELECT doc_id, {words('text')} AS W FROM {scored}))),
ps AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, COALESCE(ta.token, '{LM.UNK}') AS ctx, COALESCE(tb.token, '{LM.UNK}') AS tok
       FROM ps0 LEFT JOIN top ta ON wa = ta.token LEFT JOIN top tb ON wb = tb.token),
dr0 AS (SELECT ps.*, draw, {_md5_number(key)} AS r, {_md5_number(key, 16, 8)} < {int(LAM_REF * (1 << 32))} AS own
        FROM ps, (SELECT range AS draw FROM range({n_draws}))),
dr1 AS (SELECT d.*, CASE WHEN own AND cc.ctx IS NOT NULL THEN d.ctx ELSE '' END AS src FROM dr0 d LEFT JOIN cc ON cc.ctx = d.ctx),
sz AS (SELECT DISTINCT ctx, slots, total FROM al),
dr2 AS (SELECT d.*, (r % (slots * total)) // total AS slot, (r % (slots * total)) % total AS rest FROM dr1 d JOIN sz ON sz.ctx = d.src),
dr AS (SELECT d.doc_id, d.pos, d.draw, d.ctx, d.tok, CASE WHEN rest < al.cut THEN al.tok ELSE al.other END AS sample
       FROM dr2 d JOIN al ON al.ctx = d.src AND al.slot = d.slot)"""


DRAWS, DRAW_PAIRS, DRAW_SEED = 2, 4, 11


@register("a15_reference_draws", f"""WITH {lm_sql(LABELLED_CONV)}, {draws_sql(LABELLED_CONV, DRAWS, DRAW_SEED)}
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(draw AS INTEGER) AS draw, ctx, sample FROM dr""")
def a15_reference_draws(spark, sf_dir):
    """Two tokens drawn from the reference distribution at every
    position of the labelled conversations."""
    m = model_for(spark, sf_dir)
    pos = m.map_words(LM.positions(labelled_conversations(spark, sf_dir)))
    return SP.sampled_tokens(m, pos, DRAWS, DRAW_SEED, LAM_REF)


@register("x2_sampled_curvature", f"""WITH {lm_sql(LABELLED_CONV)}, {draws_sql(LABELLED_CONV, 2 * DRAW_PAIRS, DRAW_SEED)},
lps AS (SELECT k.ctx, k.tok, ln(CASE WHEN cc.cc IS NULL THEN U.u ELSE {_d(LAM)} * COALESCE(bg.c, 0) / cc.cc + {_d(1.0 - LAM)} * U.u END) AS lp
        FROM (SELECT ctx, sample AS tok FROM dr UNION SELECT ctx, tok FROM dr) k JOIN U ON U.token = k.tok
        LEFT JOIN cc ON cc.ctx = k.ctx LEFT JOIN bg ON bg.ctx = k.ctx AND bg.tok = k.tok),
l AS (SELECT d.doc_id, d.pos, d.draw // 2 AS pair, d.draw % 2 AS side, s.lp, t.lp AS truth
      FROM dr d JOIN lps s ON s.ctx = d.ctx AND s.tok = d.sample JOIN lps t ON t.ctx = d.ctx AND t.tok = d.tok),
w AS (SELECT doc_id, pos, pair, MAX(truth) AS truth, MAX(CASE WHEN side = 0 THEN lp END) AS a, MAX(CASE WHEN side = 1 THEN lp END) AS b
      FROM l GROUP BY doc_id, pos, pair),
e AS (SELECT doc_id, CAST(COUNT(*) / {DRAW_PAIRS} AS BIGINT) AS n_tokens,
             (SUM(truth) / {DRAW_PAIRS} - SUM(a + b) / {2 * DRAW_PAIRS}) / NULLIF(SQRT(SUM((a - b) * (a - b)) / {2 * DRAW_PAIRS}), 0) AS c
      FROM w GROUP BY doc_id)
SELECT s.doc_id, e.n_tokens, ROUND(e.c, 6) AS curvature FROM {LABELLED_CONV} s LEFT JOIN e ON e.doc_id = s.doc_id""")
def x2_sampled_curvature(spark, sf_dir):
    """X2, sampled branch: eight draws a position, mean and variance merged
    per document."""
    c = SP.sampled_curvature(model_for(spark, sf_dir), labelled_conversations(spark, sf_dir), DRAW_PAIRS, LAM, LAM_REF, DRAW_SEED)
    return c.select("doc_id", "n_tokens", _r("curvature"))


_TOK_B_SQL = "list_filter(string_split(text, ' '), lambda x: x <> '')"


@register("p17_tokeniser_agreement", f"""
WITH a AS (SELECT doc_id, UNNEST(W) AS t, generate_subscripts(W, 1) AS pos
           FROM (SELECT doc_id, {words('text')} AS W FROM {LABELLED_CONV})),
b AS (SELECT doc_id, UNNEST(W) AS t, generate_subscripts(W, 1) AS pos
      FROM (SELECT doc_id, {_TOK_B_SQL} AS W FROM {LABELLED_CONV})),
j AS (SELECT COALESCE(a.doc_id, b.doc_id) AS doc_id, a.t AS ta, b.t AS tb
      FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos)
SELECT doc_id, CAST(COUNT(ta) AS BIGINT) AS n_a, CAST(COUNT(tb) AS BIGINT) AS n_b,
       CAST(SUM(CASE WHEN ta IS DISTINCT FROM tb THEN 1 ELSE 0 END) AS BIGINT) AS n_mismatch
FROM j GROUP BY doc_id HAVING SUM(CASE WHEN ta IS DISTINCT FROM tb THEN 1 ELSE 0 END) > 0""")
def p17_tokeniser_agreement(spark, sf_dir):
    """The white-space tokeniser against a space-only tokeniser; the
    documents where they disagree (a run with two scoring models would
    fail on any of them, see ``assert_same_tokens``)."""
    from inkwell.functions import text as T
    texts = labelled_conversations(spark, sf_dir)
    space_tok = lambda c: F.filter(F.split(c, " ", -1), lambda w: w != F.lit(""))
    mm = LM.tokenisation_mismatches(texts, T.words, space_tok)
    return mm.where(F.col("n_mismatch") > 0)


_SHAPE = {"top_k": 40, "top_p": 0.96, "temperature": 0.8}


@register("a29_shaped_bigram_distributions", f"""WITH {lm_sql(LABELLED_CONV)},
b AS (SELECT bg.ctx, bg.tok, bg.c, cc.cc FROM bg JOIN cc ON bg.ctx = cc.ctx),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ctx ORDER BY c DESC, tok) AS rn,
             COALESCE(SUM(c) OVER (PARTITION BY ctx ORDER BY c DESC, tok
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM b),
k AS (SELECT ctx, tok, c FROM o WHERE rn <= {_SHAPE['top_k']}),
p AS (SELECT ctx, tok, c FROM o WHERE before < {_d(_SHAPE['top_p'])} * cc),
t AS (SELECT ctx, tok, pow(c / cc, {_d(1.0 / _SHAPE['temperature'])}) AS w FROM b)
SELECT ctx, tok, 'top_k' AS mode, ROUND(c / SUM(c) OVER (PARTITION BY ctx), 6) AS p FROM k
UNION ALL SELECT ctx, tok, 'top_p', ROUND(c / SUM(c) OVER (PARTITION BY ctx), 6) FROM p
UNION ALL SELECT ctx, tok, 'temperature', ROUND(w / SUM(w) OVER (PARTITION BY ctx), 6) FROM t""")
def a29_shaped_bigram_distributions(spark, sf_dir):
    """A29 on the counted next-token distributions: top-k 40, top-p 0.96
    and temperature 0.8 (each mode separately, as the first set flag
    wins in the reference)."""
    m = model_for(spark, sf_dir)
    dist = m.bigrams.select("ctx", "tok", "c")
    out = None
    for mode in ("top_k", "top_p", "temperature"):
        s = LM.shape_distribution(dist, mode, _SHAPE["top_k"], _SHAPE["top_p"], _SHAPE["temperature"])
        s = s.select("ctx", "tok", F.lit(mode).alias("mode"), F.round("p", 6).alias("p"))
        out = s if out is None else out.unionByName(s)
    return out
