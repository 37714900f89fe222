"""Classifier queries (X5-X11, A21, A22, A26, A27).  The per-group trainer is
deterministic (zero start, rows in id order), so the oracle SQL replays it
step by step with a recursive CTE; the reweighted least squares of X5, X10 and
A26 are replayed with their systems solved by elimination.  The network fitted
by MLlib carries no oracle SQL (unit tests check its properties)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import classify as CL
from inkwell.operators import curate as C
from inkwell.operators import evaluate as ev
from inkwell.operators import lm as LM
from inkwell.operators import vectors as VE
from inkwell.operators.ordering import top_n_by_hash
from inkwell.plans import criteria as CR
from inkwell.plans import sqlfrag
from inkwell.plans import vectorq as VQ
from inkwell.plans.registry import register
from inkwell.session import materialize, table
from inkwell.sources.tables import labelled_conversations, labelled_documents

# Reference defaults: 160 training rows, 10 epochs.
TRAIN_ROWS, EPOCHS, LR = 160, 10, 0.003


def labelled_vectors(spark, sf_dir):
    """Long per-layer vectors of the embeddings that have a label (J1);
    ``dataset`` is the embedding's own label column."""
    long = VQ.long_vectors(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    ds = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dataset"))
    return long.join(lab, "doc_id").join(ds, "doc_id")


def doc_splits(docs, label="label", id_col="doc_id", train_rows=TRAIN_ROWS):
    """Per document: 'test' (20 %, stratified), then from the rest 'valid'
    (10 %) and 'train' (O4 + O8).  ``train_rows`` bounds the rows that a
    classifier is fitted on, as in the reference; validation and test use all
    of theirs."""
    s1 = C.stratified_fraction_split(docs.select(id_col, label), label, id_col, 0.2, seed="t")
    rest = s1.where(F.col("split") == "train").drop("split")
    s2 = C.stratified_fraction_split(rest, label, id_col, 0.1, seed="v", names=("train", "valid"))
    train = top_n_by_hash(s2.where(F.col("split") == "train"), None, train_rows, id_col, seed="h").drop("rn")
    valid = s2.where(F.col("split") == "valid")
    test = s1.where(F.col("split") == "test")
    parts = [d.select(id_col, "split") for d in (train, valid, test)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _splits_sql() -> str:
    """CTEs of ``doc_splits`` over the labelled embeddings: vd (rows with all
    layers), s1 (is_test), s2 (is_test = valid), trn (ids to fit on)."""
    from inkwell.plans.sqlfrag import frac_split_sql, md5_key
    return f"""
vd AS (SELECT e.vec_id AS doc_id, CAST(l.quality AS INTEGER) AS label, e.label AS dataset,
              list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS v
       FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id),
dd AS (SELECT DISTINCT doc_id, label FROM vd),
{frac_split_sql('dd', 'label', 'doc_id', 0.2, 't', 's1')},
rs AS (SELECT doc_id, label FROM s1 WHERE NOT is_test),
{frac_split_sql('rs', 'label', 'doc_id', 0.1, 'v', 's2')},
trn AS (SELECT doc_id FROM (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY {md5_key('doc_id', 'h')}, doc_id) AS r
                            FROM s2 WHERE NOT is_test) WHERE r <= {TRAIN_ROWS})"""


def _trained_sql(rows: str, dim: int, out: str, batch: int = 16) -> str:
    """CTEs: the trainer replayed on ``rows`` (key, doc_id, x, y), one
    recursion step a mini-batch; ``out`` (key, w, b, loss, n)."""
    one = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    dims, zeros = f"range(1, {dim + 1})", "[" + ", ".join([one(0.0)] * dim) + "]"
    m, v, eps, lr = one(0.9), one(0.999), one(1e-8), one(LR)
    m1, v1 = one(1 - 0.9), one(1 - 0.999)
    step = lambda a, c: f"{lr} * ({a} / (1 - pow({m}, t + 1))) / (sqrt({c} / (1 - pow({v}, t + 1))) + {eps})"
    clip = f"least(greatest(p[i], {one(1e-12)}), 1 - {one(1e-12)})"
    return f"""
{out}_r AS (SELECT key, x, CAST(y AS DOUBLE) AS y, ROW_NUMBER() OVER (PARTITION BY key ORDER BY doc_id) - 1 AS r,
                   COUNT(*) OVER (PARTITION BY key) AS total FROM {rows}),
{out}_b AS (SELECT key, r // {batch} AS k, COUNT(*) AS n, (MAX(total) + {batch - 1}) // {batch} AS nb, MAX(total) AS total,
                   list(x ORDER BY r) AS x, list(y ORDER BY r) AS y FROM {out}_r GROUP BY key, r // {batch}),
{out}_s AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS t, {zeros} AS w, {one(0.0)} AS b, {zeros} AS mw, {zeros} AS vw,
         {one(0.0)} AS mb, {one(0.0)} AS vb, {one(0.0)} AS loss FROM {out}_b
  UNION ALL
  SELECT key, t + 1, list_transform({dims}, lambda d: w[d] - {step('mw2[d]', 'vw2[d]')}), b - {step('mb2', 'vb2')},
         mw2, vw2, mb2, vb2, loss2
  FROM (SELECT *, list_transform({dims}, lambda d: {m} * mw[d] + {m1} * gw[d]) AS mw2,
               list_transform({dims}, lambda d: {v} * vw[d] + {v1} * gw[d] * gw[d]) AS vw2,
               {m} * mb + {m1} * gb AS mb2, {v} * vb + {v1} * gb * gb AS vb2
        FROM (SELECT *, list_transform({dims}, lambda d: list_sum(list_transform(range(1, n + 1), lambda i: x[i][d] * e[i])) / n) AS gw,
                     list_sum(e) / n AS gb
              FROM (SELECT *, list_transform(range(1, n + 1), lambda i: p[i] - y[i]) AS e,
                           -list_sum(list_transform(range(1, n + 1), lambda i: y[i] * ln({clip}) + (1 - y[i]) * ln(1 - {clip}))) / n AS loss2
                    FROM (SELECT s.*, b.n, b.x, b.y, list_transform(range(1, b.n + 1), lambda i:
                                 1 / (1 + exp(-(list_sum(list_transform({dims}, lambda d: b.x[i][d] * s.w[d])) + s.b)))) AS p
                          FROM {out}_s s JOIN {out}_b b ON b.key = s.key AND b.k = s.t % b.nb WHERE s.t < {EPOCHS} * b.nb)))))
,
{out} AS (SELECT s.key, s.w, s.b, s.loss, b.total AS n FROM {out}_s s JOIN {out}_b b ON b.key = s.key AND b.k = 0
          WHERE s.t = {EPOCHS} * b.nb)"""


def _prob_sql(x: str, w: str, b: str, dim: int) -> str:
    return f"1 / (1 + exp(-(list_sum(list_transform(range(1, {dim + 1}), lambda d: {x}[d] * {w}[d])) + {b})))"


def _x9_sql() -> str:
    from inkwell.plans.sqlfrag import auroc_sql
    return f"""WITH RECURSIVE {VQ._kl_sql().lstrip()}, {_splits_sql().lstrip()},
x AS (SELECT vd.doc_id, vd.label, vd.dataset, vd.v[best.best_layer * {VQ.DIM} + 1: best.best_layer * {VQ.DIM} + {VQ.DIM}] AS x
      FROM vd JOIN best ON best.doc_id = vd.doc_id),
fit AS (SELECT 0 AS key, x.doc_id, x.x, x.label AS y FROM x JOIN trn ON trn.doc_id = x.doc_id),
{_trained_sql('fit', VQ.DIM, 'mod').lstrip()},
sc AS (SELECT x.doc_id, x.label, x.dataset, {_prob_sql('x.x', 'mod.w', 'mod.b', VQ.DIM)} AS score FROM x, mod),
va AS (SELECT sc.label, least(greatest(sc.score, 1e-12), 1 - 1e-12) AS p FROM sc JOIN s2 ON s2.doc_id = sc.doc_id WHERE s2.is_test),
vm AS (SELECT ROUND(AVG(CASE WHEN (p > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 4) AS acc,
             ROUND(-AVG(label * ln(p) + (1 - label) * ln(1 - p)), 4) AS loss FROM va),
te AS (SELECT sc.dataset, sc.label, sc.score FROM sc JOIN s1 ON s1.doc_id = sc.doc_id WHERE s1.is_test),
a AS ({auroc_sql('te', ['dataset'])})
SELECT a.dataset, ROUND(a.auroc, 4) AS auroc, n_pos, n_neg, vm.acc AS valid_accuracy, vm.loss AS valid_loss FROM a, vm"""


@register("x9_maxkl_classifier_auroc", _x9_sql())
def x9_maxkl_classifier_auroc(spark, sf_dir):
    """X8 (max-KL mode) -> X5 fit -> X6 score -> A18 by dataset, with A21
    accuracy and A27 loss on the validation rows (X9)."""
    vecs = labelled_vectors(spark, sf_dir)
    sel = VE.select_layer(vecs, -1, VQ.kl_table(spark, sf_dir))
    sp = doc_splits(sel.select("doc_id", "label").distinct())
    x = materialize(sel.join(sp, "doc_id").withColumn("one", F.lit(0)))
    weights = CL.train_per_group(x.where(F.col("split") == "train"), "one", "vec", "label", epochs=EPOCHS, lr=LR)
    scored = CL.score_linear(x.where(F.col("split").isin("valid", "test")), weights, "one")
    scored = materialize(scored.withColumn("pred", (F.col("prob") > 0.5).cast("int")))
    valid = scored.where(F.col("split") == "valid")
    acc = ev.accuracy(valid).select("accuracy")
    loss = ev.cross_entropy(valid.withColumn("prob", F.least(F.greatest("prob", F.lit(1e-12)), F.lit(1 - 1e-12))))
    au = ev.auroc(scored.where(F.col("split") == "test").select("dataset", F.col("prob").alias("score"), "label"),
                  "dataset")
    return au.select("dataset", F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg",
                     F.round(acc.scalar(), 4).alias("valid_accuracy"),
                     F.round(loss.select("loss").scalar(), 4).alias("valid_loss"))


@register("x5_network_auroc")
def x5_network_auroc(spark, sf_dir):
    """X5 with two hidden layers on the max-KL layer's vector: AUROC of the
    test rows by dataset."""
    sel = VE.select_layer(labelled_vectors(spark, sf_dir), -1, VQ.kl_table(spark, sf_dir))
    x = materialize(sel.join(doc_splits(sel.select("doc_id", "label").distinct()), "doc_id"))
    model = CL.fit(x.where(F.col("split") == "train"), "vec", "label", "mlp", hidden=(16, 8), max_iter=60)
    s = CL.score(model, x.where(F.col("split") == "test"))
    au = ev.auroc(s.select("dataset", F.col("prob").alias("score"), "label"), "dataset")
    return au.select("dataset", F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg")


def _x7_sql() -> str:
    from inkwell.plans.sqlfrag import auroc_sql
    return f"""WITH RECURSIVE {_splits_sql().lstrip()},
x AS (SELECT doc_id, label, dataset, l.l AS layer, v[l.l * {VQ.DIM} + 1: l.l * {VQ.DIM} + {VQ.DIM}] AS x
      FROM vd, (SELECT CAST(range AS INTEGER) AS l FROM range({VQ.N_LAYERS})) l),
fit AS (SELECT layer AS key, x.doc_id, x.x, x.label AS y FROM x JOIN trn ON trn.doc_id = x.doc_id),
{_trained_sql('fit', VQ.DIM, 'mod').lstrip()},
te AS (SELECT x.layer, x.dataset, x.label, {_prob_sql('x.x', 'mod.w', 'mod.b', VQ.DIM)} AS score
       FROM x JOIN s1 ON s1.doc_id = x.doc_id AND s1.is_test JOIN mod ON mod.key = x.layer),
c AS ({auroc_sql('te', ['layer', 'dataset'])}),
a AS ({auroc_sql('te', ['layer'])}),
mac AS (SELECT layer, AVG(auroc) AS macro FROM c GROUP BY layer)
SELECT a.layer, ROUND(a.auroc, 4) AS auroc, ROUND(mac.macro, 4) AS macro_auroc, a.n_pos, a.n_neg, ROUND(mod.loss, 4) AS train_loss
FROM a JOIN mac ON mac.layer = a.layer JOIN mod ON mod.key = a.layer"""


@register("x7_layer_sweep_auroc", _x7_sql())
def x7_layer_sweep_auroc(spark, sf_dir):
    """Every layer trains in parallel (one applyInPandas group per
    layer, bounded training rows), test rows are scored in Spark, AUROC per
    layer and dataset, and the A22 macro mean per layer."""
    vecs = labelled_vectors(spark, sf_dir)
    sp = doc_splits(vecs.select("doc_id", "label").distinct())
    x = materialize(vecs.join(sp, "doc_id"))
    weights = materialize(CL.train_per_group(x.where(F.col("split") == "train"), "layer", "vec", "label",
                                             epochs=EPOCHS, lr=LR))
    test = CL.score_linear(x.where(F.col("split") == "test"), weights, "layer")
    test = materialize(test.select("layer", "dataset", F.col("prob").alias("score"), "label"))
    cells = ev.auroc(test, ["layer", "dataset"])
    per_layer = ev.auroc(test.select("layer", "score", "label"), "layer")
    macro = cells.groupBy("layer").agg(F.avg("auroc").alias("macro_auroc"))
    return (per_layer.join(macro, "layer", "left").join(weights.select("layer", "loss"), "layer")
            .select("layer", F.round("auroc", 4).alias("auroc"), F.round("macro_auroc", 4).alias("macro_auroc"),
                    "n_pos", "n_neg", F.round("loss", 4).alias("train_loss")))


def criteria_features(spark, sf_dir, texts):
    crit = LM.criteria(CR.model_for(spark, sf_dir), texts, CR.LAM, CR.LAM_REF)
    crit = crit.where(F.col("curvature").isNotNull())
    return materialize(crit.select("doc_id", F.array(*[F.col(c) for c in LM.CRITERIA]).alias("vec")))


def irls_sql(rows: str, dim: int, out: str, steps: int = 8, ridge: float = 1e-6) -> str:
    """CTEs: :func:`classify.fit_irls` replayed on ``rows`` (key, x, y), one
    step a group of CTEs, solved by elimination; ends with ``out`` (key, mu,
    sc, w, n), w for the scaled features and, last, the intercept."""
    one = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    k = dim + 1
    all_ = f"range(1, {k + 1})"

    def eliminated(m: str, p: int) -> str:
        return (f"list_transform({all_}, lambda r: CASE WHEN r = {p} THEN list_transform({m}[{p}], lambda v: v / {m}[{p}][{p}]) "
                f"ELSE list_transform(range(1, {k + 2}), lambda c: {m}[r][c] - {m}[r][{p}] * {m}[{p}][c] / {m}[{p}][{p}]) END)")

    ctes = [f"""{out}_c AS (SELECT key, i, AVG(x[i]) AS mu, COUNT(*) AS n FROM {rows}, range(1, {dim + 1}) t(i) GROUP BY key, i),
{out}_d AS (SELECT r.key, c.i, MAX(c.mu) AS mu, MAX(c.n) AS n, COALESCE(NULLIF(MAX(abs(r.x[c.i] - c.mu)), 0), 1.0) AS sc
            FROM {rows} r JOIN {out}_c c ON c.key = r.key GROUP BY r.key, c.i),
{out}_m AS (SELECT key, MAX(n) AS n, list(mu ORDER BY i) AS mu, list(sc ORDER BY i) AS sc FROM {out}_d GROUP BY key),
{out}_z AS MATERIALIZED (SELECT r.key, CAST(r.y AS DOUBLE) AS y, list_concat(list_transform(range(1, {dim + 1}), lambda i: (r.x[i] - m.mu[i]) / m.sc[i]), [1.0]) AS z
            FROM {rows} r JOIN {out}_m m ON m.key = r.key),
{out}_w0 AS (SELECT key, n, list_transform({all_}, lambda i: CAST(0 AS DOUBLE)) AS w FROM {out}_m)"""]
    for t in range(steps):
        m = "m0"
        solve = f"(SELECT key, n, w, m AS m0 FROM {out}_a{t})"
        for p in range(1, k + 1):
            solve = f"(SELECT key, n, w, {eliminated(m, p)} AS m{p} FROM {solve})"
            m = f"m{p}"
        ctes.append(f"""{out}_p{t} AS MATERIALIZED (SELECT z.key, z.y, z.z, 1 / (1 + exp(-list_sum(list_transform({all_}, lambda i: z.z[i] * w.w[i])))) AS p
            FROM {out}_z z JOIN {out}_w{t} w ON w.key = z.key),
{out}_h{t} AS (SELECT key, i, j, SUM(p * (1 - p) * z[i] * z[j]) AS h, SUM((y - p) * z[i]) AS g
            FROM {out}_p{t}, range(1, {k + 1}) a(i), range(1, {k + 1}) b(j) GROUP BY key, i, j),
{out}_r{t} AS (SELECT h.key, h.i, list(h.h + CASE WHEN h.i = h.j THEN {one(ridge)} * w.n ELSE 0 END ORDER BY h.j) AS r,
                      MAX(h.g) - {one(ridge)} * MAX(w.n) * MAX(w.w[h.i]) AS g
            FROM {out}_h{t} h JOIN {out}_w{t} w ON w.key = h.key GROUP BY h.key, h.i),
{out}_a{t} AS (SELECT r.key, MAX(w.n) AS n, any_value(w.w) AS w, list(list_append(r.r, r.g) ORDER BY r.i) AS m
            FROM {out}_r{t} r JOIN {out}_w{t} w ON w.key = r.key GROUP BY r.key),
{out}_w{t + 1} AS MATERIALIZED (SELECT key, n, list_transform({all_}, lambda i: w[i] + {m}[i][{k + 1}]) AS w FROM {solve})""")
    return ",\n".join(ctes) + f""",
{out} AS (SELECT m.key, m.mu, m.sc, m.n, w.w FROM {out}_m m JOIN {out}_w{steps} w ON w.key = m.key)"""


def linear_sql(x: str, model: str, dim: int) -> str:
    """The linear score of ``x`` under a row of an :func:`irls_sql` result."""
    return (f"(list_sum(list_transform(range(1, {dim + 1}), lambda i: ({x}[i] - {model}.mu[i]) / {model}.sc[i] * {model}.w[i])) "
            f"+ {model}.w[{dim + 1}])")


_CRIT_VEC = "[" + ", ".join(LM.CRITERIA) + "]"
DOMAINS = ("conversations", "documents", "multilingual")
# Texts of three domains under one id: dialogue, English and other documents.
_DOMAIN_TEXTS = f"""(SELECT doc_id, text, result AS label, 'conversations' AS domain, doc_id AS own FROM {sqlfrag.LABELLED_CONV}
  UNION ALL SELECT doc_id + {1 << 40}, text, result, CASE WHEN lang = 'en' THEN 'documents' ELSE 'multilingual' END, doc_id
  FROM {sqlfrag.LABELLED_DOCS})"""


def _x10_sql() -> str:
    split = []
    for d in DOMAINS:
        split.append(f"""f_{d} AS (SELECT own AS doc_id, label FROM feats WHERE domain = '{d}'),
{sqlfrag.frac_split_sql(f'f_{d}', 'label', 'doc_id', 0.2, 'x', f's_{d}').lstrip()}""")
    parts = " UNION ALL ".join(f"SELECT '{d}' AS domain, doc_id, is_test FROM s_{d}" for d in DOMAINS)
    cells = "(SELECT m.key AS train_domain, f.domain AS test_domain, f.label, " + linear_sql("f.x", "m", len(LM.CRITERIA)) + \
        " AS score FROM parted f, mod m WHERE f.is_test)"
    return f"""WITH {CR.crit_sql('texts').replace('tw AS (', f'texts AS {_DOMAIN_TEXTS}, tw AS (', 1)},
feats AS MATERIALIZED (SELECT t.own, t.domain, t.label, {_CRIT_VEC} AS x FROM crit c JOIN texts t ON t.doc_id = c.doc_id WHERE c.curvature IS NOT NULL),
{", ".join(split)},
parted AS MATERIALIZED (SELECT f.*, p.is_test FROM feats f JOIN ({parts}) p ON p.domain = f.domain AND p.doc_id = f.own),
fit AS (SELECT domain AS key, x, label AS y FROM parted WHERE NOT is_test),
{irls_sql('fit', len(LM.CRITERIA), 'mod')},
a AS ({sqlfrag.auroc_sql(cells, ['train_domain', 'test_domain'])})
SELECT train_domain, {", ".join(f"ROUND(MAX(CASE WHEN test_domain = '{d}' THEN auroc END), 4) AS {d}" for d in DOMAINS)}
FROM a GROUP BY train_domain"""


@register("x10_cross_domain_auroc", _x10_sql())
def x10_cross_domain_auroc(spark, sf_dir):
    """Train on one domain, test on every domain; AUROC matrix with
    one column per test domain (pivot).  The three classifiers are fitted in
    the same passes and every test row is scored under all of them."""
    # All domains are scored in one criteria pass over the union of their
    # texts; ids are made unique per domain.
    conv = labelled_conversations(spark, sf_dir).select(
        "doc_id", "text", F.col("result").alias("label"), F.lit("conversations").alias("domain"))
    docs = labelled_documents(spark, sf_dir).select(
        "doc_id", "text", F.col("result").alias("label"),
        F.when(F.col("lang") == "en", F.lit("documents")).otherwise(F.lit("multilingual")).alias("domain"))
    both = conv.unionByName(docs).withColumn(
        "uid", F.when(F.col("domain") == "conversations", F.lit(0)).otherwise(F.lit(1 << 40)) + F.col("doc_id"))
    crit = LM.criteria(CR.model_for(spark, sf_dir), both.select("uid", "text"), CR.LAM, CR.LAM_REF, id_col="uid")
    crit = crit.where(F.col("curvature").isNotNull()).select(
        F.col("doc_id").alias("uid"), F.array(*[F.col(c) for c in LM.CRITERIA]).alias("vec"))
    feats = materialize(crit.join(both.select("uid", "doc_id", "label", "domain"), "uid").drop("uid"))
    sp = C.stratified_fraction_split(feats.select("doc_id", "domain", "label"), "label", "doc_id", 0.2,
                                     seed="x", group_cols="domain")
    x = materialize(feats.join(sp.select("doc_id", "domain", "split"), ["doc_id", "domain"]))
    weights = CL.fit_irls(x.where(F.col("split") == "train").withColumnRenamed("domain", "train_domain"), "train_domain")
    test = x.where(F.col("split") == "test").select(F.col("domain").alias("test_domain"), "vec", "label")
    a = ev.auroc(CL.linear_scores(test, weights, "train_domain"), ["train_domain", "test_domain"])
    return (a.groupBy("train_domain").pivot("test_domain", list(DOMAINS))
             .agg(F.round(F.first("auroc"), 4)))


def _a26_sql() -> str:
    n = len(LM.CRITERIA)
    cells = f"(SELECT m.key AS train_regime, f.label, {linear_sql('f.x', 'm', n)} AS score FROM parted f, mod m WHERE f.is_test)"
    return f"""WITH {CR.crit_sql(sqlfrag.LABELLED_CONV)},
feats AS MATERIALIZED (SELECT c.doc_id, l.result AS label, {_CRIT_VEC} AS x, {sqlfrag.space_word_count('l.text')} AS n_words
          FROM crit c JOIN {sqlfrag.LABELLED_CONV} l ON l.doc_id = c.doc_id WHERE c.curvature IS NOT NULL),
{sqlfrag.frac_split_sql('feats', 'label', 'doc_id', 0.2, 'r', 'parted').lstrip()},
trn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY n_words, label ORDER BY doc_id) AS pair_k,
               COUNT(*) FILTER (WHERE label = 0) OVER (PARTITION BY n_words) AS h,
               COUNT(*) FILTER (WHERE label = 1) OVER (PARTITION BY n_words) AS m FROM parted WHERE NOT is_test),
fit AS (SELECT 'original' AS key, x, label AS y FROM trn
        UNION ALL SELECT 'length_balanced', x, label FROM trn WHERE pair_k <= least(h, m)),
{irls_sql('fit', n, 'mod')},
a AS ({sqlfrag.auroc_sql(cells, ['train_regime'])})
SELECT train_regime, ROUND(auroc, 4) AS auroc, n_pos, n_neg FROM a"""


@register("a26_train_regime_auroc", _a26_sql())
def a26_train_regime_auroc(spark, sf_dir):
    """The same test rows scored by a classifier trained on all
    training rows and by one trained on the length-balanced subset (J7)."""
    from inkwell.functions import text as T
    conv = labelled_conversations(spark, sf_dir)
    feats = criteria_features(spark, sf_dir, conv).join(
        conv.select("doc_id", F.col("result").alias("label"), T.space_word_count("text").alias("n_words")), "doc_id")
    sp = C.stratified_fraction_split(feats.select("doc_id", "label"), "label", "doc_id", 0.2, seed="r")
    x = materialize(feats.join(sp, ["doc_id", "label"]))
    train = x.where(F.col("split") == "train")
    balanced = C.match_by_length(train.select("doc_id", F.col("label").alias("result"), "n_words"), "n_words")
    regimes = train.withColumn("train_regime", F.lit("original")).unionByName(
        train.join(balanced.select("doc_id"), "doc_id").withColumn("train_regime", F.lit("length_balanced")))
    weights = CL.fit_irls(materialize(regimes), "train_regime")
    a = ev.auroc(CL.linear_scores(x.where(F.col("split") == "test").select("vec", "label"), weights, "train_regime"), "train_regime")
    return a.select("train_regime", F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg")


def _x5_sql() -> str:
    d = VQ.DIM
    return f"""WITH {VQ._kl_sql().lstrip()}, {_splits_sql().lstrip()},
x AS (SELECT vd.doc_id, vd.label, vd.dataset, vd.v[best.best_layer * {d} + 1: best.best_layer * {d} + {d}] AS x
      FROM vd JOIN best ON best.doc_id = vd.doc_id),
fit AS (SELECT 0 AS key, x.x, x.label AS y FROM x JOIN s1 ON s1.doc_id = x.doc_id WHERE NOT s1.is_test),
{irls_sql('fit', d, 'mod')},
te AS (SELECT x.dataset, x.label, {linear_sql('x.x', 'mod', d)} AS score FROM x JOIN s1 ON s1.doc_id = x.doc_id AND s1.is_test, mod),
a AS ({sqlfrag.auroc_sql('te', ['dataset'])})
SELECT a.dataset, ROUND(a.auroc, 4) AS auroc, a.n_pos, a.n_neg, mod.n AS n_train FROM a, mod"""


@register("x5_whole_train_auroc", _x5_sql())
def x5_whole_train_auroc(spark, sf_dir):
    """X5 fitted on every row that is not a test row (no bound on the
    training rows), on the max-KL layer's vector: AUROC by dataset."""
    sel = VE.select_layer(labelled_vectors(spark, sf_dir), -1, VQ.kl_table(spark, sf_dir))
    sp = C.stratified_fraction_split(sel.select("doc_id", "label").distinct(), "label", "doc_id", 0.2, seed="t")
    x = materialize(sel.join(sp.select("doc_id", "split"), "doc_id"))
    weights = CL.fit_irls(x.where(F.col("split") == "train").withColumn("one", F.lit(0)), "one")
    s = CL.linear_scores(x.where(F.col("split") == "test").select("dataset", "vec", "label"), weights, "one")
    a = ev.auroc(s.select("dataset", "score", "label"), "dataset")
    return a.select("dataset", F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg", weights.select("n").scalar().alias("n_train"))


#: Units of the layers of the network that is applied with given weights.
NETWORK = (VQ.DIM, 6, 4, 2)


def network_layers() -> list[tuple]:
    """Weights by rule, so that both engines have the same: unit i of layer l
    weighs input j by sin(7 l + 3 i + j + 1), with bias cos(l + i)."""
    import math
    out = []
    for n, (a, b) in enumerate(zip(NETWORK, NETWORK[1:])):
        w = [[math.sin(7 * n + 3 * i + j + 1) for j in range(a)] for i in range(b)]
        out.append((w, [math.cos(n + i) for i in range(b)], "softmax" if n == len(NETWORK) - 2 else "tanh"))
    return out


def _network_sql() -> str:
    """CTE ``nw`` (doc_id, dataset, label, prob) of the last layer's vectors."""
    src = f"(SELECT doc_id, dataset, label, v[{(VQ.N_LAYERS - 1) * VQ.DIM + 1}:{VQ.N_LAYERS * VQ.DIM}] AS x FROM vd)"
    for n, (a, b) in enumerate(zip(NETWORK, NETWORK[1:])):
        z = (f"list_sum(list_transform(range(0, {a}), lambda j: sin({7 * n} + 3 * i + j + 1) * x[j + 1])) + cos({n} + i)")
        z = f"tanh({z})" if n < len(NETWORK) - 2 else z
        src = f"(SELECT doc_id, dataset, label, list_transform(range(0, {b}), lambda i: {z}) AS x FROM {src})"
    vd = _splits_sql().lstrip().split("dd AS (")[0]
    return f"{vd}nw AS (SELECT doc_id, dataset, label, exp(x[2]) / (exp(x[1]) + exp(x[2])) AS prob FROM {src})"


def _network(spark, sf_dir):
    sel = VE.select_layer(labelled_vectors(spark, sf_dir), VQ.N_LAYERS - 1)
    return CL.forward(sel, network_layers()).withColumn("prob", F.col("probs")[1])


@register("x6_network_forward", f"""WITH {_network_sql()}
SELECT doc_id, ROUND(prob, 6) AS prob, CAST(prob > 0.5 AS INTEGER) AS pred FROM nw""")
def x6_network_forward(spark, sf_dir):
    """Forward pass of a layered network (tanh, softmax) from given
    weights over the last layer's vectors: probability of class 1."""
    return _network(spark, sf_dir).select("doc_id", F.round("prob", 6).alias("prob"), (F.col("prob") > 0.5).cast("int").alias("pred"))


@register("x6_network_accuracy", f"""WITH {_network_sql()}
SELECT dataset, ROUND(AVG(CASE WHEN (prob > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, COUNT(*) AS n,
       ROUND(AVG(-ln(CASE WHEN label = 1 THEN prob ELSE 1 - prob END)), 6) AS loss FROM nw GROUP BY dataset""")
def x6_network_accuracy(spark, sf_dir):
    """X6 with A21 accuracy and A27 loss by dataset."""
    s = materialize(_network(spark, sf_dir).select("dataset", "label", "prob", (F.col("prob") > 0.5).cast("int").alias("pred")))
    a = ev.accuracy(s, "dataset").join(ev.cross_entropy(s, "dataset"), "dataset")
    return a.select("dataset", F.round("accuracy", 6).alias("accuracy"), "n", F.round("loss", 6).alias("loss"))


def _x11_sql() -> str:
    from inkwell.plans.sqlfrag import LABELLED_DOCS, auroc_sql, words
    d = lambda x: f"CAST({x!r} AS DOUBLE)"
    l0 = (f"({d(0.8)} * (list_sum(list_transform(W, lambda x: length(x))) / len(W) - {d(4.5)}) "
          f"+ {d(2.0)} * ({d(0.7)} - len(list_distinct(W)) / len(W)))")
    scored = f"""(SELECT lang, label, CASE WHEN len(W) = 0 THEN 0.5
                  ELSE exp(l0 - (greatest(l0, 0.0) + ln(exp(l0 - greatest(l0, 0.0)) + exp(0.0 - greatest(l0, 0.0)))))
                  END AS score
           FROM (SELECT lang, label, W, CASE WHEN len(W) = 0 THEN NULL ELSE {l0} END AS l0
                 FROM (SELECT lang, result AS label, {words('text')} AS W FROM {LABELLED_DOCS})))"""
    return f"""WITH a AS ({auroc_sql(scored, ['lang'])})
SELECT lang, ROUND(auroc, 4) AS auroc, n_pos, n_neg FROM a"""


@register("x11_sequence_classifier_auroc", _x11_sql())
def x11_sequence_classifier_auroc(spark, sf_dir):
    """X11 + M5 + A18 + M6: an external sequence classifier scores both
    classes per Arrow batch; AUROC by language, rounded to 4 places."""
    docs = labelled_documents(spark, sf_dir)
    s = CL.external_scores(docs.withColumnRenamed("result", "label"), CL.text_feature_scorer, keep=("lang", "label"))
    a = ev.auroc(s.select("lang", F.col("prob").alias("score"), "label"), "lang")
    return a.select("lang", F.round("auroc", 4).alias("auroc"), "n_pos", "n_neg")
