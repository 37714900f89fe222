"""Vector queries: the 64-float ``embeddings`` rows are 8 layers x 8 dims
of one position with an identity output head (fixture F12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import maths as M
from inkwell.operators import vectors as VE
from inkwell.plans.registry import register
from inkwell.session import table

N_LAYERS, DIM = 8, 8
FIRST, LAST, MIDS = 0, N_LAYERS - 1, list(range(1, N_LAYERS - 1))


def long_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return VE.split_layers(e, "embedding", N_LAYERS, DIM, id_col="vec_id")


def kl_table(spark, sf_dir, first=FIRST, mids=None):
    return VE.kl_in_row(table(spark, sf_dir, "embeddings"), "embedding", N_LAYERS, DIM, first, LAST,
                        mids or MIDS, id_col="vec_id")


# The same 64 floats as 2 positions x 4 layers x 8 dims; the second position
# is padding in every third row.
POSITIONS, P_LAYERS = 2, 4


def positioned(spark, sf_dir):
    """doc_id, layer, pos, vec, mask."""
    e = table(spark, sf_dir, "embeddings")
    parts = [VE.split_layers(e.select("vec_id", F.slice("embedding", p * P_LAYERS * DIM + 1, P_LAYERS * DIM).alias("v")),
                             "v", P_LAYERS, DIM, id_col="vec_id", pos=p) for p in range(POSITIONS)]
    both = parts[0].unionByName(parts[1])
    return both.withColumn("mask", ((F.col("pos") == 0) | (F.col("doc_id") % 3 != 0)).cast("int"))


_POS_SQL = f"""
r AS (SELECT vec_id AS doc_id, l.l AS layer, p.p AS pos,
             list_transform(embedding[p.p * {P_LAYERS * DIM} + l.l * {DIM} + 1: p.p * {P_LAYERS * DIM} + (l.l + 1) * {DIM}],
                            lambda x: CAST(x AS DOUBLE)) AS v,
             CASE WHEN p.p = 0 OR vec_id % 3 <> 0 THEN 1 ELSE 0 END AS mask
      FROM embeddings, (SELECT CAST(range AS INTEGER) AS l FROM range({P_LAYERS})) l,
           (SELECT CAST(range AS INTEGER) AS p FROM range({POSITIONS})) p),
z AS (SELECT *, list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS z FROM r),
lp AS (SELECT doc_id, layer, pos, mask, list_transform(v, lambda x: x - z) AS lp FROM z),
k AS (SELECT m.doc_id, m.layer, m.pos,
             list_sum(list_transform(list_zip(f.lp, m.lp), lambda x: exp(x[1]) * (x[1] - x[2])))
             + list_sum(list_transform(list_zip(t.lp, m.lp), lambda x: exp(x[1]) * (x[1] - x[2]))) AS kl
      FROM lp m JOIN lp f ON f.doc_id = m.doc_id AND f.pos = m.pos AND f.layer = 0
                JOIN lp t ON t.doc_id = m.doc_id AND t.pos = m.pos AND t.layer = {P_LAYERS - 1}
      WHERE m.mask = 1 AND m.layer BETWEEN 1 AND {P_LAYERS - 2})"""


@register("a13_kl_mean_over_positions", f"""WITH {_POS_SQL}
SELECT doc_id, layer, ROUND(AVG(kl), 6) AS kl FROM k GROUP BY doc_id, layer""")
def a13_kl_mean_over_positions(spark, sf_dir):
    """A13 with several token positions: averaged over the valid ones."""
    x = positioned(spark, sf_dir).where("mask = 1")
    k = VE.kl_by_layer(x, 0, P_LAYERS - 1, list(range(1, P_LAYERS - 1)))
    return k.select("doc_id", "layer", F.round("kl", 6).alias("kl"))


@register("a28_kl_last_position", f"""WITH {_POS_SQL}
SELECT doc_id, layer, ROUND(kl, 6) AS kl FROM k
WHERE pos = (CASE WHEN doc_id % 3 <> 0 THEN {POSITIONS - 1} ELSE 0 END)""")
def a28_kl_last_position(spark, sf_dir):
    """The last valid position only."""
    x = positioned(spark, sf_dir).where("mask = 1")
    k = VE.kl_by_layer(x, 0, P_LAYERS - 1, list(range(1, P_LAYERS - 1)), last_position_only=True)
    return k.select("doc_id", "layer", F.round("kl", 6).alias("kl"))


@register("w6_last_valid_pool", f"""WITH {_POS_SQL}
SELECT doc_id, layer, pos, list_transform(v, lambda x: ROUND(x, 6)) AS vec FROM r
WHERE pos = (CASE WHEN doc_id % 3 <> 0 THEN {POSITIONS - 1} ELSE 0 END)""")
def w6_last_valid_pool(spark, sf_dir):
    """The vector of the last unmasked position, per layer."""
    p = VE.last_valid_pool(positioned(spark, sf_dir))
    return p.select("doc_id", "layer", "pos", M.round_array("vec").alias("vec"))


# A fixed output head, 8 dims to 5 words; exact in binary.
HEAD = [[((3 * d + 5 * w) % 7 - 3) / 4 for w in range(5)] for d in range(DIM)]
_HEAD_SQL = ", ".join("ROUND(" + " + ".join(f"v[{d + 1}] * ({HEAD[d][w]!r})" for d in range(DIM)) + ", 5)" for w in range(5))


@register("m8_projected_logits", f"WITH {_POS_SQL} SELECT doc_id, layer, [{_HEAD_SQL}] AS logits FROM r WHERE pos = 0")
def m8_projected_logits(spark, sf_dir):
    """M8: hidden states through a non-square output head."""
    x = positioned(spark, sf_dir).where("pos = 0")
    return VE.project_logits(x, HEAD).select("doc_id", "layer", M.round_array("logits", 5).alias("logits"))


@register("p15_kl_shorter_vocabulary", f"""WITH {_POS_SQL},
s AS (SELECT a.doc_id, a.lp AS t, b.lp[1:6] AS i FROM lp a JOIN lp b ON a.doc_id = b.doc_id
      WHERE a.pos = 0 AND b.pos = 0 AND a.layer = 0 AND b.layer = 1)
SELECT doc_id, ROUND(list_sum(list_transform(list_zip(t[1:6], i), lambda x: exp(x[1]) * (x[1] - x[2]))), 6) AS kl FROM s""")
def p15_kl_shorter_vocabulary(spark, sf_dir):
    """Two vocabularies of unequal length are cut to the shorter one."""
    x = M.with_log_softmax(positioned(spark, sf_dir).where("pos = 0"), "vec", "lp")
    a = x.where("layer = 0").select("doc_id", F.col("lp").alias("t"))
    b = x.where("layer = 1").select("doc_id", F.slice("lp", 1, 6).alias("i"))
    return a.join(b, "doc_id").select("doc_id", F.round(M.kl_from_log_probs("t", "i"), 6).alias("kl"))


def _kl_sql(first: int = FIRST, mids: list[int] | None = None) -> str:
    mids = mids or MIDS
    return f"""
e AS (SELECT vec_id AS doc_id, CAST((i - 1) // {DIM} AS INTEGER) AS layer, (i - 1) % {DIM} AS d,
             CAST(x AS DOUBLE) AS x
      FROM (SELECT vec_id, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)),
m AS (SELECT doc_id, layer, MAX(x) AS mx FROM e GROUP BY doc_id, layer),
s AS (SELECT e.doc_id, e.layer, m.mx + ln(SUM(exp(e.x - m.mx))) AS lse
      FROM e JOIN m ON e.doc_id = m.doc_id AND e.layer = m.layer GROUP BY e.doc_id, e.layer, m.mx),
lsm AS (SELECT e.doc_id, e.layer, e.d, e.x - s.lse AS lp FROM e JOIN s ON e.doc_id = s.doc_id AND e.layer = s.layer),
kl AS (SELECT mid.doc_id, mid.layer,
              SUM(exp(f.lp) * (f.lp - mid.lp)) + SUM(exp(t.lp) * (t.lp - mid.lp)) AS kl
       FROM lsm mid JOIN lsm f ON f.doc_id = mid.doc_id AND f.d = mid.d AND f.layer = {first}
                    JOIN lsm t ON t.doc_id = mid.doc_id AND t.d = mid.d AND t.layer = {LAST}
       WHERE mid.layer IN ({", ".join(map(str, mids))}) GROUP BY mid.doc_id, mid.layer),
best AS (SELECT doc_id, layer AS best_layer FROM (
           SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY ROUND(kl, 10) DESC, layer) AS r FROM kl)
         WHERE r = 1)"""


@register("a13_kl_by_layer", f"WITH {_kl_sql()} SELECT doc_id, layer, ROUND(kl, 6) AS kl FROM kl")
def a13_kl_by_layer(spark, sf_dir):
    return kl_table(spark, sf_dir).select("doc_id", "layer", F.round("kl", 6).alias("kl"))


@register("a14_best_layer", f"""WITH {_kl_sql()}
SELECT doc_id, best_layer, best_layer - 1 AS kl_index FROM best""")
def a14_best_layer(spark, sf_dir):
    b = VE.best_layer(kl_table(spark, sf_dir))
    return b.select("doc_id", "best_layer", (F.col("best_layer") - 1).alias("kl_index"))


@register("a16_best_layer_histogram", f"""WITH {_kl_sql()}
SELECT e.label AS dataset, b.best_layer, CAST(COUNT(*) AS BIGINT) AS n
FROM best b JOIN embeddings e ON e.vec_id = b.doc_id GROUP BY e.label, b.best_layer""")
def a16_best_layer_histogram(spark, sf_dir):
    b = VE.best_layer(kl_table(spark, sf_dir))
    lab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dataset"))
    return b.join(lab, "doc_id").groupBy("dataset", "best_layer").agg(F.count("*").alias("n"))


@register("a28_best_layer_anchor1", f"""WITH {_kl_sql(1, list(range(2, N_LAYERS - 1)))}
SELECT best_layer, CAST(COUNT(*) AS BIGINT) AS n FROM best GROUP BY best_layer""")
def a28_best_layer_anchor1(spark, sf_dir):
    """The first encoding layer (1) as anchor instead of the input
    embedding (0); mids 2..6."""
    kl = kl_table(spark, sf_dir, first=1, mids=list(range(2, N_LAYERS - 1)))
    return VE.best_layer(kl).groupBy("best_layer").agg(F.count("*").alias("n"))


@register("j2_selected_layer_vectors", f"""WITH {_kl_sql()},
v AS (SELECT vec_id AS doc_id, list_transform(embedding[b.best_layer * {DIM} + 1: b.best_layer * {DIM} + {DIM}],
                                              lambda x: ROUND(CAST(x AS DOUBLE), 6)) AS vec, b.best_layer
      FROM embeddings JOIN best b ON b.doc_id = embeddings.vec_id)
SELECT v.doc_id, v.best_layer AS layer, CAST(l.quality AS INTEGER) AS result, v.vec
FROM v JOIN labels l ON l.doc_id = v.doc_id""")
def j2_selected_layer_vectors(spark, sf_dir):
    """X8 in max-KL mode (J2) joined to labels."""
    sel = VE.select_layer(long_vectors(spark, sf_dir), -1, kl_table(spark, sf_dir))
    lab = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("result"))
    return sel.join(lab, "doc_id").select("doc_id", "layer", "result", M.round_array("vec").alias("vec"))


@register("p14_last_layer_softmax", f"""
WITH v AS (SELECT vec_id AS doc_id, list_transform(embedding[{LAST * DIM + 1}:{LAST * DIM + DIM}],
                                                   lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT doc_id, v, list_max(v) AS mx FROM v),
s AS (SELECT doc_id, v, mx, mx + ln(list_sum(list_transform(v, lambda x: exp(x - mx)))) AS lse FROM e)
SELECT doc_id, CAST(list_position(v, mx) - 1 AS INTEGER) AS pred, ROUND(exp(mx - lse), 6) AS p_max,
       ROUND(v[1] - lse, 6) AS lp0
FROM s""")
def p14_last_layer_softmax(spark, sf_dir):
    """P14 (fixed layer) + M1/M2 + P19 + M5: class probabilities of the
    last layer's logits, predicted class = first argmax."""
    last = VE.layer_projection(long_vectors(spark, sf_dir), LAST, N_LAYERS)
    x = M.with_softmax(last, "vec", "p")
    x = M.with_log_softmax(x, "vec", "lp")
    return x.select("doc_id", M.argmax("vec").alias("pred"), F.round(F.array_max("p"), 6).alias("p_max"),
                    F.round(F.element_at("lp", 1), 6).alias("lp0"))


@register("o11_layer_slice_kl", f"WITH {_kl_sql()} SELECT doc_id, layer, ROUND(kl, 6) AS kl FROM kl "
                                "WHERE layer BETWEEN 2 AND 4")
def o11_layer_slice_kl(spark, sf_dir):
    """A contiguous slice of the layer sweep (here layers 2..4)."""
    k = kl_table(spark, sf_dir).where(F.col("layer").between(2, 4))
    return k.select("doc_id", "layer", F.round("kl", 6).alias("kl"))


@register("u5_concat_layers", """
SELECT vec_id AS doc_id, list_transform(embedding, lambda x: ROUND(CAST(x AS DOUBLE), 6)) AS vec FROM embeddings""")
def u5_concat_layers(spark, sf_dir):
    """Split into layers and concatenate back (column concat)."""
    c = VE.concat_layers(long_vectors(spark, sf_dir))
    return c.select("doc_id", M.round_array("vec").alias("vec"))
