"""T1 streaming query: documents arrive as files and are scored by the
calibrated curvature detector (X3) with a model trained beforehand."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import lm as LM
from inkwell.plans import criteria as CR
from inkwell.plans.registry import register
from inkwell.session import scratch_path, table
from inkwell.streaming.score_stream import score_stream


@register("t1_stream_scored_documents", f"""WITH {CR.crit_sql('documents')}
SELECT doc_id, n_tokens, ROUND(curvature, 6) AS crit, ROUND({CR._post_sql('curvature')}, 6) AS prob FROM crit""")
def t1_stream_scored_documents(spark, sf_dir):
    """Documents stream in (one file per trigger, all files available now);
    each micro-batch gets (prob, crit, n_tokens); the appended result store
    is read back as the answer."""
    model = CR.model_for(spark, sf_dir)          # static tables, trained once
    docs = table(spark, sf_dir, "documents")

    def score(batch):
        crit = LM.criteria(model, batch, CR.LAM, CR.LAM_REF)
        return CR.detector_probability(spark, crit).select(
            "doc_id", "n_tokens", F.round("curvature", 6).alias("crit"), F.round("prob", 6).alias("prob"))

    sink, ckpt = scratch_path(spark, "t1-sink"), scratch_path(spark, "t1-checkpoint")
    # A glob path: the file source lists matching files (the table is one file).
    q = score_stream(spark, f"{sf_dir.rstrip('/')}/[d]ocuments.parquet", docs.schema, sink, ckpt, score)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink).drop("batch_id")
