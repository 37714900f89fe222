"""Physical-plan properties: filters and column pruning reach the scan, a
fixed-layer read is partition-pruned, no cartesian products."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from conftest import SF01, have


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.skipif(not have(SF01), reason="fixture tables absent")
def test_language_filter_and_pruning_reach_scan(spark):
    from inkwell.operators import evaluate as ev
    from inkwell.plans.evaluation import length_scored
    s = length_scored(spark, SF01).where(F.col("lang").isin("en", "es"))
    p = plan(ev.score_counts(s, "lang"))
    assert "PushedFilters: [In(lang, [en,es])" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p   # source, n_chars pruned
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.skipif(not have(SF01), reason="fixture tables absent")
def test_layer_pick_is_partition_pruned(spark):
    from inkwell.operators import vectors as VE
    from inkwell.plans import vectorq as VQ
    from inkwell.session import scratch_path
    from inkwell.sources import files as FS
    path = scratch_path(spark, "t-plan-layers")
    FS.write_by_layer(VQ.long_vectors(spark, SF01), path)
    p = plan(VE.layer_projection(spark.read.parquet(path), 7, 8))
    assert "PartitionFilters: [isnotnull(layer" in p and "(layer#" in p


@pytest.mark.skipif(not have(SF01), reason="fixture tables absent")
def test_criteria_plan_has_no_cross_product(spark):
    from inkwell.operators import lm as LM
    from inkwell.plans import criteria as CR
    from inkwell.sources.tables import labelled_conversations
    texts = labelled_conversations(spark, SF01)
    p = plan(LM.criteria(CR.model_for(spark, SF01), texts))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
