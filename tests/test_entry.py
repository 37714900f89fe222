"""Driver contract and classifier properties."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from inkwell.operators import classify as CL
from inkwell.operators import evaluate as ev

from conftest import SF001, have


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 55
    assert set(o) <= set(q)


@pytest.mark.skipif(not have(SF001), reason="fixture tables absent")
def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["lang", "auroc", "n_pos", "n_neg"] and len(rows) >= 1


def test_per_group_training_and_linear_scoring(spark):
    import random
    rnd = random.Random(0)
    rows = []
    for layer in range(3):
        for i in range(120):
            y = i % 2
            sep = 2.0 if layer == 2 else 0.0
            rows.append((layer, i, [rnd.gauss(sep * y, 1.0), rnd.gauss(0, 1)], y))
    df = spark.createDataFrame(rows, "layer int, doc_id long, vec array<double>, label int")
    w = CL.train_per_group(df, "layer", "vec", "label", epochs=30, lr=0.05)
    scored = CL.score_linear(df, w, "layer")
    a = {r.layer: r.auroc for r in ev.auroc(scored.select("layer", F.col("prob").alias("score"), "label"),
                                            "layer").collect()}
    assert a[2] > 0.85 and abs(a[0] - 0.5) < 0.2


def test_mllib_fit_and_external_scorer(spark):
    rows = [(i, [float(i % 2) + 0.1 * (i % 7), 1.0], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>, label int")
    model = CL.fit(df, "vec", "label")
    s = CL.score(model, df)
    assert ev.auroc(s.select(F.col("prob").alias("score"), "label")).first().auroc > 0.9
    texts = spark.createDataFrame([(1, "short words here"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.prob for r in CL.external_scores(texts, CL.text_feature_scorer).collect()}
    assert 0.0 <= got[1] <= 1.0 and got[2] == 0.5


def test_mlp_variant(spark):
    rows = [(i, [float(i % 2), float((i // 2) % 2)], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, vec array<double>, label int")
    model = CL.fit(df, "vec", "label", kind="mlp", hidden=(4,), max_iter=50)
    s = CL.score(model, df)
    assert ev.auroc(s.select(F.col("prob").alias("score"), "label")).first().auroc > 0.9


def test_python_workers_find_the_package_from_another_folder(tmp_path):
    """The Python operators run in a session whose working folder and path
    do not hold the package on the workers' side."""
    import subprocess
    import sys
    import os
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from inkwell.session import build_session
from inkwell.operators import classify as CL
spark = build_session(master="local[2]", shuffle_partitions=2)
df = spark.createDataFrame([(0, i, [float(i % 2), 1.0], i % 2, "some words " * i) for i in range(20)],
                           "layer int, doc_id long, vec array<double>, label int, text string")
print("rows", CL.train_per_group(df, "layer").count(), CL.external_scores(df, CL.text_feature_scorer, keep=("label",)).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 1 20" in out.stdout, out.stderr[-2000:]
