"""Distributed fits and the layered forward pass against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import classify as CL


def rows(n, seed, groups=("a", "b")):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        g = groups[i % len(groups)]
        x = [rnd.gauss(0, 1), rnd.gauss(5, 100), rnd.gauss(-3, 0.01)]
        z = 0.7 * x[0] + 0.01 * x[1] - (0.4 if g == "a" else 1.5)
        out.append((g, x, int(rnd.random() < 1 / (1 + np.exp(-z)))))
    return out


def newton(x, y, steps=30):
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
    return w


def test_irls_equals_newton_by_group(spark):
    data = rows(900, 1)
    df = spark.createDataFrame(data, "dom string, vec array<double>, label int").repartition(7)
    got = {r.dom: r for r in CL.fit_irls(df, "dom").collect()}
    for g in ("a", "b"):
        x, y = np.array([v for k, v, _ in data if k == g]), np.array([t for k, _, t in data if k == g])
        want = newton(x, y)
        assert got[g].n == len(y)
        assert got[g].w == pytest.approx(want[:3], rel=2e-3, abs=1e-3) and got[g].b == pytest.approx(want[3], rel=2e-3, abs=0.05)


def test_irls_does_not_depend_on_row_order(spark):
    data = rows(400, 2)
    fits = []
    for parts, seed in ((1, 0), (9, 1), (3, 2)):
        mixed = data[:]
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "dom string, vec array<double>, label int").repartition(parts)
        fits.append(sorted((r.dom, tuple(r.w), r.b) for r in CL.fit_irls(df, "dom").collect()))
    assert fits[0] == fits[1] == fits[2]


def test_irls_with_odd_rows(spark):
    schema = "vec array<double>, label int"
    data = [([0.0, 1.0], 0), ([1.0, 1.0], 1), ([2.0, 1.0], 1), ([-1.0, 1.0], 0)]        # separable, one constant feature
    odd = [(None, 1), ([None, 1.0], 0), ([float("nan"), 0.0], 1), ([5.0, 5.0], None)]
    r = CL.fit_irls(spark.createDataFrame(data + odd, schema)).first()
    assert r.n == 4 and r.w[0] > 0 and np.isfinite(r.w).all()
    assert CL.fit_irls(spark.createDataFrame(odd, schema)).count() == 0
    one_class = CL.fit_irls(spark.createDataFrame([(v, 1) for v, _ in data], schema)).first()
    assert np.isfinite(one_class.w).all() and one_class.b > 0


def test_irls_steps_are_added_up_inside_the_tasks(spark):
    """The sums of a step leave a task once a batch and group, exact whatever
    the batches; rows without a group give a model of zeros, as before."""
    data = rows(300, 3) + [(None, [1.0, 2.0, 3.0], 1)]
    df = spark.createDataFrame(data, "dom string, vec array<double>, label int")
    assert {r.dom: r.w for r in CL.fit_irls(df, "dom").collect()}[None] == [0.0, 0.0, 0.0]
    x = spark.createDataFrame([(k == "b", float(y), v) for k, v, y in data if k], "k boolean, _y double, _x array<double>")
    x = x.selectExpr("cast(k as int) as _k", "_y", "_x")
    models = [(np.zeros(3), np.ones(3), np.array([0.1, -0.2, 0.3, 0.5]))] * 2
    sums = CL._newton_sums(x.repartition(5), 3, models)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert CL._newton_sums(x.coalesce(1), 3, models) == sums
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g, k in (("a", 0), ("b", 1)):
        z = np.array([[*v, 1.0] for d, v, _ in data if d == g])
        y = np.array([t for d, _, t in data if d == g])
        p = 1 / (1 + np.exp(-z @ models[k][2]))
        gram = (z * (p * (1 - p))[:, None]).T @ z
        want = [*((y - p) @ z), *(gram[i, j] for i in range(4) for j in range(i, 4))]
        assert sums[k] == pytest.approx(want, abs=1e-8)


def test_linear_scores_of_every_model(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, -1.0])], "id long, vec array<double>")
    w = spark.createDataFrame([("p", [1.0, 1.0], 0.5), ("q", [2.0, 0.0], -1.0)], "m string, w array<double>, b double")
    got = {(r.id, r.m): r.score for r in CL.linear_scores(df, w, "m").collect()}
    assert got == {(1, "p"): 3.5, (1, "q"): 1.0, (2, "p"): 0.0, (2, "q"): 0.0}


def test_forward_equals_numpy(spark):
    rng = np.random.default_rng(3)
    layers = [(rng.normal(size=(5, 4)), rng.normal(size=5), "tanh"), (rng.normal(size=(3, 5)), rng.normal(size=3), "relu"),
              (rng.normal(size=(2, 3)), rng.normal(size=2), "softmax")]
    x = rng.normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, vec array<double>").repartition(4)
    got = {r.id: r.probs for r in CL.forward(df, layers).collect()}
    a = np.maximum(np.tanh(x @ layers[0][0].T + layers[0][1]) @ layers[1][0].T + layers[1][1], 0) @ layers[2][0].T + layers[2][1]
    want = np.exp(a) / np.exp(a).sum(axis=1, keepdims=True)
    assert got.pop(99) is None
    for i, p in got.items():
        assert p == pytest.approx(want[i].tolist(), abs=1e-12)
    assert CL.forward(df.where(F.col("vec").isNull()), layers).count() == 1


def test_text_scorer_holds_the_words_of_one_text_at_a_time():
    import tracemalloc

    import pandas as pd
    texts = pd.Series([" ".join(f"w{i}x{j}" for j in range(300)) for i in range(3000)] + [None, "", " "])
    run = CL.text_feature_scorer()
    tracemalloc.start()
    p = run(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(p) == 3003 and p[3000:].tolist() == [0.5] * 3 and 0 < p[0] < 1
    assert peak < 5 << 20                                  # 900,000 words took over 50 MB
    assert run(texts[:0]).tolist() == []
