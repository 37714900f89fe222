"""Classifiers over feature vectors.

* X5/X6: MLlib ``LogisticRegression`` or ``MultilayerPerceptronClassifier``
  (distributed fit), probability of class 1 as the machine score; or
  ``fit_irls``, an exact distributed Newton fit whose result does not depend
  on the order of rows, and ``forward``, a layered network from given weights.
* X7: the layer sweep trains one small classifier per layer *in parallel*
  (``groupBy('layer').applyInPandas``) on the bounded training rows of that
  layer only; test rows, which grow with the data, are scored JVM-side with
  the per-layer weights (one row per layer, broadcast) — no test group is
  ever gathered into one task.
* X11: an external sequence classifier is applied per Arrow batch with
  ``mapInPandas``; the scorer is built once per task (model load) and
  reused for every batch of that task.

Training is not bit-for-bit the reference's (its training is unseeded);
tests check properties and AUROC bounds, not exact values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import maths as M
from inkwell.session import ship_package


def _vec(col: str):
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.col(col).cast("array<double>"))


def fit(train: DataFrame, features: str = "vec", label: str = "label", kind: str = "logreg",
        hidden: tuple[int, ...] = (1024, 512), max_iter: int = 100, seed: int = 0):
    """Fit a binary classifier on an array column of features."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    data = train.select(_vec(features).alias("features"), F.col(label).cast("double").alias("label"))
    if kind == "logreg":
        est = LogisticRegression(maxIter=max_iter, regParam=0.0)
    elif kind == "mlp":
        dim = len(train.select(features).first()[0])
        est = MultilayerPerceptronClassifier(layers=[dim, *hidden, 2], maxIter=max_iter, seed=seed)
    else:
        raise ValueError(f"unknown classifier {kind}")
    return est.fit(data)


def score(model, df: DataFrame, features: str = "vec", out: str = "prob") -> DataFrame:
    """Probability of class 1 (machine) and predicted class."""
    from pyspark.ml.functions import vector_to_array
    x = df.withColumn("features", _vec(features))
    x = model.transform(x)
    return (x.withColumn(out, vector_to_array("probability")[1])
             .withColumn("pred", F.col("prediction").cast("int"))
             .drop("features", "rawPrediction", "probability", "prediction"))


# --- X5 / X10 / A26: exact, row-order independent fit -----------------------------------

def _exact(c: Column) -> Column:
    """A term of a sum as a fixed-point number: such sums do not depend on the
    order of the rows, and a retried task adds the same."""
    return F.sum(c.cast("decimal(28,12)"))


def fit_irls(train: DataFrame, group: str | None = None, features: str = "vec", label: str = "label",
             steps: int = 8, ridge: float = 1e-6) -> DataFrame:
    """Logistic regression by iteratively reweighted least squares, one model
    per value of ``group`` (all in the same passes): (group, w, b, n).

    At most ``steps`` steps; each is one grouped aggregate of the gradient and the weighted Gram
    matrix, added up inside the tasks by batches of rows; (d + 1)(d + 2) / 2 +
    d + 1 numbers a group reach the driver, where the step is solved.  Features are centred and scaled to [-1, 1] inside (w
    and b are for the raw features); ``ridge`` times n keeps separable data
    finite.  Rows with a null feature or label are ignored; for few features
    below 10**15 in size."""
    ship_package(train.sparkSession)
    g = F.lit(0) if group is None else F.col(group)
    x = train.select(g.alias("_g"), F.col(features).cast("array<double>").alias("_x"), F.col(label).cast("double").alias("_y"))
    x = x.where("_y is not null and not exists(_x, v -> v is null or isnan(v))")
    first = x.select(F.size("_x").alias("d")).first()
    kind = x.schema["_g"].dataType.simpleString()
    if first is None:
        return x.sparkSession.createDataFrame([], f"`{group or 'one'}` {kind}, w array<double>, b double, n bigint")
    d = first["d"]
    at = [F.col("_x")[i] for i in range(d)]
    # One pass for the means and the largest distances from them.
    told = x.groupBy("_g").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(at)
                                                          for k, f in (("s", _exact), ("lo", F.min), ("hi", F.max))]).collect()
    mean = {r["_g"]: (r["n"], [float(r[f"s{i}"]) / r["n"] for i in range(d)]) for r in told}
    scale = {r["_g"]: [max(r[f"hi{i}"] - m, m - r[f"lo{i}"]) or 1.0 for i, m in enumerate(mean[r["_g"]][1])] for r in told}
    keys = [k for k in mean if k is not None]
    x = _with_model(x, {k: [i] for i, k in enumerate(keys)}, "_k").where(F.size("_x") == d)
    x = x.select(F.col("_k")[0].cast("int").alias("_k"), "_y", "_x")
    cells = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    weights, moved = {k: np.zeros(d + 1) for k in mean}, 1.0
    for _ in range(steps):
        if moved < 1e-9 or not keys:                       # the next step would be far below that
            break
        moved = 0.0
        for k, sums in _newton_sums(x, d, [(np.array(mean[k][1]), np.array(scale[k]), weights[k]) for k in keys]).items():
            k, (grad, gram) = keys[k], (sums[:d + 1], sums[d + 1:])
            penalty = ridge * mean[k][0]
            h = np.zeros((d + 1, d + 1))
            for (i, j), v in zip(cells, gram):
                h[i, j] = h[j, i] = v
            way = np.linalg.solve(h + penalty * np.eye(d + 1), np.array(grad) - penalty * weights[k])
            weights[k], moved = weights[k] + way, max(moved, float(np.abs(way).max()))
    rows = []
    for k, w in weights.items():
        raw = w[:d] / np.array(scale[k])
        rows.append((k, raw.tolist(), float(w[d] - raw @ np.array(mean[k][1])), mean[k][0]))
    return x.sparkSession.createDataFrame(rows, f"`{group or 'one'}` {kind}, w array<double>, b double, n bigint")


def _newton_sums(x: DataFrame, d: int, models: list[tuple]) -> dict[int, list[float]]:
    """For each group ``_k``, the number of its model (mean, scale, weights):
    the gradient's d + 1 sums, then the upper triangle of the Gram matrix.  The
    tasks add up whole numbers of 2**-40, so the order of rows does not matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, y = b.column(0).to_numpy(), b.column(1).to_numpy()
            x = b.column(2).flatten().to_numpy().reshape(len(y), d)
            rows: list[tuple] = []
            for k in np.unique(group):
                mean, scale, w = models[k]
                own = group == k
                z = [(x[own, i] - mean[i]) / scale[i] for i in range(d)] + [np.ones(own.sum())]
                with np.errstate(over="ignore"):
                    p = 1.0 / (1.0 + np.exp(-sum(zi * wi for zi, wi in zip(z, w))))
                q = p * (1.0 - p)
                terms = [(y[own] - p) * zi for zi in z] + [q * z[i] * z[j] for i in range(d + 1) for j in range(i, d + 1)]
                for at, v in enumerate(terms):
                    whole = np.floor(v)
                    part = int(np.rint((v - whole) * 2.0 ** 40).astype(np.int64).sum())
                    rows.append((int(k), at, int(whole.astype(np.int64).sum()) + (part >> 40), part & ((1 << 40) - 1)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                                                 names=["_k", "at", "whole", "part"])

    got = x.mapInArrow(run, "_k int, at int, whole long, part long").groupBy("_k", "at").agg(
        F.sum("whole").alias("whole"), F.sum("part").alias("part")).collect()
    out: dict[int, list[float]] = {}
    for r in sorted(got):
        out.setdefault(r["_k"], []).append(r["whole"] + r["part"] / 2.0 ** 40)
    return out


def _with_model(x: DataFrame, values: dict, name: str) -> DataFrame:
    """``x`` with the numbers of its group (one small array a group)."""
    rows = pa.table({"_g": pa.array(list(values)), name: pa.array([list(map(float, v)) for v in values.values()])})
    t = x.sparkSession.createDataFrame(rows).withColumn("_g", F.col("_g").cast(x.schema["_g"].dataType))
    return x.join(F.broadcast(t), "_g")


def linear_scores(df: DataFrame, weights: DataFrame, group: str, vec: str = "vec", out: str = "score") -> DataFrame:
    """Every row under every model of ``weights`` (a few): column ``group``
    and the linear score ``w.x + b``, which unlike the probability does not
    saturate."""
    models = F.array(*[F.struct(F.lit(r[group]).alias("k"), F.array(*map(F.lit, r["w"])).alias("w"), F.lit(r["b"]).alias("b"))
                       for r in weights.collect()])
    x = df.withColumn("_m", F.explode(models))
    z = M.dot(F.col(vec).cast("array<double>"), "_m.w") + F.col("_m.b")
    return x.withColumn(group, F.col("_m.k")).withColumn(out, z).drop("_m")


# --- X6: forward pass of a layered network ---------------------------------------------

ACTIVATIONS = {"tanh": np.tanh, "linear": lambda z: z, "relu": lambda z: np.maximum(z, 0.0),
               "softmax": lambda z: np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)}


def forward(df: DataFrame, layers: list[tuple], vec: str = "vec", out: str = "probs") -> DataFrame:
    """``layers`` of (weights [out x in], bias [out], activation name) from
    the first to the last, applied to an array column: one matrix product a
    layer and Arrow batch.  The weights are one broadcast copy an executor
    (their size is the model's); a null vector gives a null result."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast([(np.asarray(w, float), np.asarray(b, float), a) for w, b, a in layers])

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna().to_numpy()
            result = [None] * len(s)
            if known.any():
                x = np.stack(s[known].to_numpy()).astype(float)
                for w, b, a in shared.value:
                    x = ACTIVATIONS[a](x @ w.T + b)
                for i, row in zip(np.flatnonzero(known), x):
                    result[i] = row
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, run(F.col(vec).cast("array<double>")))


# --- X7: per-group training, JVM-side scoring -----------------------------------

def _train_logistic(pdf: pd.DataFrame, key: str, vec: str, label: str, epochs: int, lr: float,
                    batch: int) -> pd.DataFrame:
    """Mini-batch Adam on the logistic loss, zero start, rows in id order
    (deterministic).  Runs on one group's bounded training rows."""
    pdf = pdf.sort_values("_order")
    X = np.stack(pdf[vec].to_numpy()).astype("float64")
    y = pdf[label].to_numpy().astype("float64")
    w = np.zeros(X.shape[1]); b = 0.0
    m_w = np.zeros_like(w); v_w = np.zeros_like(w); m_b = v_b = 0.0
    b1, b2, eps, t = 0.9, 0.999, 1e-8, 0
    loss = float("nan")
    for _ in range(epochs):
        for i in range(0, len(y), batch):
            xb, yb = X[i:i + batch], y[i:i + batch]
            p = 1.0 / (1.0 + np.exp(-(xb @ w + b)))
            gw = xb.T @ (p - yb) / len(yb); gb = float(np.mean(p - yb))
            t += 1
            m_w = b1 * m_w + (1 - b1) * gw; v_w = b2 * v_w + (1 - b2) * gw * gw
            m_b = b1 * m_b + (1 - b1) * gb; v_b = b2 * v_b + (1 - b2) * gb * gb
            w -= lr * (m_w / (1 - b1 ** t)) / (np.sqrt(v_w / (1 - b2 ** t)) + eps)
            b -= lr * (m_b / (1 - b1 ** t)) / (np.sqrt(v_b / (1 - b2 ** t)) + eps)
            pc = np.clip(p, 1e-12, 1 - 1e-12)
            loss = float(-np.mean(yb * np.log(pc) + (1 - yb) * np.log(1 - pc)))
    return pd.DataFrame({key: [pdf[key].iloc[0]], "w": [w.tolist()], "b": [b], "loss": [loss],
                         "n_train": [len(y)]})


def train_per_group(train: DataFrame, key: str = "layer", vec: str = "vec", label: str = "label",
                    order: str = "doc_id", epochs: int = 10, lr: float = 0.003, batch: int = 16) -> DataFrame:
    """One classifier per ``key`` value, all groups trained in parallel.
    ``train`` must already be bounded (e.g. the first 160 rows per layer,
    O8), so each group is small."""
    ship_package(train.sparkSession)
    schema = f"{key} int, w array<double>, b double, loss double, n_train bigint"
    x = train.select(F.col(key).cast("int").alias(key), F.col(vec).cast("array<double>").alias(vec),
                     F.col(label).cast("double").alias(label), F.col(order).alias("_order"))
    return x.groupBy(key).applyInPandas(
        lambda pdf: _train_logistic(pdf, key, vec, label, epochs, lr, batch), schema=schema)


def score_linear(df: DataFrame, weights: DataFrame, key: str = "layer", vec: str = "vec",
                 out: str = "prob") -> DataFrame:
    """Score rows with their group's linear weights: ``sigmoid(w.x + b)``,
    all in Spark expressions.  The weight table has one row per group
    (layers: bounded by the model depth), so it is broadcast."""
    x = df.join(F.broadcast(weights.select(key, "w", "b")), key)
    z = M.dot(F.col(vec).cast("array<double>"), "w") + F.col("b")
    return x.withColumn(out, 1.0 / (1.0 + F.exp(-z))).drop("w", "b")


# --- X11: external scorer per Arrow batch -------------------------------------------

def text_feature_scorer() -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for a sequence-classifier model: two logits
    from mean word length and type/token ratio; returns the class-0
    ("machine") probability, as the reference's classifier does (M5)."""
    def features(text: str) -> tuple[int, int, int]:
        words = text.split()
        return len(words), sum(map(len, words)), len(set(words))

    def run(texts: pd.Series) -> pd.Series:
        # The words of one text at a time are held, never those of a batch.
        n, chars, types = np.array([features(t) for t in texts.fillna("")], float).reshape(-1, 3).T
        with np.errstate(invalid="ignore", divide="ignore"):
            logit = 0.8 * (chars / n - 4.5) + 2.0 * (0.7 - types / n)
        top = np.maximum(logit, 0.0)
        lse = top + np.log(np.exp(logit - top) + np.exp(-top))
        return pd.Series(np.where(n > 0, np.exp(logit - lse), 0.5))
    return run


def external_scores(df: DataFrame, make_scorer: Callable[[], Callable[[pd.Series], pd.Series]],
                    text_col: str = "text", id_col: str = "doc_id", out: str = "prob",
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """X11: ``keep`` columns pass through with the id; ``make_scorer`` runs once per task (load the model there); each
    Arrow batch of texts is scored by the returned function."""
    ship_package(df.sparkSession)
    kept = [id_col, *keep]

    def part(batches):
        scorer = make_scorer()
        for pdf in batches:
            yield pdf[kept].assign(**{out: scorer(pdf[text_col]).to_numpy()})

    types = dict(df.dtypes)
    return df.select(*kept, text_col).mapInPandas(
        part, schema=", ".join([f"`{c}` {types[c]}" for c in kept] + [f"`{out}` double"]))
