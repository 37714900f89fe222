"""ROC / PR / AUROC against brute force and published numbers."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import evaluate as ev



def brute_auroc(scores, labels):
    pos = [s for s, l in zip(scores, labels) if l == 1]
    neg = [s for s, l in zip(scores, labels) if l == 0]
    if not pos or not neg:
        return None
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _data(n=400, seed=1, groups=("a", "b", "c")):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = groups[i % len(groups)]
        lab = rnd.random() < 0.4
        s = round(rnd.gauss(1.0 if lab else 0.0, 1.0), 1)  # rounding creates ties
        rows.append((i, g, float(s), int(lab)))
    rows.append((n, "single", 0.5, 1))
    rows.append((n + 1, "single", 0.7, 1))
    return rows


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_auroc_matches_brute_force(spark, buckets):
    rows = _data()
    df = spark.createDataFrame(rows, "id long, g string, score double, label int")
    got = {r.g: r.auroc for r in ev.auroc(df, "g", buckets=buckets).collect()}
    for g in {r[1] for r in rows}:
        sub = [r for r in rows if r[1] == g]
        exp = brute_auroc([r[2] for r in sub], [r[3] for r in sub])
        if exp is None:
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(exp, abs=1e-12)


def test_auroc_properties(spark):
    rows = _data(300, seed=7, groups=("x",))
    df = spark.createDataFrame(rows, "id long, g string, score double, label int").where("g = 'x'")
    a = ev.auroc(df).first().auroc
    neg = ev.auroc(df.withColumn("score", -F.col("score"))).first().auroc
    mono = ev.auroc(df.withColumn("score", F.exp(F.col("score") * 3) + 5)).first().auroc
    assert a + neg == pytest.approx(1.0)
    assert mono == pytest.approx(a)


def _sk_roc(scores, labels):
    """The reference's ROC: distinct thresholds descending, collinear
    points dropped, (0, 0) prepended."""
    pairs = sorted(zip(scores, labels), key=lambda x: -x[0])
    thr, tps, fps = [], [], []
    tp = fp = 0
    for i, (s, l) in enumerate(pairs):
        tp += l
        fp += 1 - l
        if i == len(pairs) - 1 or pairs[i + 1][0] != s:
            thr.append(s); tps.append(tp); fps.append(fp)
    keep = [0] + [i for i in range(1, len(tps) - 1)
                  if (fps[i + 1] - 2 * fps[i] + fps[i - 1]) != 0 or (tps[i + 1] - 2 * tps[i] + tps[i - 1]) != 0]
    if len(tps) > 1:
        keep.append(len(tps) - 1)
    P, N = tps[-1], fps[-1]
    return [(0.0, 0.0)] + [(fps[i] / N, tps[i] / P) for i in keep]


def test_roc_curve_matches_reference_rule(spark):
    rows = _data(200, seed=3, groups=("x",))
    rows = [r for r in rows if r[1] == "x"]
    df = spark.createDataFrame(rows, "id long, g string, score double, label int")
    got = [(r.fpr, r.tpr) for r in ev.roc_curve(df, buckets=4).orderBy("point").collect()]
    exp = _sk_roc([r[2] for r in rows], [r[3] for r in rows])
    assert len(got) == len(exp)
    flat = lambda xs: [v for pt in xs for v in pt]
    assert flat(got) == pytest.approx(flat(exp))


def test_pr_auc_anchor_example(spark):
    # Scores .9/.9/.5/.2, labels 1/0/1/0: the (0, 1) anchor gives 0.6667.
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.2, 0)], "score double, label int")
    r = ev.pr_auc(df).first()
    assert r.pr_auc == pytest.approx(2 / 3, abs=1e-4)
    assert r.loss == pytest.approx(1 / 3, abs=1e-4)
    curve = ev.pr_curve(df).collect()
    assert (None, 1.0, 0.0) in [(c.threshold, c.precision, c.recall) for c in curve]


def test_accuracy_and_class_stats(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.4), (0, 0, 0.1), (1, 0, 0.3)], "pred int, label int, score double")
    assert ev.accuracy(df).first().accuracy == pytest.approx(0.5)
    st = {r.label: r for r in ev.class_stats(df).collect()}
    assert st[1].mean == pytest.approx(0.65) and st[1].std == pytest.approx(0.25)


def test_macro_mean_null_for_empty_family(spark):
    cells = spark.createDataFrame([("gpt4", 0.8), ("gpt4", 0.6), ("claude3", None)], "family string, auroc double")
    fams = spark.createDataFrame([("gpt4",), ("claude3",), ("gpt3.5",)], "family string")
    got = {r.family: r.mean_auroc for r in ev.macro_mean(cells, fams, "family").collect()}
    assert got == {"gpt4": pytest.approx(0.7), "claude3": None, "gpt3.5": None}


def test_auroc_of_a_score_file(spark, tmp_path):
    """A score file of two lists, with ties across and inside the classes:
    6.5 of the 12 pairs are ordered rightly."""
    from inkwell.sources.files import read_score_file
    (tmp_path / "a.json").write_text('{\n "human_probs": [0.1, 0.4, 0.4, 0.9],\n "llm_probs": [0.4, 0.2, 0.9]\n}')
    got = ev.auroc(read_score_file(spark, f"{tmp_path}/*.json"), None).first()
    assert got.auroc == pytest.approx(6.5 / 12) and (got.n_pos, got.n_neg) == (3, 4)


def test_roc_pr_summary_matches_separate(spark):
    rows = _data(300, seed=11)
    df = spark.createDataFrame(rows, "id long, g string, score double, label int")
    s = {r.g: r for r in ev.roc_pr_summary(df, "g", buckets=3).collect()}
    a = {r.g: r.auroc for r in ev.auroc(df, "g").collect()}
    p = {r.g: r.pr_auc for r in ev.pr_auc(df, "g").collect()}
    for g in a:
        assert s[g].auroc == (pytest.approx(a[g]) if a[g] is not None else None)
        assert s[g].pr_auc == (pytest.approx(p[g]) if p[g] is not None else None)


@pytest.mark.parametrize("buckets", [None, 7])
def test_thinned_curve_keeps_the_area(spark, buckets):
    rnd = random.Random(8)
    rows = [(g, float(rnd.randrange(40)), int(rnd.random() < 0.5)) for g in "ab" for _ in range(300)]
    rows += [("c", float(i), 1) for i in range(50)] + [("c", float(-i), 0) for i in range(1, 60)]       # two straight runs
    df = spark.createDataFrame(rows, "g string, score double, label int").repartition(4)
    pts = ev.thinned_roc(df, "g", buckets=buckets)
    want = {r.g: r.auroc for r in ev.auroc(df, "g").collect()}
    got = {r.g: r for r in ev.curve_area(pts, "g").collect()}
    for g, a in want.items():
        assert got[g].area == pytest.approx(a, abs=1e-12)
    assert got["c"].n_points == 2
    # Whatever is kept bends, and nothing that bends is dropped.
    for g in "ab":
        p = sorted((r.k, r.fp, r.tp) for r in pts.where(F.col("g") == g).collect())
        for (_, x0, y0), (_, x1, y1), (_, x2, y2) in zip(p, p[1:], p[2:]):
            assert (x1 - x0) * (y2 - y1) != (y1 - y0) * (x2 - x1)
