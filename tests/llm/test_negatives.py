import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import negatives as N


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    kept = {}
    for i, e, label in rows:
        if None in (i, e, label) or len(e) != 64 or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        v = [math.floor(256 * x) for x in e]
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    out = []
    for a, (la, va) in kept.items():
        if a % every:
            continue
        s = [(-sum(x * y for x, y in zip(va, v)), i, lab) for i, (lab, v) in kept.items() if i != a]
        for ps, p, _ in sorted(x for x in s if x[2] == la)[:positives]:
            fit = sorted(x for x in s if x[2] != la and low * -ps <= 100 * -x[0] <= high * -ps)[:negatives]
            out += [(a, p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fit)]
    return sorted(out)


def vectors(n, seed=2, noise=0.08):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 0.12) for _ in range(64)] for _ in range(12)]
    rows = [(i, [float(np.float32(m + rnd.gauss(0, noise))) for m in middles[rnd.randrange(12)]], rnd.randrange(4)) for i in range(n)]
    copies = [(n + i, rows[50][1], i % 2) for i in range(200)]                     # ties, one very common vector
    bad = [(None, rows[0][1], 1), (n + 300, None, 1), (n + 301, rows[0][1], None), (n + 302, [0.5] * 63, 1),
           (n + 303, [0.5] * 63 + [None], 1), (n + 304, [float("nan")] * 64, 2), (n + 350, [float("inf")] * 64, 2),
           (n + 400, [-x for x in rows[1][1]], 9), (n + 450, [0.0] * 64, 3), (n + 451, [0.0] * 64, 3)]
    return rows + copies + bad + [rows[3], rows[3], (3, rows[4][1], 2), (100, rows[9][1], 1)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "v", "shard", "c1", "home", "score")]).repartition(4)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    return vectors(1500)


def test_query_equals_brute_force(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = N.op12_inverted_multi_index(spark, str(tmp_path))
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert got(df) == want and len(want) > 100


def test_parameters_shards_and_split_cells(spark, rows):
    """Many shards, cells beyond a shard, few codes, other needs."""
    df = frame(spark, rows)
    few = N.mined(df, every=97, codes=3, sample_rows=50, shard_rows=40, needs=N.Needs(positives=2, negatives=4, low=20, high=99))
    assert got(few) == brute(rows, 97, 2, 4, 20, 99)


def test_few_and_no_rows(spark, rows):
    df = frame(spark, rows)
    assert got(N.mined(df.where("1 = 0"))) == []
    assert got(N.mined(df.where("vec_id = 50"))) == []
    two = [(0, [0.5] * 64, 1), (3, [0.5] * 64, 2), (4, [0.25] * 64, 2), (5, [-0.5] * 64, 2), (6, [0.3] * 64, 7)]
    assert got(N.mined(frame(spark, two))) == brute(two) and len(brute(two)) > 0


def test_large_components_are_exact(spark):
    rnd = random.Random(8)
    rows = [(i, [float(np.float32(rnd.choice([-1, 1]) * rnd.randrange(1 << 17))) for _ in range(64)], i % 2) for i in range(120)]
    assert got(N.mined(frame(spark, rows), every=10)) == brute(rows, 10)


def test_walk_falls_and_visits_each_pair_once():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = -np.sort(-rng.normal(size=rng.integers(1, 7))), -np.sort(-rng.normal(size=rng.integers(1, 7)))
        seen = list(N.walk(a, b))
        assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(len(a)) for j in range(len(b))]
        assert all(x[0] >= y[0] for x, y in zip(seen, seen[1:]))


def test_certified_walk_stops_early():
    """On clustered vectors most cells stay unseen, and nothing is missed."""
    rng = np.random.default_rng(5)
    middles = rng.normal(0, 100, (20, 64))
    v = np.floor(middles[rng.integers(0, 20, 4000)] + rng.normal(0, 6, (4000, 64))).astype(np.int64)
    books = N.Books(N.codebook(v[:, :32], 20), N.codebook(v[:, 32:], 20))
    c1, r1 = N._coded(v[:, :32].astype(float), books.first)
    c2, r2 = N._coded(v[:, 32:].astype(float), books.second)
    ids, labels = np.arange(4000), rng.integers(0, 3, 4000)
    shard = N.Shard(ids, labels, v, c1, c2, r1, r2, books)
    seen, scored = 0, shard.scores
    def count(rows, a):
        nonlocal seen
        seen += len(rows)
        return scored(rows, a)
    shard.scores = count
    for i in range(0, 4000, 400):
        u1, u2 = shard.bounds(v[i][None])
        got_ids, _ = N.near(shard, v[i], i, labels[i], u1[0], u2[0], 5, -np.inf)
        s = v @ v[i]
        want = sorted((-s[j], j) for j in ids if j != i and labels[j] == labels[i])[:5]
        assert got_ids.tolist() == [j for _, j in want]
    assert seen < 0.25 * 10 * 4000 / 3
