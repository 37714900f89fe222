"""Alias tables, draws and look-ups with heavy keys."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from inkwell.operators import lm as LM
from inkwell.operators import sampling as S
from inkwell.operators import skew

CORPUS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the the the cat", "mat log cat dog the", "zebra"]


def test_alias_tables_hold_every_weight_exactly(spark):
    rnd = random.Random(4)
    rows = [(g, f"t{i}", rnd.choice([1, 1, 2, 5, 40, 1000])) for g in range(25) for i in range(rnd.randint(1, 30))]
    rows += [(100, f"e{i}", 7) for i in range(9)] + [(101, "only", 3)]
    df = spark.createDataFrame(rows, "g int, item string, w long").repartition(5)
    mass, size = defaultdict(Counter), {}
    for r in S.alias_tables(df, "g", "item", "w").collect():
        assert 0 <= r.cut <= r.total
        mass[r.g][r.item] += r.cut
        mass[r.g][r.other] += r.total - r.cut
        size.setdefault(r.g, (r.slots, r.total))
    want = defaultdict(Counter)
    for g, item, w in rows:
        want[g][item] += w * size[g][0]
    assert {g: {k: v for k, v in c.items() if v} for g, c in mass.items()} == want


def test_draws_are_repeatable_and_follow_the_counts(spark):
    dist = spark.createDataFrame([("x", "a", 6), ("x", "b", 3), ("x", "c", 1), ("y", "d", 1)], "ctx string, tok string, c long")
    tables = S.alias_tables(dist, "ctx", "tok", "c")
    rows = spark.range(6000).select("id", F.lit("x").alias("from"), S.random_number(3, "id").alias("n"))
    got = S.draw(rows.repartition(3), tables, "from", "n", "tok")
    again = S.draw(rows.repartition(7), tables, "from", "n", "tok", bounded=False)
    a, b = ({r.id: r.tok for r in d.collect()} for d in (got, again))
    assert a == b and len(a) == 6000
    n = Counter(a.values())
    assert [n[k] / 6000 for k in "abc"] == pytest.approx([0.6, 0.3, 0.1], abs=0.02)


def test_sampled_curvature_near_the_closed_form(spark):
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    texts = spark.createDataFrame([(0, "the cat sat on the log"), (1, "a zebra sat"), (2, "one"), (3, "the dog and the mat " * 9)],
                                  "doc_id long, text string")
    m = LM.train(corpus, V=100)
    closed = {r.doc_id: r.curvature for r in LM.criteria(m, texts).collect()}
    got = {r.doc_id: r for r in S.sampled_curvature(m, texts, pairs=700, seed=5).collect()}
    assert got[2].curvature is None and got[3].n_tokens == 44
    for i in (0, 1, 3):
        assert got[i].curvature == pytest.approx(closed[i], rel=0.1, abs=0.15)
    with pytest.raises(ValueError):
        S.sampled_curvature(LM.train(corpus, V=None), texts)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_equals_a_join(spark, how):
    rnd = random.Random(6)
    words = ["the"] * 400 + ["a"] * 200 + [f"w{rnd.randrange(500)}" for _ in range(900)]
    left = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, word string").repartition(6)
    right = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(set(words))) if k % 5], "word string, v long")
    for k in (1, 4, 256):
        got = skew.lookup_join(left, right, ["word"], how, k)
        assert sorted(map(tuple, got.select("id", "word", "v").collect()), key=str) == sorted(
            map(tuple, left.join(right, "word", how).select("id", "word", "v").collect()), key=str)
    assert skew.heavy_keys(left.where("1 = 0"), ["word"]) == []
    top = skew.heavy_keys(left, ["word"], 2)
    assert set(top) == {r.h for r in spark.createDataFrame([("the",), ("a",)], "word string").select(F.xxhash64("word").alias("h")).collect()}


def test_sampled_curvature_draws_the_tokens_of_sampled_tokens(spark):
    """The draws are array look-ups of a task, not rows, and are the same as
    the drawn rows of A15."""
    from collections import defaultdict
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c d", "b a b", "c c a b e f", "a b c"] * 3)], "doc_id long, text string")
    texts = spark.createDataFrame([(1, "a b c"), (2, "z z a b"), (3, "f a"), (4, "a"), (5, None)], "doc_id long, text string")
    m = LM.train(corpus, V=4)
    drawn = S.sampled_tokens(m, m.map_words(LM.positions(texts)), 6, 3, 0.5).collect()
    u = {r.token: r.u for r in m.vocab.collect()}
    c = {(r.ctx, r.tok): r.c for r in m.bigrams.collect()}
    cc = {r.ctx: r.cc for r in m.bigrams.collect()}

    def lp(a, b):
        return math.log(0.9 * c.get((a, b), 0) / cc[a] + 0.1 * u[b] if a in cc else u[b])

    sums, at = defaultdict(lambda: [0.0, 0.0, 0.0]), {(r.doc_id, r.pos, r.draw): lp(r.ctx, r.sample) for r in drawn}
    for r in m.map_words(LM.positions(texts)).collect():
        s = sums[r.doc_id]
        s[0] += lp(r.ctx, r.tok)
        for k in range(0, 6, 2):
            a, b = at[r.doc_id, r.pos, k], at[r.doc_id, r.pos, k + 1]
            s[1], s[2] = s[1] + (a + b) / 6, s[2] + (a - b) ** 2 / 6
    df = S.sampled_curvature(m, texts, 3, 0.9, 0.5, 3)
    got = {r.doc_id: r.curvature for r in df.collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[4] is None and got[5] is None
    for d, (x, mean, var) in sums.items():
        assert got[d] == pytest.approx((x - mean) / math.sqrt(var)) if var else got[d] is None
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 1
    none = LM.train(corpus.where("doc_id < 0"), V=4)
    assert {r.curvature for r in S.sampled_curvature(none, texts, 3).collect()} == {None}
