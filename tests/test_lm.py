"""Token model and criteria against a dense brute-force computation."""

import math

import pytest

from inkwell.operators import lm as LM

CORPUS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog",
          "the the the cat", "mat log cat dog the", "zebra", ""]
SCORED = ["the cat sat on the log", "a zebra sat", "dog dog dog", "one", "the mat and the cat and the dog"]


def dense(V, lam, lam_ref):
    words = [w for t in CORPUS for w in t.split()]
    cnt = {}
    for w in words:
        cnt[w] = cnt.get(w, 0) + 1
    top = sorted(cnt, key=lambda w: (-cnt[w], w))[:V]
    topset = set(top)
    vocab = top + ["<unk>"]
    c = {w: cnt[w] for w in top}
    c["<unk>"] = len(words) - sum(c[w] for w in top)
    N, V1 = len(words), min(len(cnt), V) + 1
    u = {w: (c[w] + 1) / (N + V1) for w in vocab}
    mp = lambda w: w if w in topset else "<unk>"
    big, cc = {}, {}
    for t in CORPUS:
        ws = [mp(w) for w in t.split()]
        for a, b in zip(ws, ws[1:]):
            big[(a, b)] = big.get((a, b), 0) + 1
            cc[a] = cc.get(a, 0) + 1

    def p(a, w, l):
        if a not in cc:
            return u[w]
        return l * big.get((a, w), 0) / cc[a] + (1 - l) * u[w]

    out = {}
    for i, t in enumerate(SCORED):
        ws = [mp(w) for w in t.split()]
        if len(ws) < 2:
            out[i] = None
            continue
        lps, ranks, ents, means, vars_ = [], [], [], [], []
        for a, b in zip(ws, ws[1:]):
            dist = sorted(vocab, key=lambda w: (-p(a, w, lam), w))
            ranks.append(dist.index(b) + 1)
            lps.append(math.log(p(a, b, lam)))
            ents.append(-sum(p(a, w, lam) * math.log(p(a, w, lam)) for w in vocab))
            m = sum(p(a, w, lam_ref) * math.log(p(a, w, lam)) for w in vocab)
            m2 = sum(p(a, w, lam_ref) * math.log(p(a, w, lam)) ** 2 for w in vocab)
            means.append(m); vars_.append(m2 - m * m)
        n = len(lps)
        out[i] = dict(likelihood=sum(lps) / n, rank=-sum(ranks) / n,
                      logrank=-sum(math.log(r) for r in ranks) / n, entropy=sum(ents) / n,
                      curvature=(sum(lps) - sum(means)) / math.sqrt(sum(vars_)), n_tokens=n)
    return out


@pytest.mark.parametrize("V", [3, 100])
def test_criteria_match_dense(spark, V):
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    scored = spark.createDataFrame(list(enumerate(SCORED)), "doc_id long, text string")
    m = LM.train(corpus, V=V)
    got = {r.doc_id: r for r in LM.criteria(m, scored, 0.9, 0.5).collect()}
    exp = dense(V, 0.9, 0.5)
    for i, e in exp.items():
        if e is None:
            assert got[i].likelihood is None
            continue
        for k, v in e.items():
            assert getattr(got[i], k) == pytest.approx(v, rel=1e-9, abs=1e-9), (i, k)


def test_long_criteria_unpivot(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.3, 0.4, 0.5)], "doc_id long, likelihood double, rank double, "
                               "logrank double, entropy double, curvature double")
    rows = LM.long_criteria(df, ["doc_id"]).collect()
    assert [r.criterion for r in rows] == LM.CRITERIA and [r.score for r in rows] == [0.1, 0.2, 0.3, 0.4, 0.5]


def test_mc_curvature_near_analytic(spark):
    """A12 (sampled) approaches A11 (closed form) with enough draws."""
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    scored = spark.createDataFrame(list(enumerate(SCORED)), "doc_id long, text string")
    m = LM.train(corpus, V=100)
    mc = {r.doc_id: r.mc_curvature for r in LM.mc_curvature(m, scored, n_draws=3000, seed=1).collect()}
    an = {r.doc_id: r.curvature for r in LM.criteria(m, scored, 0.9, 0.5).collect()}
    checked = 0
    for d, v in an.items():
        if v is None or d not in mc or mc[d] is None:
            continue
        assert mc[d] == pytest.approx(v, rel=0.08, abs=0.12), d
        checked += 1
    assert checked >= 3


def test_mc_single_text_runs(spark):
    """A15 path on one short text (one scored position)."""
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    m = LM.train(corpus, V=100)
    one = spark.createDataFrame([(0, "the cat")], "doc_id long, text string")
    mc = LM.mc_curvature(m, one, n_draws=10)
    assert mc.count() == 1


def test_reserved_word_in_a_text_is_out_of_vocabulary(spark):
    rows = [(1, "a b <unk> a b c <unk>"), (2, "a <unk> <unk> b a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = LM.train(df, V=2)
    vocab = {r.token: r.c for r in m.vocab.collect()}
    assert vocab == {"a": 4, "b": 4, LM.UNK: 5}
    got = {r.doc_id: r.n_tokens for r in LM.criteria(m, df).collect()}
    assert got == {1: 6, 2: 5}


def test_whole_vocabulary_equals_a_large_bound(spark):
    rows = [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 25))) for i in range(1, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = LM.criteria(LM.train(df, V=1000), df).orderBy("doc_id").collect()
    b = LM.criteria(LM.train(df, V=None), df).orderBy("doc_id").collect()
    assert len(a) == len(b) == 11
    for x, y in zip(a, b):
        assert all(abs(x[c] - y[c]) < 1e-9 for c in LM.CRITERIA)


def test_whole_vocabulary_query_matches_dense(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    rare = [" ".join(f"r{i}" for i in range(k, k + 60)) for k in range(0, 1200, 60)]   # more words than the bound of 1000
    monkeypatch.setitem(globals(), "CORPUS", CORPUS + rare)
    monkeypatch.setitem(globals(), "SCORED", SCORED + ["r3 r4 r1190 the r1191", "new r1199 cat <unk> r7 r8"])
    spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [(0, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(SCORED)] + [(0, 50, "system", "the cat")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.doc_id: r for r in E.queries()["x1_criteria_whole_vocabulary"](spark, str(tmp_path)).collect()}
    exp = dense(10_000, 0.9, 0.5)
    assert set(got) == set(exp)
    for i, e in exp.items():
        assert got[i].result == i % 2
        if e is None:
            assert got[i].likelihood is None
            continue
        for k, v in e.items():
            assert getattr(got[i], k) == pytest.approx(v, abs=2e-6), (i, k)


@pytest.mark.parametrize("V", [2, 5, 100])
def test_rank_index_equals_the_counted_ranks(spark, V):
    """Every pair of two words, seen or not, known or not."""
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    m = LM.train(corpus, V=V)
    words = sorted({w for t in CORPUS for w in t.split()}) + ["new", LM.UNK]
    pos = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate((a, b) for a in words for b in words)],
                                "doc_id long, pos int, ctx_word string, word string")
    got = {(r.ctx_word, r.word): r for r in LM.rank_index(m, 0.9, 0.5).scored(pos).collect()}
    known = {r.token for r in m.vocab.collect()}
    at = lambda w: w if w in known else LM.UNK
    ps = {(r.ctx, r.tok): r for r in LM.pair_stats(m, m.map_words(pos).select("ctx", "tok"), 0.9).collect()}
    assert len(got) == len(words) ** 2
    for (a, b), r in got.items():
        want = ps[at(a), at(b)]
        assert r.rank == want.rank and r.lp == pytest.approx(want.lp, abs=1e-12), (a, b)


def test_indexed_criteria_add_up_inside_the_tasks(spark):
    """No position is a row: texts are scored from arrays, with the sums of the
    look-ups by position; rows that share an id (or have none) stay as before."""
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    m = LM.train(corpus, V=5)
    texts = [*enumerate(SCORED), (0, "the cat new"), (50, None), (51, ""), (52, "cat"), (None, "the cat"), (53, "the \u00a0cat\tnew <unk>")]
    df = spark.createDataFrame(texts, "uid long, body string").repartition(3)
    crit = LM.criteria(m, df, 0.9, 0.5, id_col="uid", text_col="body")
    plan = crit._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    by_position = LM.rank_index(m, 0.9, 0.5).scored(LM.positions(df, "uid", "body")).collect()
    got = crit.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got) == sorted((-1 if i is None else i) for i, _ in texts)
    for r in got:
        rows = [p for p in by_position if p.doc_id == r.doc_id and r.doc_id is not None]
        if not rows:
            assert r.n_tokens is None and r.likelihood is None
            continue
        n = len(rows)
        assert r.n_tokens == n
        assert r.likelihood == pytest.approx(sum(p.lp for p in rows) / n, rel=1e-12)
        assert r["rank"] == pytest.approx(-sum(p["rank"] for p in rows) / n, rel=1e-12)
        assert r.entropy == pytest.approx(sum(p.entropy for p in rows) / n, rel=1e-12)
        assert r.curvature == pytest.approx(sum(p.lp - p["mean"] for p in rows) / sum(p["var"] for p in rows) ** 0.5, rel=1e-9, abs=1e-9)


def test_no_index_beyond_its_size_bound(spark, monkeypatch):
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    scored = spark.createDataFrame(list(enumerate(SCORED)), "doc_id long, text string")
    m = LM.train(corpus, V=4)
    a = sorted(LM.criteria(m, scored).collect())
    monkeypatch.setattr(LM, "INDEX_BYTES", 64)
    assert LM.rank_index(m, 0.9, 0.5) is None
    for x, y in zip(a, sorted(LM.criteria(m, scored).collect())):
        assert [v is None for v in x] == [v is None for v in y]
        assert [v for v in x if v is not None] == pytest.approx([v for v in y if v is not None], abs=1e-9)


def test_counts_of_words_and_pairs_are_handed_on_in_parts(spark, monkeypatch):
    """Small bounds: many partial counts, the same sums.  The pairs of a
    bounded vocabulary reach the shuffle as numbers, not as words."""
    from collections import Counter
    from itertools import pairwise

    from pyspark import cloudpickle
    texts = ["a b  a\tb c", "", None, "c", "a b <unk> a", "z a b"] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(2)
    words = [t.split() for t in texts if t]
    monkeypatch.setattr(LM, "COUNTED", 2)
    monkeypatch.setattr(LM, "HELD", 3)
    cloudpickle.register_pickle_by_value(LM)               # the workers take the bounds along
    try:
        for V in (2, 50, None):
            m = LM.train(df, V=V)
            count = Counter(w for ws in words for w in ws)
            known = sorted((w for w in count if w != LM.UNK), key=lambda w: (-count[w], w))[:V]
            mapped = [[w if w in known else LM.UNK for w in ws] for ws in words]
            big = Counter(p for ws in mapped for p in pairwise(ws))
            cc = Counter(a for ws in mapped for a in ws[:-1])
            assert {(r.ctx, r.tok): (r.c, r.cc) for r in m.bigrams.collect()} == {p: (c, cc[p[0]]) for p, c in big.items()}
            got = {r.token: r.c for r in m.vocab.collect()}
            assert got == {**{w: count[w] for w in known}, LM.UNK: sum(count.values()) - sum(count[w] for w in known)}
    finally:
        cloudpickle.unregister_pickle_by_value(LM)
    plan = LM._mapped_pairs(df, m.vocab, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan                          # no row a word


def test_pair_ranks_of_contexts_counted_in_parts(spark, monkeypatch):
    """Contexts with more seen pairs than a part holds give the same ranks."""
    import random
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(rnd.choice(["the", *words]) for _ in range(40))) for i in range(40)], "doc_id int, text string")
    for V in (12, None):
        m = LM.train(df, V=V)
        vocab, bigrams = m.vocab.collect(), {(r.ctx, r.tok): r for r in m.bigrams.collect()}
        u, cc = {r.token: r.u for r in vocab}, {r.ctx: r.cc for r in bigrams.values()}

        def p(a, w):
            c = bigrams[a, w].c if (a, w) in bigrams else 0
            return 0.9 * c / cc[a] + (1.0 - 0.9) * u[w]

        asked = [(a, w) for a in list(cc)[:6] for w in u]
        want = {(a, w): 1 + sum((-p(a, x), x) < (-p(a, w), w) for x in u) for a, w in asked}
        q = spark.createDataFrame(asked, "ctx string, tok string")
        for part in (3, 1000):
            monkeypatch.setattr(LM, "PART", part)
            got = {(r.ctx, r.tok): r["rank"] for r in LM.pair_stats(m, q, 0.9).collect()}
            assert got == want


def test_whole_vocabulary_leaves_only_the_model_on_disk(spark, tmp_path):
    """Tables on the way to the criteria go when they have been read, and so do
    the files of their shuffles: with the words of every text in the model, they
    would be many times its size."""
    import os
    import random

    from inkwell.session import checkpoint_root
    rnd = random.Random(7)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(400)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    root = checkpoint_root(spark).removeprefix("file:")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    size = lambda d: sum(os.path.getsize(os.path.join(r, f)) for r, _, names in os.walk(str(d)) for f in names if "broadcast" not in f)
    used = lambda: size(root) + sum(size(d) for d in local)
    before = used()
    m = LM.load_or_train(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), f"{tmp_path}/documents.parquet", V=None)
    crit = LM.criteria(m, df, 0.9, 0.5)
    assert used() - before < 3 * size(m.path.removeprefix("file:"))        # 51 times with every table kept
    assert crit.where("likelihood < 0 and rank < 0 and entropy > 0").count() == len(texts)


def test_whole_vocabulary_in_parts_equals_dense(spark, monkeypatch):
    """Contexts dealt in parts while they are counted and ranked, and look-ups
    of which few words are broadcast, give the same rows."""
    corpus = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string").repartition(3)
    scored = spark.createDataFrame(list(enumerate(SCORED)), "doc_id long, text string")
    count = {}
    for t in CORPUS:
        for a, b in zip(t.split(), t.split()[1:]):
            count[a, b] = count.get((a, b), 0) + 1
    exp = dense(100, 0.9, 0.5)
    for part, head in ((2, 3), (100, 0)):
        monkeypatch.setattr(LM, "PART", part)
        monkeypatch.setattr(LM, "HEAD", head)
        m = LM.train(corpus, V=None)
        rows = m.bigrams.collect()
        assert len(rows) == len(count) and {(r.ctx, r.tok): r.c for r in rows} == count
        assert all(r.cc == sum(c for (a, _), c in count.items() if a == r.ctx) for r in rows)
        u = {r.token: r.u for r in m.vocab.collect()}
        assert sorted((r.ctx, r.tok, r.u) for r in LM.seen_pairs(m).collect()) == sorted((a, b, u[b]) for a, b in count)
        got = {r.doc_id: r for r in LM.criteria(m, scored, 0.9, 0.5).collect()}
        for i, e in exp.items():
            for k, v in (e or {}).items():
                assert getattr(got[i], k) == pytest.approx(v, rel=1e-9, abs=1e-9), (part, head, i, k)


def test_pairs_of_asked_contexts_are_kept(spark):
    pairs = spark.createDataFrame([(f"w{i % 300}", f"t{i}", 1, 5) for i in range(900)], "ctx string, tok string, c long, cc long")
    asked = spark.createDataFrame([(f"w{i}",) for i in (0, 7, 7, 299)] + [("new",)], "ctx string")
    got = LM._of_contexts(pairs, asked).collect()
    want = [r for r in pairs.collect() if r.ctx in ("w0", "w7", "w299")]
    assert sorted(r for r in got if r.ctx in ("w0", "w7", "w299")) == sorted(want) and len(got) < 20
