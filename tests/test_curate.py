"""Curation operators (U2, O3-O5, J7, A2, W2) against brute force."""

import hashlib
import math
import random

import pytest

from inkwell.operators import curate as C
from inkwell.operators.ordering import rank_within, top_n_by_hash


def md5key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def skewed_rows(n=3000, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", "c", "d"])
        rows.append((i, g, rnd.randint(0, 1)))
    rows.append((n, "tiny", 1))
    return rows


@pytest.mark.parametrize("n", [1, 7, 50, 5000])
def test_top_n_by_hash_exact(spark, n):
    rows = skewed_rows()
    df = spark.createDataFrame(rows, "id long, g string, label int")
    got = {(r.g, r.rn): r.id for r in top_n_by_hash(df, "g", n, "id", seed=9).collect()}
    exp = {}
    for g in {r[1] for r in rows}:
        ids = sorted((r[0] for r in rows if r[1] == g), key=lambda i: (md5key(9, i), i))[:n]
        for k, i in enumerate(ids, 1):
            exp[(g, k)] = i
    assert got == exp


def test_rank_within_balanced_matches_window(spark):
    rows = skewed_rows(2000)
    df = spark.createDataFrame(rows, "id long, g string, label int")
    got = {r.id: r.rn for r in rank_within(df, "g", ["label", "id"], buckets=5).collect()}
    for g in {r[1] for r in rows}:
        ids = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        for k, r in enumerate(ids, 1):
            assert got[r[0]] == k


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "x", "a"), (1, "x", "b"), (2, "y", "c")], "doc_id long, text string, o string")
    got = sorted((r.doc_id, r.text, r.o) for r in C.keep_first(df, "text").collect())
    assert got == [(1, "x", "b"), (2, "y", "c")]


def test_absolute_split_disjoint_complete(spark):
    rows = skewed_rows(800)
    df = spark.createDataFrame(rows, "id long, g string, label int")
    sp = C.absolute_split(df, ["g", "label"], [("test", 10), ("valid", 5), ("train", 5)], "id", strict=False).collect()
    with pytest.raises(Exception, match="fewer rows"):
        C.absolute_split(df, ["g", "label"], [("test", 800)], "id").collect()
    assert len(sp) == len(rows) and len({r.id for r in sp}) == len(rows)
    by = {}
    for r in sp:
        by.setdefault((r.g, r.label, r.split), []).append(r.id)
    for (g, lab) in {(r[1], r[2]) for r in rows}:
        size = sum(1 for r in rows if (r[1], r[2]) == (g, lab))
        assert len(by.get((g, lab, "test"), [])) == min(10, size)
        assert len(by.get((g, lab, "valid"), [])) == min(5, max(0, size - 10))


def test_sample_per_class_raises_when_too_small(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(10)], "id long, label int")
    assert C.sample_per_class(df, 5, "label", "id").count() == 10
    with pytest.raises(Exception):
        C.sample_per_class(df, 6, "label", "id").collect()


@pytest.mark.parametrize("n0,n1,frac", [(15, 15, 0.2), (500, 500, 0.2), (400, 400, 0.1), (7, 30, 0.2), (1, 9, 0.5)])
def test_stratified_fraction_sizes(spark, n0, n1, frac):
    rows = [(i, 0) for i in range(n0)] + [(n0 + i, 1) for i in range(n1)]
    df = spark.createDataFrame(rows, "id long, label int")
    sp = C.stratified_fraction_split(df, "label", "id", frac).collect()
    n_test = math.ceil((n0 + n1) * frac)
    test = [r for r in sp if r.split == "test"]
    assert len(test) == n_test and len(sp) == n0 + n1
    for lab, cnt in ((0, n0), (1, n1)):
        k = sum(1 for r in test if r.label == lab)
        assert abs(k - n_test * cnt / (n0 + n1)) < 1


def test_match_by_length_balanced(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.randint(0, 1), rnd.randint(1, 6)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, result int, n_words long")
    got = C.match_by_length(df, "n_words").collect()
    for n in range(1, 7):
        h = sorted(r[0] for r in rows if r[2] == n and r[1] == 0)
        m = sorted(r[0] for r in rows if r[2] == n and r[1] == 1)
        k = min(len(h), len(m))
        gh = sorted(r.doc_id for r in got if r.n_words == n and r.result == 0)
        gm = sorted(r.doc_id for r in got if r.n_words == n and r.result == 1)
        assert gh == h[:k] and gm == m[:k]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0, 0), (99, 0), (100, 0), (2500, 0), (2501, 0), (2499, 1)], "n long, c int")
    h = {(r.c, r.bin): r["count"] for r in C.length_histogram(df, "n", "c").collect()}
    assert h[(0, 0)] == 2 and h[(0, 1)] == 1 and h[(0, 24)] == 1 and h[(1, 24)] == 1
    assert sum(v for (c, _), v in h.items() if c == 0) == 4  # 2501 dropped
    assert len(h) == 50  # empty bins reported as 0


def test_prefer_long(spark):
    df = spark.createDataFrame([(1, "a", 300), (2, "a", 10), (3, "b", 10), (4, "b", 20)], "id long, g string, n long")
    got = sorted(r.id for r in C.prefer_long(df, "n", "g", 250).collect())
    assert got == [1, 3, 4]


@pytest.mark.parametrize("salts", [1, 7, 1024])
def test_top_n_is_exact_for_any_number_of_salts(spark, salts):
    rows = skewed_rows(3000, seed=8)
    df = spark.createDataFrame(rows, "id long, g string, label int")
    for n in (5, 40, 300):
        got = {(r.g, r.rn): r.id for r in top_n_by_hash(df, "g", n, "id", seed=3, salts=salts).collect()}
        exp = {}
        for g in {r[1] for r in rows}:
            ids = sorted((r[0] for r in rows if r[1] == g), key=lambda i: (md5key(3, i), i))[:n]
            exp.update({(g, k): i for k, i in enumerate(ids, 1)})
        assert got == exp, n


def test_group_split_keeps_groups_whole_and_classes_in_proportion(spark):
    import random
    rnd = random.Random(3)
    rows, i = [], 0
    for g in range(400):
        for _ in range(rnd.choice([1, 2, 2, 6])):
            rows.append((i, g if g else None, rnd.choice([0, 0, 1])))
            i += 1
    df = spark.createDataFrame(rows, "id long, g long, y int").repartition(6)
    got = C.group_fraction_split(df, "g", "y", 0.2, seed=5).collect()
    assert len(got) == len(rows) and sorted(r.id for r in got) == list(range(i))
    sides = {}
    for r in got:
        sides.setdefault(r.g, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())                      # no group on both sides
    assert sum(s == {"test"} for s in sides.values()) == 80
    for y in (0, 1):
        n = sum(r[2] == y for r in rows)
        assert abs(sum(r.y == y and r.split == "test" for r in got) - 0.2 * n) < 0.03 * n
    again = C.group_fraction_split(df.repartition(2), "g", "y", 0.2, seed=5).collect()
    assert {(r.id, r.split) for r in got} == {(r.id, r.split) for r in again}
    assert C.group_fraction_split(df.where("1 = 0"), "g", "y", 0.2).count() == 0


def test_top_n_from_one_bucket_and_from_all(spark):
    df = spark.range(500).selectExpr("id", "id % 3 as g").repartition(5)
    for salts in (1, 3, 1 << 16):
        for n in (1, 40, 1000):
            got = top_n_by_hash(df, "g", n, "id", salts=salts).groupBy("g").count().collect()
            assert {r.g: r["count"] for r in got} == {g: min(n, len(range(g, 500, 3))) for g in range(3)}
    assert top_n_by_hash(df, None, 7, "id").count() == 7 and top_n_by_hash(df.where("id < 0"), None, 7, "id").count() == 0
