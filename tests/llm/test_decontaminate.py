import hashlib
import random
import re

from inkwell.llm import decontaminate as D

from .conftest import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, its = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    its |= x
        out.append((-1 if d is None else d, len(w), len(hit), len(its),
                    hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def query(spark, path, docs, items, **extra):
    docs.write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
                  for r in D.op2_winnowing(spark, str(path)).collect())


def test_against_brute_force(spark, tmp_path, messy):
    rnd = random.Random(3)
    base = next(r.text for r in messy.collect() if r.doc_id == 1).split()
    items = [(0, " ".join(base[20:45])), (1, " ".join(base[30:40])), (2, " ".join(base[31:40])), (3, None), (4, ""),
             (5, "One TWO"), (6, "größe, naïve"), (7, "a " * 12), (8, sentence(rnd, 25)), (None, " ".join(base[100:130])),
             (11, " ".join(base[20:45])), (12, "zz zz zz zz zz zz zz zz zz zz zz yy")]
    more = spark.createDataFrame([(50, "a " * 40), (51, "A, a; a " * 9), (52, "zz " * 30 + "yy"),
                                  (53, " ".join(base[25:36]).upper()), (54, " ".join(base[25:34]))], "doc_id long, text string")
    docs = messy.select("doc_id", "text", "key", "w").unionByName(more, allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = query(spark, tmp_path, docs, bench)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], items)


def test_random_shared_spans(spark, tmp_path):
    rnd = random.Random(9)
    docs, items = [], []
    for i in range(40):
        items.append((i, sentence(rnd, rnd.randint(1, 40), words=12)))
    for d in range(80):
        docs.append((d, sentence(rnd, rnd.randint(0, 60), words=12) + " " + rnd.choice(items)[1]))
    got = query(spark, tmp_path, spark.createDataFrame(docs, "doc_id long, text string"),
                spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)


def test_empty_sides_and_clean(spark, messy, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    out = D.clean(messy, none)
    assert out.columns == messy.columns and out.count() == messy.count()
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    left = D.clean(messy, bench)
    assert left.count() == messy.count() - 1 and left.where("doc_id = 7").isEmpty()
    assert D.clean(nothing, bench).count() == 0


def test_shuffle_joins_give_the_same(spark, tmp_path, monkeypatch, messy):
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    base = next(r.text for r in messy.collect() if r.doc_id == 1).split()
    items = [(1, " ".join(base[50:70])), (2, "one two")]
    docs = messy.select("doc_id", "text")
    got = query(spark, tmp_path, docs, spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], items)
