import hashlib
import random

import numpy as np

from inkwell.llm import fingerprints as P
from inkwell.llm.common import shingles, words_of

from .conftest import sentence


def of(text):
    return P.sketch(shingles(words_of(text)))


def test_estimate_is_unbiased_near_the_jaccard_similarity():
    rnd = random.Random(8)
    errors = []
    for k in range(120):
        n = rnd.choice([3, 8, 40, 200, 900])
        a = sentence(rnd, n, 10 ** 6).split()
        b = list(a)
        b[-max(1, len(b) * (k % 10) // 10):] = sentence(rnd, max(1, len(b) * (k % 10) // 10), 10 ** 6).split()
        sa, sb = set(shingles(a).tolist()), set(shingles(b).tolist())
        errors.append(P.likeness(of(" ".join(a)), of(" ".join(b))) - len(sa & sb) / len(sa | sb))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).mean() < 0.06


def test_short_and_empty_texts():
    assert of("") is None and of(" .. ") is None and P.likeness(None, None) == 1.0 and P.likeness(None, of("a")) == 0.0
    assert P.likeness(of("one two"), of("One, TWO!")) == 1.0 and P.likeness(of("one"), of("two")) < 0.2
    assert P.packed(of("a b c")) == P.packed(of("a b c")) != P.packed(of("a b d"))
    assert len(P.packed(of("a"))) == P.BINS * P.BITS // 4 and P.packed(None).startswith("-")


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[:len(t) - h] + n[:h]
        out.append((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), P.packed(of(t)), P.packed(of(e)),
                    round(P.likeness(of(t), of(e)), 6), round(P.likeness(of(t), of(n)), 6)))
    return sorted(out)


def got(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint,
                   round(r.near_edited, 6), round(r.near_next, 6)) for r in df.collect())


def test_next_document_across_ranges(spark, messy, nothing):
    rnd = random.Random(6)
    rows = [(k * k * 7 - 5000, sentence(rnd, rnd.randint(0, 30))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(P.fingerprints(df)) == expected(rows)
    assert got(P.fingerprints(messy)) == expected([(r.doc_id, r.text) for r in messy.collect()])
    assert P.fingerprints(nothing).count() == 0
    one = spark.createDataFrame([(5, "just this text here now")], "doc_id long, text string")
    assert got(P.fingerprints(one)) == expected([(5, "just this text here now")])
    nulls = spark.createDataFrame([(None, "x"), (None, "a b")], "doc_id long, text string")
    assert got(P.fingerprints(nulls)) == expected([(None, "x"), (None, "a b")])
