import hashlib
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import suffixdedup as S
from inkwell.llm.common import small


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_of_small_alphabets(t):
    assert S.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_suffix_array_of_periodic_texts():
    for t in ([1] * 50, [1, 2] * 40, [2, 1] * 40 + [3], [1, 1, 2] * 30 + [1, 1], [3, 1, 2, 3, 1, 2, 0] * 9):
        assert S.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i:i + S.SPAN] for i in range(len(b) - S.SPAN + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - S.SPAN + 1):
            if count[b[i:i + S.SPAN]] > 1:
                gone[i:i + S.SPAN] = b"\1" * S.SPAN
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((-1 if d is None else d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def query(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in S.op3_lyndon_grouping(spark, str(path)).collect())


def planted():
    rnd = random.Random(2)

    def noise(n):
        return "".join(rnd.choice("abcdefgh é\n") for _ in range(n))

    passages = [noise(n) for n in (399, 400, 401, 700, 1500)]
    rows = [(i, noise(rnd.randint(0, 900)) + rnd.choice(passages) + noise(rnd.randint(0, 900))) for i in range(40)]
    long = noise(900)
    rows += [(100 + i, long[:300 + 10 * i] + "#" + long[301 + 10 * i:]) for i in range(12)]      # many variants of an anchor
    rows += [(200, "ab" * 600), (201, "x" * 1000), (202, passages[3] + passages[3]), (203, None), (204, ""),
             (205, noise(399)), (None, passages[4]), (None, passages[4]), (206, long[:420]), (206, long[:420])]
    return rows


def test_against_brute_force(spark, tmp_path, messy):
    rows = planted() + [(r.doc_id, r.text) for r in messy.collect() if r.doc_id != 9]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as ta", "3 as `key`").repartition(4)
    assert query(spark, tmp_path, docs) == brute(rows)


def test_hot_anchors_shuffles_and_chunks_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 2)
    monkeypatch.setattr(S, "BROADCAST_ROWS", -1)
    rows = planted()
    assert query(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_chunks_of_long_texts(monkeypatch):
    rnd = random.Random(1)
    data = bytes(rnd.randrange(97, 100) for _ in range(5000))
    monkeypatch.setattr(S, "CHUNK", 1000)
    cuts = list(S.segments(data))
    assert sum(n for _, _, n, _ in cuts) == 5000 - S.SPAN + 1
    at = 0
    for _, start, spans, offset in cuts:
        assert start == at and 0 <= offset <= S.SPAN - S.GRAM and spans <= S.SPAN - S.GRAM + 1
        at += spans


def test_empty_table(spark, nothing):
    assert S.remove(nothing).count() == 0


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of over 50 words in two texts each: those of at least a span
    go whole, the shorter ones stay (the span is counted in bytes)."""
    rnd = random.Random(21)
    rows, want = [], {}
    for i, size in enumerate([300, 350, 390, 398, 399, 400, 401, 402, 410, 450, 700]):
        words = []
        while len(" ".join(words)) < size - 8:
            words.append("".join(rnd.choice("abcdefgh") for _ in range(5)))
        passage = " ".join(words).ljust(size, "z")
        assert len(passage) == size and len(words) > 45
        for k in (0, 1):
            # No equal byte next to the passage makes the match longer.
            text = f"{i}{k} " + " ".join(str(rnd.random()) for _ in range(60)) + "AB"[k] + passage + "CD"[k] + str(rnd.random()) * 9
            rows.append((2 * i + k, text))
            want[2 * i + k] = size if size >= 400 else 0
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (n, int(n > 0)) for d, n in want.items()}


def test_broadcast_only_below_rows_and_bytes(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) as t", "array(id, id) as a", "array('ab', null) as s")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(df, 100)) and not hinted(small(df, 99)) and not hinted(small(df, 100, 100_000))
    assert hinted(small(df, 100, 110_000)) and hinted(small(df.where("id < 0"), 0, 0))
