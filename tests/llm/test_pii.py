import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(d) <= 15
                    or kind == "card" and not (13 <= len(d) <= 19 and luhn(d))):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def spans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.candidates(df)
    rows = found.select("doc_id", pii.listed(F.array_sort("_base")).alias("b")).collect()
    return {r.doc_id: r.b for r in rows}


TEXTS = ["a@b.c_x@d.e then x@y", "mail jo.ann+1@ex-am.ple.com. 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255",
         "4111 1111 1111 1111 and 4111-1111-1111-1112, 12345678901234567890123",
         "+1 (269) 555-3296 x +49 12 +123456789012345678 + 12 +1..........", "é\U0001f600 z@q.io \U0001f600 9.9.9.9",
         "", "9" * 3000, "a" * 3000 + "@", ("q@w.er " * 700), "1-1-1-1-1-1 4539 1488 0343 6467 " * 5, "@a.b 1.2.3", "\n+1-202-555-0143\n"]


def test_base_spans_match_brute_force(spark):
    got = spans(spark, TEXTS)
    assert got == {i: base(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="a1. @+-(9%_\n4é", max_size=40), min_size=60, max_size=80))
def test_base_spans_random(spark, texts):
    assert spans(spark, texts) == {i: base(t) for i, t in enumerate(texts)}


def test_labelers_add_loose_spans_and_reject_others(spark):
    good = [f"please call {200 + i} 555-01{i:02d} today" for i in range(10, 40)]
    mail = [f"mail to joe{i} [at] host{i} [dot] com now" for i in range(30)]
    bad = [f"order ref {4000000000000000 + 7 * i} shipped" for i in range(30)]
    strong = [f"card 4111 1111 1111 1111 mail a{i}@b.com tel +1 202 555 0{100 + i}" for i in range(60)]
    texts = good + mail + bad + strong
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = pii.candidates(df)
    model = pii.fit(found)
    rows = {r.doc_id: r.s for r in pii.decided(found, model).select(
        "doc_id", pii.listed(F.col("_spans")).alias("s")).collect()}
    assert all(rows[i].startswith("phone:12:24") for i in range(30))
    assert all(rows[30 + i].startswith("email:8:") for i in range(30))
    assert all("card" not in rows[60 + i] or base(texts[60 + i]) == rows[60 + i] for i in range(30))
    assert all(base(t) == rows[90 + i] for i, t in enumerate(strong))


def test_estimate_trusts_the_reliable_labeler():
    p = [((0, 1, 1, 1), 100), ((0, 1, 1, 0), 50), ((0, -1, -1, -1), 100), ((0, -1, -1, 0), 50), ((0, 1, -1, 1), 3)]
    q = pii.estimate(p)
    assert q[0] > 0.9 and q[1] > 0.9 and q[2] < 0.1 and q[3] < 0.1


def test_masking_keeps_rows_and_columns(spark, messy, nothing):
    out = pii.masked(messy)
    assert out.columns == messy.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, messy.collect()))     # nothing personal in it
    assert pii.masked(nothing).columns == messy.columns and pii.masked(nothing).count() == 0
    df = spark.createDataFrame([(1, "x a@b.com y 1.2.3.4!"), (2, None), (3, "u1.2.3.4@h.org"), (4, "+1 4111 1111 1111 11")],
                               "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.masked(df).collect()}
    assert got[1] == "x [EMAIL] y [IP]!" and got[2] is None and got[3] == "[EMAIL]"


def test_query_digests(spark, tmp_path, messy):
    messy.select("doc_id", "text", "lang", "key", "row").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.base_sha256, r.spans) for r in pii.op1_weak_supervision(spark, str(tmp_path)).collect())
    want = sorted((r.doc_id or 0, hashlib.sha256(base(r.text or "").encode()).hexdigest(), base(r.text or "")) for r in messy.collect())
    assert got == want
