import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import chat as C

TEXT = st.text(alphabet="ab\\<[l/s>]\nINST é\U0001f600", max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\n<b"]), TEXT), max_size=6), TEXT)
def test_round_trip_and_spans(turns, text):
    assert C.unescape(C.escape(text)) == text and not set("<[") & set(C.escape(text))
    found = C.locate(turns, C.marked_turns)
    out = "".join(p for p, *_ in found)
    assert out == C.marked_turns(turns)
    for (role, t), (piece, a, b, new) in zip(turns, found):
        assert C.unescape(out[a:b]) == t and not new
        m = C._PIECE.fullmatch(piece)
        assert (C.unescape(m[1]), C.unescape(m[2])) == (role, t)


def test_template_that_rewrites_history():
    def short_memory(turns):                               # older answers lose their text
        return "".join(f"<{r}>{t if r != 'assistant' or k >= len(turns) - 2 else '~'}\n" for k, (r, t) in enumerate(turns))

    turns = [("user", "q1"), ("assistant", "one"), ("user", "q2"), ("assistant", "two")]
    found = C.locate(turns, short_memory)
    out = "".join(p for p, *_ in found)
    assert out == short_memory(turns) and [f[3] for f in found] == [False, False, False, True]
    assert [out[a:b] for _, a, b, _ in found][2:] == ["q2", "two"]


def test_long_conversation_with_a_template_that_rewrites_history(spark):
    def short_memory(turns):                               # older answers lose their text
        return "".join(f"<{r}>{t if r != 'assistant' or k >= len(turns) - 2 else '~'}\n" for k, (r, t) in enumerate(turns))

    def first_seen(turns):                                 # looks back to the first turn, rewrites nothing
        return "".join(f"<{r}>{t}|{turns[0][1]}\n" for r, t in turns)

    for n in (514, 1500):
        turns = [("assistant" if k % 2 else "user", f"turn {k}") for k in range(n)]
        df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)],
                                   "conv_id long, turn long, role string, text string")
        for template in (short_memory, first_seen):
            rows = sorted(C.format_turns(df, template).collect(), key=lambda r: r.seq)
            out = template(turns)
            assert "".join(r.piece for r in rows) == out
            assert [r.rewrites for r in rows] == [template is short_memory and k > 1 and k % 2 == 1 for k in range(n)]
            assert [out[r.text_from:r.text_to] for r in rows[-2:]] == [f"turn {n - 2}", f"turn {n - 1}"]


def expected(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "",
                                         r[3] is not None, r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = []
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((-9 if conv is None else conv, len(turns),
                    hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(C.marked_turns(turns))))
    return sorted(out)


def test_query_with_messy_rows_and_a_long_conversation(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["hi [x]", "", "</s>", "é\\l\\b", "a\nb"]) * rnd.randint(1, 9))
            for c in range(20) for t in range(rnd.randint(1, 9))]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(1500)]
    rows += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 1, "user", "x"), (None, None, None, None), (4, None, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as seq", "2 as piece")
    df.repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    told = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", told), (-1, 1, "assistant", told)]
    got = sorted((-9 if r.conv_id is None else r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars)
                 for r in C.op5_prefix_rendering(spark, str(tmp_path)).collect())
    assert got == expected(rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_turns(none)).count() == 0


def test_blocks_of_a_local_template_give_the_same_pieces(spark):
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["", "hi", "</s>", "a\nb"]) * rnd.randint(1, 4))
            for c, n in ((1, 1), (2, 3), (3, 40)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, C.format_turns(df).collect()))
    for window in (1, 2, 7, 512):
        assert sorted(map(tuple, C.format_turns(df, window=window).collect())) == whole


def test_query_renders_every_prefix_whole(spark, tmp_path, monkeypatch):
    real, log = C.format_turns, f"{tmp_path}/log"

    def logged(turns):
        with open(log, "a") as f:
            f.write(f"{len(turns)}\n")
        return C.marked_turns(turns)

    monkeypatch.setattr(C, "format_turns", lambda df, **options: real(df, logged, **options))
    rows = [(5, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op5_prefix_rendering(spark, str(tmp_path)).count() == 2
    # Conversations 5 and -1: every prefix as it is and with its last text empty.
    assert sorted(map(int, open(log))) == sorted([k for k in range(1, 31)] * 2 + [1, 2] * 2)
