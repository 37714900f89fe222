import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkwell.llm import tokencounts as T

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RAW = open(MODEL, "rb").read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_units_add_up_to_the_whole_text(library):
    rnd = random.Random(3)
    model = T.counter(MODEL, RAW)
    assert model.at_space and model.guard
    pool = ["a", "b", " ", " ", "  ", "\n", "▁", "1", "23", "東京", "\U0001f600", "</s>", "<s>", "<unk>",
            "<0x0A>", "the", "ing", "　", "\0", "\x01", ".", "...", "\t", "é", "é"]
    for _ in range(600):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(1, 120)))
        want = len(library.encode(text))
        for most in (1, 2, 5, 17, 1000):
            units = model.units(text, most)
            assert sum(n - off for n, (_, off) in zip(model.counts([u for u, _ in units]), units)) == want, (text, most)


def test_long_texts_are_cut_and_others_stay_whole(library):
    model = T.counter(MODEL, RAW)
    words = "some words and more " * 4000
    assert max(len(u) for u, _ in model.units(words, 1000)) <= 1000
    digits = "1234567890" * 3000                             # no space, but no piece holds two digits
    assert max(len(u) for u, _ in model.units(digits, 1000)) <= 1001
    one = "a" * 3000                                         # nowhere safe
    assert model.units(one, 1000) == [(one, 0)]
    late = "a" * 3000 + " tail of words"
    assert len(model.units(late, 1000)) > 1
    for t in (words, digits, one, late, " " * 5000, "\n" * 5000):
        assert T.lengths(model, [t, None, "", t], 1 << 12, 1000) == [len(library.encode(t)), 0, 0, len(library.encode(t))]


def test_batches_are_balanced_by_size():
    units = [(i, "x" * n, 0) for i, n in enumerate([10, 5000, 10, 10, 900, 200, 3])]
    got = list(T.batches_of(iter(units), 1000))
    assert [u for b in got for u in b] == units
    assert all(sum(len(u[1]) + 16 for u in b[:-1]) < 1000 for b in got)


def test_query_with_messy_rows(spark, tmp_path, messy, nothing, library):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    got = T.op13_token_counts(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted(((r.doc_id or -1), len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096)
                  for r in messy.collect())
    assert sorted(((r.doc_id or -1), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    assert any(w[3] for w in want)
    assert T.counted(nothing).count() == 0


def test_json_tokenizer(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "plain words  and\nlines", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.counted(df, path).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
