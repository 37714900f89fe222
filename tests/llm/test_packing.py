import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkwell.llm import packing as P

RAW = P.vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text or "", add_special_tokens=False).ids + [2]


def some_texts(n):
    rnd = random.Random(1)
    pool = [*"abcXYZ 012\n\t  .,'\"!?-_()éßñ東京\U0001f600 İǅ½²́  ", "'ll", "<|endoftext|>", "<|endo", "text|>", "<|mid|>", "<|mid|>x"]
    texts = ["", None, "it's we'LL  \n\n x", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", " " * 50,
             "a" * 2000, "\u0000\u0001", "<|endoftext|", " <|endoftext|>\n"]
    return texts + ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 120))) for _ in range(n)]


def test_ids_equal_the_tokenizer_file():
    enc = P.encoder(RAW)
    assert P.token_ids(enc, "a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 2]
    for t in some_texts(200):
        assert P.token_ids(enc, t).tolist() == reference_ids(t), repr(t)


def test_flags_of_added_tokens():
    for flags in ({"lstrip": True}, {"rstrip": True}, {"lstrip": True, "rstrip": True}, {"single_word": True}):
        spec = json.loads(RAW)
        spec["added_tokens"][0].update(flags)
        spec["added_tokens"].append({**spec["added_tokens"][0], "id": 50257, "content": "<|mid|>x"})
        spec["added_tokens"].append({**spec["added_tokens"][0], "id": 50258, "content": "<|mid|>"})
        raw = json.dumps(spec)
        library, enc = Tokenizer.from_str(raw), P.Encoder(raw.encode())
        for t in some_texts(150):
            assert enc.ids(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids, (flags, t)


def test_fullest_is_the_best_subset():
    rnd = random.Random(2)
    for _ in range(150):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(rnd.randint(0, 5))}
        room = rnd.randint(0, 40)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= room}
        used = P.fullest(counts, room)
        assert sum(k * m for k, m in used.items()) == max(sums) and all(m <= counts[k] for k, m in used.items())


def test_plan_places_every_piece_once():
    rnd = random.Random(3)
    hist = {rnd.randint(1, 1024): rnd.randint(1, 60) for _ in range(300)}
    bins, seen = defaultdict(list), defaultdict(int)
    for length, lo, copies, seq, offset in P.plan_bins(hist):
        assert lo == seen[length]
        seen[length] += copies
        for c in range(copies):
            bins[seq + c].append((offset, length))
    assert dict(seen) == hist
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    room: list[int] = []                                   # first fit, longest first
    for k in sorted((k for k, n in hist.items() for _ in range(n)), reverse=True):
        i = next((i for i, r in enumerate(room) if r >= k), None)
        if i is None:
            room.append(1024 - k)
        else:
            room[i] -= k
    assert len(bins) <= len(room)
    assert P.plan_bins({}) == []


def test_query_with_messy_rows(spark, tmp_path, messy, nothing):
    messy.write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op10_min_bin_slack(spark, str(tmp_path)).collect()
    want = []
    for r in messy.collect():
        ids = np.array(reference_ids(r.text), "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024)]
        want += [(-1 if r.doc_id is None else r.doc_id, i, s, e - s, zlib.crc32(ids[s:e].tobytes()))
                 for i, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(ids)]))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert P.packed(nothing).count() == 0
