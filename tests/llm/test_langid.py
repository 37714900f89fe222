import math
import random
import zlib
from collections import Counter

import pytest

from inkwell.llm import langid as L

WORDS = {"aa": "the and of that with ring thing string".split(), "bb": "der und die nicht schule scheu schicht".split(),
         "cc": "le la et que nous vous chaque".split()}


def corpus(spark, n=240):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rnd.choice(WORDS[lang]) for _ in range(12)), lang))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_rule_and_accuracy(spark, tmp_path):
    rows, df = corpus(spark)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in L.op6_word_backoff(spark, str(tmp_path)).collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _, _ in rows)
    assert all(got[d].lang_pred == lang and 0.5 < got[d].score <= 1 for d, _, lang in rows)


def test_held_out_rows_never_teach(spark):
    rows, df = corpus(spark)
    odd = [(d, "zzqq zzqq", "dd") for d in range(10_000, 10_400) if zlib.crc32(str(d).encode()) % 3 == 1]
    model = L.fit(df.unionByName(spark.createDataFrame(odd, df.schema)))
    assert model["langs"] == ["aa", "bb", "cc"]


def test_unknown_words_fall_back_to_their_characters(spark):
    _, df = corpus(spark)
    model = L.fit(df)
    scorer = L.Scorer(model, spare=6)
    assert L.guess(scorer, model, "schulen schichten scheune")[0] == "bb"
    assert L.guess(scorer, model, "strings things springing")[0] == "aa"
    # a small store of unknown words forgets, the result stays
    many = " ".join(f"schul{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    assert L.guess(scorer, model, many) == L.guess(L.Scorer(model), model, many)


def test_bounded_sample_still_learns(spark):
    _, df = corpus(spark)
    model = L.fit(df, max_rows=60, max_words=5, max_grams=10)
    assert model["langs"] == ["aa", "bb", "cc"] and len(model["tables"][0][0]) <= 25


PROSE = {"en": ("the house by the river was old and its windows looked over the water to the hills where the children "
                "played in the summer when the days were long and the evenings warm and nobody thought of the winter that "
                "would come with snow and wind and short days in which they read books by the fire and told stories"),
         "de": ("das haus am fluss war alt und seine fenster sahen über das wasser zu den hügeln wo die kinder im sommer "
                "spielten wenn die tage lang und die abende warm waren und niemand an den winter dachte der mit schnee und "
                "wind und kurzen tagen kommen würde an denen sie am feuer bücher lasen und geschichten erzählten"),
         "zh": "河边的房子很旧窗户望着水面和山丘夏天孩子们在那里玩耍白天很长晚上很暖和没有人想到冬天会带来雪和风"}
RUSSIAN = ("все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему все смешалось в доме "
           "жена узнала что муж был в связи с бывшею в их доме француженкою гувернанткой и объявила мужу что не может жить "
           "с ним в одном доме")


def test_rejects_on_evidence(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        lang = ("en", "de", "zh")[i % 3]
        p = PROSE[lang] if lang == "zh" else PROSE[lang].split()
        k = rnd.randrange(len(p) - 15)
        text = p[k:k + 15] if lang == "zh" else " ".join(p[k:k + 15])
        rows.append((i, text, lang))
    rows[0] = (0, rows[0][1] + " he said: " + " ".join(RUSSIAN.split()[:9]), "en")   # stray quotes
    rows[3] = (3, rows[3][1] + " все в доме, was her answer", "en")
    odd = [RUSSIAN, "xkqj zzpqw vbnxz qwrtp lkjhg mnbvc zxcvq ghjkl", "zzqq " * 50, "ქართული ენა არის ერთი",
           "nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
           "kaikki onnelliset perheet ovat toistensa kaltaisia mutta jokainen onneton perhe on onneton omalla tavallaan"]
    clean = ["the house", "Winter!", "old books and warm windows", "am Fluss", "die Kinder lasen", "房子很旧", "冬天的风和雪",
             "the children told stories, 12 of them: " + RUSSIAN[:12]]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd)] + [(2000 + i, t, None) for i, t in enumerate(clean)]
    got = {r.doc_id for r in L.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == set(range(300)) | {2000 + i for i in range(len(clean))}


def test_messy_rows(spark, messy, nothing):
    _, df = corpus(spark)
    model = L.fit(df)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in L.predict(messy.select("doc_id", "text"), model).collect()}
    assert got[4, None] == got[5, ""] == got[11, "!!! ... ###"] == ("und", 0.0)
    assert got[8, "a" * 5000][0] in model["langs"]
    assert L.predict(nothing.select("doc_id", "text"), model).count() == 0
    out = L.identified(messy)
    assert out.columns == messy.columns and out.where("doc_id in (4, 5, 6, 11)").isEmpty()
    bare = L.fit(messy.where("lang is null"))
    assert {r.lang_pred for r in L.predict(messy.select("text"), bare).collect()} == {"und"}


def naive(rows, texts):
    """Plain sums of log frequencies with back-off, over dictionaries."""
    grams = {k: {} for k in range(L.TOP_GRAM + 1)}
    for _, text, lang in rows:
        for w in L._LETTERS.findall(text.lower()):
            grams[0].setdefault(w, Counter())[lang] += 1
            s = f"^{w}$"
            for k in range(1, L.TOP_GRAM + 1):
                for i in range(len(s) - k + 1):
                    grams[k].setdefault(s[i:i + k], Counter())[lang] += 1
    langs = sorted({lang for _, _, lang in rows})
    total = {k: Counter() for k in grams}
    for k, t in grams.items():
        for c in t.values():
            total[k].update(c)

    def logs(k, g):
        return [math.log((grams[k][g][x] + 0.5) / (total[k][x] + 0.5 * len(grams[k]))) for x in langs]

    def word(w):
        if w in grams[0]:
            return logs(0, w)
        s = f"^{w}$"
        for k in range(min(L.TOP_GRAM, len(s)), 0, -1):
            known = [g for i in range(len(s) - k + 1) if (g := s[i:i + k]) in grams[k] and g.strip("^$")]
            if known:
                return [sum(c) / len(known) for c in zip(*(logs(k, g) for g in known))]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        ws = L._LETTERS.findall(t.lower())
        out.append([sum(c) for c in zip(*map(word, ws))] if ws else None)
    return out


def test_sums_equal_a_naive_scorer(spark):
    rows, df = corpus(spark)
    seen = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    scorer = L.Scorer(L.fit(df))
    rnd = random.Random(7)
    words = [w for ws in WORDS.values() for w in ws]
    texts = [" ".join(rnd.choice(words)[rnd.randrange(3):] + rnd.choice(["", "", "s", "ing", "é", "東"]) for _ in range(9)) for _ in range(60)]
    for t, want in zip(texts, naive(seen, texts)):
        assert scorer.sums(L._LETTERS.findall(t.lower()))[0].tolist() == pytest.approx(want, abs=1e-3)


def test_rare_language_keeps_its_rows(spark):
    rows, df = corpus(spark, 3000)
    rare = spark.createDataFrame([(90_000 + i, "kala maja puu vesi taevas", "ee") for i in range(30)], df.schema)
    model = L.fit(df.unionByName(rare), max_rows=150)
    assert model["langs"] == ["aa", "bb", "cc", "ee"]
    assert L.guess(L.Scorer(model), model, "maja puu")[0] == "ee"
    assert L.quota([3000, 3000, 20], 150) == 65 and L.quota([5, 7], 100) == 7 and L.quota([], 5) == 0
