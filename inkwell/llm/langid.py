"""Language identification by words first, character n-grams second.

A word that the model knows adds its log frequency in each language.  A word
that it does not know falls back to its n-grams of ``TOP_GRAM`` characters,
and to ever shorter ones until some are known; their mean log frequency is
added.  The language of the largest sum wins.

The model is fitted on at most about ``max_rows`` labelled rows (a bounded
sample by a hash of the id; a documented limit of the fit alone).  The sample
is shared out over the languages so that small ones keep all their rows: each
language gives up to the same number of rows.  All words and n-grams of the
sample are in the model; it is a few sorted arrays of 64-bit hashes with the
counted (language, log frequency) entries of each, so its size is that of the
sample's vocabulary.  Every document is scored whole.

Edge cases: null text and text without a letter get ``und`` and score 0;
letters of which the model knows nothing get the most frequent language and
the score 1 / languages; without labelled rows all get ``und``; ties go to
the language that sorts first; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import boxed, cut, mix64, only, ship, table, unboxed

_LETTERS = re.compile(r"[^\W\d_]+")
TOP_GRAM = 5
RARE = 4.0
# Letters of scripts that write syllables or words as one sign,
# or words without spaces (Thai to Myanmar, Khmer, Chinese, Japanese, Korean).
_DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\U0003ffff]")


def held_out(doc_id) -> F.Column:
    """True for the third of the ids that the fit must not see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quota(sizes: list[int], most: int) -> float:
    """The largest number of rows a language, with all rows of the smaller
    ones, that keeps the sum at or below ``most``."""
    left, rest = float(most), sorted(sizes)
    for i, n in enumerate(rest):
        share = left / (len(rest) - i)
        if n > share:
            return share
        left -= n
    return float(rest[-1]) if rest else 0.0


class Table(NamedTuple):
    """The grams of one length.  Sorted hashes; of each, from ``start`` on, the
    languages that have it, their log frequencies, and whether it is usual
    there.  ``floor`` is the log frequency of what was not counted."""
    h: np.ndarray
    start: np.ndarray
    at: np.ndarray
    logs: np.ndarray
    usual: np.ndarray
    floor: np.ndarray


def fit(docs: DataFrame, max_rows: int = 20_000, max_words: int | None = None, max_grams: int | None = None) -> dict:
    """The model of a bounded sample of the labelled rows: languages, and by
    n-gram length (0: whole words) a table.  ``max_words`` and ``max_grams`` can
    hold a table to the most frequent entries of each language; by default all
    are kept."""
    rows = only(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}      # a row a language
    langs, most = sorted(sizes), quota(list(sizes.values()), max_rows)
    if not langs:
        return {"langs": [], "first": 0, "tables": {}}
    small = rows.sparkSession.createDataFrame(
        [(x, i, int(1_000_003 * min(1.0, most / sizes[x]))) for i, x in enumerate(langs)], "lang string, at short, _share int")
    rows = rows.join(F.broadcast(small), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.col("_share"))
    words = (rows.select("at", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1)).alias("gram"))
             .groupBy("at", "gram").agg(F.count("*").alias("n")))
    words = cut(words, "words")
    sides = words.select("at", "n", F.concat(F.lit("^"), "gram", F.lit("$")).alias("w"))
    parts = [words.select("at", "gram", "n", F.lit(0).alias("size"))]
    for k in range(1, TOP_GRAM + 1):
        at = F.expr(f"transform(sequence(1, length(w) - {k - 1}), i -> substring(w, i, {k}))")
        parts.append(sides.where(F.length("w") >= k).select("at", F.explode(at).alias("gram"), "n")
                     .groupBy("at", "gram").agg(F.sum("n").alias("n"))
                     .select("at", "gram", "n", F.lit(k).alias("size")))
    tables, first = {}, 0
    for size, part in enumerate(parts):
        got = part.select("gram", "at", "n").toArrow()                                   # the sample's vocabulary
        grams, at, n = got.column("gram").to_pylist(), got.column("at").to_numpy(), got.column("n").to_numpy()
        if size == 0:
            first = int(np.argmax(np.bincount(at, weights=n, minlength=len(langs))))
        tables[size] = entries(hashes(grams), at, n, len(langs), max_grams if size else max_words)
    return {"langs": langs, "first": first, "tables": tables}


def entries(h: np.ndarray, at: np.ndarray, n: np.ndarray, langs: int, most: int | None = None) -> Table:
    if most is not None:
        order = np.lexsort((h, -n, at))
        rank = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        kept = order[rank < most]
        h, at, n = h[kept], at[kept], n[kept]
    order = np.lexsort((at, h))
    h, at, n = h[order], at[order].astype(np.int16), n[order].astype(float)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
    total = np.bincount(at, weights=n, minlength=langs)
    whole = total + 0.5 * len(first)
    logs = np.log((n + 0.5) / whole[at])
    floor = np.log(0.5 / np.maximum(whole, 1.0))
    # Usual is what was counted at least exp(-RARE) times as often as the
    # (geometric) mean of the language.
    none = len(first) - np.bincount(at, minlength=langs)
    mean = np.bincount(at, weights=np.exp(logs) * logs, minlength=langs) + none * np.exp(floor) * floor
    return Table(h[first], np.append(first, len(h)), at, logs.astype(np.float32), logs >= mean[at] - RARE,
                 floor.astype(np.float32))


_FACTORS = mix64(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of non-empty strings: code points times a factor by
    place, summed and mixed with the length."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    if not len(n):
        return np.empty(0, np.uint64)
    start = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(start, n)
    return mix64(np.add.reduceat(_points("".join(words)) * _FACTORS[place % len(_FACTORS)], start) + n.astype(np.uint64) * _LENGTH)


def gram_hashes(words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of its word and the hash (as ``hashes`` has it) of every
    run of ``k`` characters of the words, all computed together."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    n = np.maximum(size - k + 1, 0)
    flat = _points("".join(words))
    if not n.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    sums = np.zeros(len(flat) - k + 1, np.uint64)
    for j in range(k):
        sums += flat[j:len(flat) - k + 1 + j] * _FACTORS[j]
    at = np.repeat(np.cumsum(size) - size - np.cumsum(n) + n, n) + np.arange(n.sum())
    return np.repeat(np.arange(len(words)), n), mix64(sums[at] + np.full(1, k, np.uint64) * _LENGTH)


class Scorer(dict):
    """word -> row of the log frequencies, and of the evidence, of the words
    met so far; all are forgotten when ``spare`` are kept.  New words are worked
    out together, a gram length at a time.

    The evidence of a word is the share of it that each language is known to
    use: 1 if the word is usual there, or else the mean share of its n-grams of
    3 to 5 characters (1 and 2 of scripts that need no more) that are.  A stray
    quote does not make its language or script known."""

    def __init__(self, model: dict, spare: int = 200_000, evidence: bool = False):
        super().__init__()
        self.tables, self.spare, self.evidence = model["tables"], spare, evidence
        self.langs = len(model["langs"])
        self.logs = np.zeros((spare, self.langs), np.float32)
        self.known = np.zeros((spare if evidence else 1, self.langs), np.float32)
        self.size = np.zeros(spare)

    def found(self, k: int, want: np.ndarray) -> np.ndarray:
        """The place of each hash in table ``k``; -1 if it is not there."""
        h = self.tables[k].h
        if not len(h):
            return np.full(len(want), -1)
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        return np.where(h[at] == want, at, -1)

    def spread(self, k: int, owner: np.ndarray, places: np.ndarray, rows: int, usual: bool) -> np.ndarray:
        """Sums over the grams at ``places`` by the word that owns them and
        language: of what their log frequency has above the floor, or of how
        many are usual."""
        t = self.tables[k]
        n = t.start[places + 1] - t.start[places]
        entry = np.repeat(t.start[places] - np.cumsum(n) + n, n) + np.arange(n.sum())
        lang = t.at[entry]
        cell = np.repeat(owner, n) * self.langs + lang
        sums = np.bincount(cell, t.usual[entry] if usual else t.logs[entry] - t.floor[lang], rows * self.langs)
        return sums.reshape(rows, self.langs)

    def grams(self, words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word all grams of length ``k``: the word's number, the
        gram's place."""
        # The marks of the ends alone say nothing.
        owner, h = gram_hashes(words if k == 1 else [f"^{w}$" for w in words], k)
        return owner, self.found(k, h)

    def learn(self, words: list[str]) -> None:
        """Rows of new words."""
        n, whole = len(words), self.found(0, hashes(words))
        logs, rest = np.zeros((n, self.langs)), np.flatnonzero(whole < 0)
        seen = np.flatnonzero(whole >= 0)
        logs[seen] = (self.tables[0].floor + self.spread(0, seen, whole[seen], n, False))[seen]
        for k in range(TOP_GRAM, 0, -1):                             # back-off
            if not len(rest):
                break
            owner, places = self.grams([words[i] for i in rest], k)
            owner, places = owner[places >= 0], places[places >= 0]
            times = np.bincount(owner, minlength=len(rest))
            sums, hit = self.spread(k, owner, places, len(rest), False), times > 0
            logs[rest[hit]] = self.tables[k].floor + sums[hit] / times[hit, None]
            rest = rest[~hit]
        start = len(self)
        self.logs[start:start + n] = logs
        if self.evidence:
            self.known[start:start + n] = self.shares(words, seen, whole[seen])
            self.size[start:start + n] = [len(w) for w in words]
        self.update(zip(words, range(start, start + n)))

    def shares(self, words: list[str], seen: np.ndarray, whole: np.ndarray) -> np.ndarray:
        out, lengths = np.zeros((len(words), self.langs)), np.zeros(len(words))
        dense = np.array([bool(_DENSE.search(w)) for w in words], bool)
        for k in range(1, TOP_GRAM + 1):
            mine = np.flatnonzero(dense if k < 3 else ~dense)
            owner, places = self.grams([words[i] for i in mine], k)
            of = np.bincount(owner, minlength=len(mine))
            part = self.spread(k, owner[places >= 0], places[places >= 0], len(mine), True)
            out[mine] += part / np.maximum(of, 1)[:, None]
            lengths[mine] += of > 0
        return np.maximum(out / np.maximum(lengths, 1)[:, None], self.spread(0, seen, whole, len(words), True))

    def prepare(self, words: Iterable[str]) -> None:
        """Make room for, and learn, the new ones of at most ``spare`` words."""
        every = dict.fromkeys(words)
        new = [w for w in every if w not in self]
        if len(self) + len(new) > self.spare:
            self.clear()
            new = list(every)
        for at in range(0, len(new), 20_000):
            self.learn(new[at:at + 20_000])

    def sums(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log frequencies, and the share of the letters that each
        language is known to use (zeros without evidence)."""
        total, used, letters = np.zeros(self.langs), np.zeros(self.langs), 0.0
        for at in range(0, len(words), self.spare):                  # so that one very long text fits
            part = words[at:at + self.spare]
            self.prepare(part)
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            total += self.logs[rows].sum(axis=0, dtype=float)
            if self.evidence:
                used += self.size[rows] @ self.known[rows]
                letters += self.size[rows].sum()
        return total, used / max(letters, 1.0)


def words_in(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def guess(scorer: Scorer | None, model: dict, text: str | list[str] | None) -> tuple[str, float, float]:
    """Language, score, and the share of the text's letters that it is known
    to use; of a text or of its words."""
    words = text if isinstance(text, list) else words_in(text)
    if scorer is None or not words:
        return "und", 0.0, 0.0
    s, known = scorer.sums(words)
    if s.max() == s.min():
        return model["langs"][model["first"]], 1.0 / len(s), float(known[model["first"]])
    p = np.exp(s - s.max())
    at = int(np.argmax(s))
    return model["langs"][at], float(p.max() / p.sum()), float(known[at])


def _grouped(texts: Iterable[str | None], most: int = 50_000) -> Iterator[list[list[str]]]:
    """The texts' words, some texts at a time."""
    held, n = [], 0
    for t in texts:
        held.append(words_in(t))
        n += len(held[-1])
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def predict(docs: DataFrame, model: dict, evidence: bool = False) -> DataFrame:
    """All columns of ``docs`` (it needs ``text``) with lang_pred and score;
    with ``evidence`` also ``known``, the share of the text's letters that the
    predicted language is known to use."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)           # bounded by the sample of fit()
    names = ["lang_pred", "score"] + ["known"] * evidence

    @F.pandas_udf("lang_pred string, score double" + ", known double" * evidence)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer = Scorer(m, evidence=evidence) if m["langs"] else None
        for texts in batches:
            out: list[tuple] = []
            for group in _grouped(texts):
                if scorer is not None:
                    # The words of many texts are learnt together.
                    scorer.prepare(islice((w for words in group for w in words), scorer.spare))
                out += [guess(scorer, m, words)[:len(names)] for words in group]
            yield pd.DataFrame(out, columns=names)

    return docs.withColumn("_g", run(F.col("text"))).select(
        *[F.col(f"`{c}`") for c in docs.columns], *[f"_g.{n}" for n in names])


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is found, with their columns; the
    fit takes their own labels.  Rejected are ``und`` and texts of whose
    letters the found language is known to use a share below ``least`` (see
    ``Scorer``): other scripts, languages without labelled rows, gibberish.
    The score does not tell these: it compares the languages known, and over
    many words it nears 1 whatever the text."""
    found = predict(boxed(docs, "text"), fit(docs), evidence=True)
    return unboxed(found.where((F.col("lang_pred") != "und") & (F.col("known") >= least)), docs.columns)


def op6_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs)
    out = predict(only(docs, "doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
