"""Best-fit packing by minimum bin slack.

Texts are tokenized in tasks; only the histogram of piece lengths (at most
``size`` numbers) reaches the driver.  There, one bin after another: the
longest length left opens the bin, a bitset subset-sum over the lengths left
finds the fullest combination that still fits, and the combination is removed
as often as the counts allow.  The plan (length, first rank, copies, first
sequence, offset) is bounded by ``size``, not by the corpus; each piece finds
its place by its rank among the pieces of its length.

Edge cases: a null or empty text is the end token alone; texts longer than
``size`` are cut so that only the first piece is shorter; rows that repeat a
doc_id are packed one by one; an empty table gives no rows; extra columns are
ignored.  The string of an added token of the file is that token wherever it
stands in a text, as the file's own library has it by default.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, only, ship, table
from inkwell.operators.ordering import rank_within

SIZE = 1024
END = 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict = {}


def vocabulary(path: str) -> bytes:
    """The tokenizer file, read once on the driver (its size is fixed)."""
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Byte-level BPE of a tokenizer file: the added tokens are found first,
    what lies between them is encoded by token bytes and ranks (the ids of such
    a file follow the merge order)."""

    def __init__(self, raw: bytes):
        import public_tokenizers
        import tiktoken

        spec = json.loads(raw)
        # Byte-level files write each byte as a printable character: the
        # printable Latin-1 ones as themselves, the rest from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain}
        byte.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)})
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.ranks = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        # Longer tokens first; their flags say what they need or take around
        # them.  Marks that combine with a letter belong to its word.
        ways, w = [], r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\u200c\u200d]"
        for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])):
            if t["content"]:
                word = regex.escape(t["content"])
                word = f"(?<!{w}){word}(?!{w})" if t["single_word"] else word
                ways.append(r"\s*" * t["lstrip"] + word + r"\s*" * t["rstrip"])
        self.finder = regex.compile("(" + "|".join(ways) + ")") if ways else None

    def ids(self, text: str) -> np.ndarray:
        if self.finder is None or not any(t in text for t in self.added):
            return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        parts = []
        for i, part in enumerate(self.finder.split(text)):
            if i % 2:
                name = part if part in self.added else part.strip()
                parts.append(np.array([self.added[name]], "<u4"))
            elif part:
                parts.append(self.ranks.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False))
        return np.concatenate(parts)


def encoder(raw: bytes) -> Encoder:
    """One per worker process and tokenizer file."""
    key = zlib.crc32(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def token_ids(enc: Encoder, text: str | None, end: int = END) -> np.ndarray:
    """Ids of one text and the end token, as little-endian 32-bit numbers."""
    return np.append(enc.ids(text) if text else np.empty(0, "<u4"), np.uint32(end)).astype("<u4", copy=False)


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: the first may be shorter."""
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, raw: bytes, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(shared.value)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ids = token_ids(enc, text, end)
                doc = None if pd.isna(doc) else int(doc)
                rows += [(doc, i, s, n, zlib.crc32(ids[s:s + n].tobytes()))
                         for i, (s, n) in enumerate(cut_points(len(ids), size))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return only(docs, "doc_id", "text").mapInPandas(run, _PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths (and how often each) whose sum is the largest not above
    ``room``: bit s of ``reach`` says that sum s can be made."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most = min(counts[length], room // length)
        before, step = reach, 1
        while most > 0:                       # binary split of the copies
            take = min(step, most)
            reach |= (reach << (take * length)) & mask
            most -= take
            step *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> left & 1:
            used[length] = used.get(length, 0) + 1
            left -= length
    return used


def plan_bins(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies, first sequence, offset) for all pieces."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    used = dict.fromkeys(counts, 0)
    entries, sequence = [], 0
    while counts:
        top = max(counts)
        counts[top] -= 1
        if not counts[top]:
            del counts[top]
        combo = fullest(counts, size - top)
        counts[top] = counts.get(top, 0) + 1
        combo[top] = combo.get(top, 0) + 1
        copies = min(counts[k] // m for k, m in combo.items())
        offset = 0
        for length in sorted(combo, reverse=True):
            for _ in range(combo[length]):
                entries.append((length, used[length], copies, sequence, offset))
                used[length] += copies
                offset += length
            counts[length] -= copies * combo[length]
            if not counts[length]:
                del counts[length]
        sequence += copies
    return entries


def pack(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1..size."""
    spark = parts.sparkSession
    parts = cut(parts, "pieces")
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}   # <= size rows
    entries = plan_bins(histogram, size)
    plan = spark.createDataFrame(entries or [(0, 0, 0, 0, 0)],
                                 "_len long, _lo long, _copies long, _seq long, offset long")
    order = [c for c in parts.columns if c != "length"]
    ranked = rank_within(parts, ["length"], order, "_rank").withColumn("_rank", F.col("_rank") - 1)
    # The plan has at most a few entries per length, whatever the corpus.
    hit = ((F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo"))
           & (F.col("_rank") < F.col("_lo") + F.col("_copies")))
    return ranked.join(F.broadcast(plan), hit).select(
        *parts.columns, (F.col("_seq") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``tokenizer``: path of the byte-level BPE file."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(pieces(docs, vocabulary(tokenizer)))


def op10_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
