"""Token counts: batches in Arrow functions that return lengths only.

Each task turns its texts into units of work, gathers units until a batch
holds ``batch_bytes`` of them, and encodes a batch at a time; ids are counted
and dropped.  A text longer than ``part_bytes`` becomes several units, cut only
where the vocabulary proves that no token can reach across:

* before a space that follows a character other than a space, if no piece of
  the vocabulary holds a space mark after another character.  The library
  puts one space mark before every text it encodes, so that space is left out
  of the later unit;
* between two characters that stand next to each other in no piece.  There the
  later unit starts with a guard character that is in no piece, and the tokens
  of the added mark and guard are taken off again.

A stretch without such a place (one letter a million times) stays one unit: it
is counted whole, never cut by force.  Both rules hold for byte-pair models
that take the text as it is; texts of other models are encoded uncut.

Edge cases: a null or empty text has no bytes and no tokens; a null doc_id and
repeated rows keep their rows; special strings inside texts are whatever the
library makes of them by default; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import only, ship, table

LIMIT = 4096
MARK = "▁"                    # how the piece vocabulary writes a space
_COUNTED = "doc_id long, n_bytes long, n_tokens long"
_COUNTERS: dict = {}


class JsonCounter:
    """Token numbers by a ``tokenizers`` file; its texts are encoded uncut."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_str(raw.decode("utf-8"))
        self.model.no_truncation()
        self.model.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def units(self, text: str, most: int) -> list[tuple[str, int]]:
        return [(text, 0)]


class PieceCounter:
    """Token numbers by a ``sentencepiece`` model."""

    def __init__(self, raw: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        self.model = SentencePieceProcessor(model_proto=raw)
        spec = sentencepiece_model_pb2.ModelProto.FromString(raw)
        norm, kinds = spec.normalizer_spec, spec.SentencePiece
        own = [p.piece for p in spec.pieces if p.type not in (kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE)]
        self.pairs = {p[i:i + 2] for p in own for i in range(len(p) - 1)}
        letters = set("".join(own))
        plain = (spec.trainer_spec.model_type == spec.trainer_spec.BPE and norm.add_dummy_prefix
                 and norm.escape_whitespaces and not norm.remove_extra_whitespaces
                 and not norm.precompiled_charsmap and not spec.trainer_spec.treat_whitespace_as_suffix
                 and all(p.type != kinds.USER_DEFINED for p in spec.pieces))
        self.at_space = plain and not any(p[1] == MARK and p[0] != MARK for p in self.pairs)
        guard = next((g for g in "\n\0\x01" if g not in letters), None)
        self.guard = guard if plain and spec.trainer_spec.byte_fallback else None
        self.extra = len(self.model.encode(self.guard)) if self.guard else 0

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def _pair_cut(self, text: str, lo: int, hi: int) -> int | None:
        """The last place in ``lo``..``hi`` between two characters that no
        piece holds side by side."""
        for at in range(hi, lo, -1):
            if (text[at - 1] + text[at]).replace(" ", MARK) not in self.pairs:
                return at
        return None

    def units(self, text: str, most: int) -> list[tuple[str, int]]:
        """(unit, tokens to take off): their numbers add up to the text's."""
        out, start, off = [], 0, 0
        while len(text) - start > most and (self.at_space or self.guard):
            found, step = None, most
            while found is None:
                lo, hi = start + step - most, min(start + step, len(text) - 1)
                if self.at_space:
                    # A space, or its mark, after another character and before any.
                    spaces = [m.start() for m in _SPACE.finditer(text, max(lo, start + 1), hi)]
                    found = (spaces[-1], True) if spaces else None
                if found is None and self.guard and (at := self._pair_cut(text, max(lo, start), hi)):
                    found = (at, False)
                if hi >= len(text) - 1:
                    break
                step += most
            if found is None:
                break
            at, space = found
            out.append(((self.guard if off else "") + text[start:at], off))
            start, off = (at + 1, 0) if space else (at, self.extra)
        out.append(((self.guard if off else "") + text[start:], off))
        return out


_SPACE = re.compile(f"(?<![ {MARK}])[ {MARK}](?=.)", re.S)


def counter(path: str, raw: bytes):
    """The counter of a tokenizer file, one per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = JsonCounter(raw) if path.endswith(".json") else PieceCounter(raw)
    return _COUNTERS[path]


def batches_of(units: Iterator[tuple[int, str, int]], most: int) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of units of about ``most`` characters together."""
    held, size = [], 0
    for u in units:
        held.append(u)
        size += len(u[1]) + 16
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def lengths(model, texts: list[str | None], batch_bytes: int, part_bytes: int) -> list[int]:
    """Token numbers of whole texts."""
    total = [0] * len(texts)
    units = ((row, unit, off) for row, text in enumerate(texts) if text for unit, off in model.units(text, part_bytes))
    for batch in batches_of(units, batch_bytes):
        for (row, _, off), n in zip(batch, model.counts([u[1] for u in batch])):
            total[row] += n - off
    return total


def counted(docs: DataFrame, tokenizer: str | None = None, batch_bytes: int = 1 << 20,
            part_bytes: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row; ``tokenizer`` is the path of a
    .json (tokenizers) or .model (sentencepiece) file."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path("piece_bpe_32k.model")
    with open(tokenizer, "rb") as f:
        raw = f.read()                                       # its size is fixed
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(tokenizer, shared.value)
        for b in batches:
            n = lengths(model, b.column(1).to_pylist(), batch_bytes, part_bytes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", size)
    return rows.mapInArrow(run, _COUNTED)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counted(table(spark, sf_dir, "documents"))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)
