"""Removal of long byte strings that occur more than once in a corpus.

A byte goes if it is covered by a string of ``SPAN`` bytes that also starts
anywhere else, in the same text or another one.

1. Anchors.  Every span has an anchor, the smallest hash among its ``GRAM``-byte
   grams.  Equal spans have equal anchors at equal places.  A text is cut into
   segments, runs of consecutive spans with one anchor; a segment is known by
   its anchor's hash and a 128-bit hash of its bytes, so only slim rows move.
2. Anchors seen once drop out.  Segments seen more than once are repeated as a
   whole.  Segments whose anchor also occurs in *other* segments are fetched,
   one copy each, and grouped by anchor.
3. In each group a suffix array finds the equal stretches.  The segments are
   written as blocks of ``BLOCK`` bytes counted from the anchor, and the suffixes
   are sorted by grouping, without recursion or renaming: groups of equal Lyndon
   prefix are processed in descending order, previous-smaller pointers tell
   which suffixes the group extends, and a second pass emits the order inside
   each group from the suffixes behind it.  Neighbours that share all the
   blocks of a span are then compared byte by byte for each start in a block.
4. An anchor with more than ``GROUP`` different segments is not gathered: its
   spans are counted one by one by hash, with partial sums.

Edge cases: a null text is empty; texts shorter than a span lose nothing;
repeated rows are occurrences of their own; spans never cross texts; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import cut, mix64, only, ship, small, table

SPAN = 400
GRAM = 64
BLOCK = 8
GROUP = 4096                    # different segments of an anchor sorted in one task
BROADCAST_ROWS = 500_000        # counted rows; their bytes are counted too
CHUNK = 1 << 21                 # bytes of a text handled at once
_SEGMENTS = "key long, s1 long, s2 long, id long, ta long, loc long"


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` bytes, by doubling: size is a power of 2."""
    h, have = mix64(b.astype(np.uint64) + np.uint64(1)), 1
    while have < size:
        h = mix64(h[:-have] * np.uint64(37) + h[have:])
        have *= 2
    return h


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by prefix and suffix minima of
    blocks of that width."""
    x = np.concatenate([v, np.full(-len(v) % width, np.uint64(2 ** 64 - 1))]).reshape(-1, width)
    before = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(v) - width + 1
    return np.minimum(behind[:n], before[width - 1:width - 1 + n])


def segments(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, start, spans, anchor offset) of the runs of spans."""
    low = np.uint64((1 << 22) - 1)
    for base in range(0, max(1, len(data) - SPAN + 1), CHUNK):
        b = np.frombuffer(data[base:base + CHUNK + SPAN - 1], np.uint8)
        if len(b) < SPAN:
            return
        h = gram_hashes(b, GRAM)
        tagged = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(tagged, SPAN - GRAM + 1) & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        spans = np.diff(np.append(first, len(place)))
        yield from zip(h[place[first]].view(np.int64).tolist(), (first + base).tolist(), spans.tolist(),
                       (place[first] - first).tolist())


def suffix_array(t: list[int]) -> list[int]:
    """Starts of all suffixes of ``t`` in ascending order (a suffix that ends
    is smaller than its continuations)."""
    n = len(t)
    a = sorted(range(n), key=t.__getitem__)
    at, group, stop, prev = [0] * n, [0] * n, [0] * (n + 1), [-1] * n
    start = 0
    for k, i in enumerate(a):                              # groups by the first symbol
        if k and t[i] != t[a[k - 1]]:
            stop[start], start = k, k
        at[i], group[i] = k, start
    stop[start] = n
    high = n
    while high:                                            # groups in descending order
        g = group[a[high - 1]]
        times: dict[int, int] = {}
        for i in sorted(a[g:high]) if high - g > 1 else a[g:high]:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        high = g
        if not times:
            continue
        levels: dict[int, list[int]] = {}
        for p, m in times.items():
            levels.setdefault(m, []).append(p)
        for m in sorted(levels, reverse=True):             # more repeats sort higher
            old: dict[int, int] = {}
            for p in levels[m]:                            # to the end of its group ...
                own = group[p]
                old.setdefault(own, stop[own])
                e = stop[own] = stop[own] - 1
                q, k = a[e], at[p]
                a[e], a[k], at[p], at[q] = p, q, e, k
            for own, e in old.items():                     # ... which becomes a group
                new = stop[own]
                stop[new] = e
                for k in range(new, e):
                    group[a[k]] = new
    fill, out = list(range(n)), [0] * n
    p = n - 1
    while p >= 0:                                          # followed by the end of the text
        g = group[p]
        out[fill[g]] = p
        fill[g] += 1
        p = prev[p]
    for k in range(n):
        s = out[k]
        p, until = s - 1, prev[s]
        while p != until:
            g = group[p]
            out[fill[g]] = p
            fill[g] += 1
            p = prev[p]
    return out


def repeated_spans(group: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """For each (anchor offset, segment): which of its spans occur in another
    one too.  All segments share one anchor and differ from each other."""
    flags = [np.zeros(len(s) - SPAN + 1, bool) for _, s in group]
    blocks: dict[bytes, int] = {}
    symbols: list = []
    places: list = []                                      # (segment, byte) of each symbol
    for k, (offset, s) in enumerate(group):
        for q in range(offset % BLOCK, len(s) - BLOCK + 1, BLOCK):
            symbols.append(s[q:q + BLOCK])
            places.append((k, q))
        symbols.append(b"")                                # ends the segment
        places.append(None)
    for r, x in enumerate(sorted(set(symbols))):
        blocks[x] = r
    need = (SPAN - BLOCK + 1) // BLOCK * BLOCK             # whole blocks of a span at any start
    order = [places[i] for i in suffix_array([blocks[x] for x in symbols])]
    order = [(k, q) for k, q in filter(None, order) if q + need <= len(group[k][1])]
    i = 0
    while i < len(order):
        k, q = order[i]
        head = group[k][1][q:q + need]
        j = i + 1
        while j < len(order) and group[order[j][0]][1].startswith(head, order[j][1]):
            j += 1
        if j - i > 1:
            for lead in range(BLOCK):                      # spans that start before the block
                seen: dict[bytes, tuple] = {}
                for k, q in order[i:j]:
                    p = q - lead
                    if p >= 0 and p + SPAN <= len(group[k][1]):
                        first = seen.setdefault(group[k][1][p:p + SPAN], (k, p))
                        if first != (k, p):
                            flags[first[0]][first[1]] = flags[k][p] = True
        i = j
    return flags


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _rows(docs: DataFrame) -> DataFrame:
    """id, ta (hash of the text): a text that repeats with its id is one
    text for the result but two occurrences."""
    return only(docs, "doc_id", "text").withColumn("ta", F.xxhash64("text"))


def _cut_segments(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "s1", "s2", "id", "ta", "loc"]
        for b in batches:
            rows = []
            for doc, text, ta in zip(b["doc_id"], b["text"], b["ta"]):
                data = text.encode() if text else b""
                doc = None if pd.isna(doc) else int(doc)
                for key, start, spans, offset in segments(data):
                    s = xxhash.xxh3_128_digest(data[start:start + spans + SPAN - 1])
                    rows.append((key, int.from_bytes(s[:8], "big", signed=True),
                                 int.from_bytes(s[8:], "big", signed=True), doc, ta,
                                 (start << 18) | (spans << 9) | offset))
                if len(rows) > 100_000:
                    yield pd.DataFrame(rows, columns=names).astype({"id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=names).astype({"id": "Int64"})

    return _rows(docs).mapInPandas(run, _SEGMENTS)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, s1, s2, offset, bytes of the wanted segments (one copy each)."""
    lists = cut(wanted.groupBy("id", "ta").agg(F.collect_list(F.struct("key", "s1", "s2", "loc")).alias("list")), "wanted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, ask in zip(b["text"], b["list"]):
                data = text.encode()
                for x in ask:
                    start, spans, offset = x["loc"] >> 18, x["loc"] >> 9 & 511, x["loc"] & 511
                    rows.append((x["key"], x["s1"], x["s2"], offset, data[start:start + spans + SPAN - 1]))
            yield pd.DataFrame(rows, columns=["key", "s1", "s2", "offset", "bytes"])

    d = _rows(docs)
    hit = d.join(small(lists.withColumnRenamed("ta", "_ta"), BROADCAST_ROWS), d["doc_id"].eqNullSafe(F.col("id")) & (d["ta"] == F.col("_ta")))
    got = hit.select("text", "list").mapInPandas(run, "key long, s1 long, s2 long, offset int, bytes binary")
    return got


def _sorted_groups(rows: DataFrame) -> DataFrame:
    """key, s1, s2, from, to: runs of repeated spans, a suffix array a key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group = None, {}
        names = ["key", "s1", "s2", "from", "to"]

        def done() -> list[tuple]:
            if len(group) < 2:
                return []
            flags = repeated_spans(list(group.values()))
            return [(key, *s, *r) for s, f in zip(group, flags) for r in _runs(f)]

        for b in batches:
            out = []
            for k, s1, s2, offset, data in zip(b["key"], b["s1"], b["s2"], b["offset"], b["bytes"]):
                if k != key:
                    out += done()
                    key, group = k, {}
                group[s1, s2] = (offset, data)             # repeated rows give one copy
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(done(), columns=names)

    return (rows.repartition("key").sortWithinPartitions("key")
            .mapInPandas(run, "key long, s1 long, s2 long, from int, to int"))


def _counted_groups(rows: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: spans counted by hash."""
    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, s1, s2, data in zip(b["key"], b["s1"], b["s2"], b["bytes"]):
                n = len(data) - SPAN + 1
                yield pd.DataFrame({"key": key, "s1": s1, "s2": s2, "from": range(n), "h": [
                    xxhash.xxh3_128_digest(data[i:i + SPAN]) for i in range(n)]})

    each = cut(rows.dropDuplicates(["key", "s1", "s2"]).select("key", "s1", "s2", "bytes").mapInPandas(
        spans, "key long, s1 long, s2 long, from int, h binary"), "spans")
    often = each.groupBy("h").count().where("count > 1").select("h")
    return each.join(often, "h", "left_semi").select("key", "s1", "s2", "from", (F.col("from") + 1).alias("to"))


def covered(docs: DataFrame) -> DataFrame:
    """id, ta, spots: arrays of (from, to) byte ranges to remove, by text."""
    ship(docs.sparkSession)
    every = cut(_cut_segments(docs), "segments")
    keys = (every.groupBy("key").agg(F.count("*").alias("n"), (F.min("s1") != F.max("s1")).alias("mixed"))
            .where("n > 1").select("key", "mixed"))
    met = cut(every.join(small(cut(keys, "keys"), BROADCAST_ROWS), "key"), "met")
    found = cut(met.groupBy("key", "s1", "s2").agg(
        F.count("*").alias("n"), F.max("mixed").alias("mixed"),
        F.min(F.struct(F.col("id").isNull(), "id", "ta", "loc")).alias("one")), "distinct")
    mixed = found.where("mixed").select("key", "s1", "s2", "one.id", "one.ta", "one.loc")
    rows = cut(_fetch(docs, mixed), "bytes")
    many = rows.groupBy("key").count().where(F.col("count") > GROUP).select("key")
    many = small(cut(many, "many"), BROADCAST_ROWS)
    part = _sorted_groups(rows.join(many, "key", "left_anti")).unionByName(
        _counted_groups(rows.join(many, "key", "left_semi")))
    whole = found.where("n > 1").select("key", "s1", "s2", F.lit(0).alias("from"), F.lit(512).alias("to"))
    flagged = cut(part.unionByName(whole).groupBy("key", "s1", "s2").agg(
        F.collect_set(F.struct("from", "to")).alias("runs")), "flagged")
    start, spans = F.shiftright("loc", 18), F.shiftright("loc", 9).bitwiseAND(F.lit(511).cast("bigint"))
    spots = met.join(flagged, ["key", "s1", "s2"]).select("id", "ta", F.explode("runs").alias("r"), "loc").select(
        "id", "ta", F.struct((start + F.col("r.from")).alias("from"),
                             (start + F.least(F.col("r.to").cast("bigint"), spans) + SPAN - 1).alias("to")).alias("spot"))
    return cut(spots.groupBy("id", "ta").agg(F.collect_set("spot").alias("spots")), "spots")


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    spots = covered(docs).withColumnRenamed("ta", "_ta")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, ask in zip(b["doc_id"], b["text"], b["spots"]):
                data = text.encode() if text else b""
                kept, at, removed, n = [], 0, 0, 0
                for start, stop in sorted((x["from"], x["to"]) for x in ask) if ask is not None else ():
                    if start > at or not n:                # touching runs are one
                        kept.append(data[at:start])
                        n += 1
                        at = max(at, start)
                    if stop > at:
                        removed += stop - at
                        at = stop
                kept.append(data[at:])
                rows.append((None if pd.isna(doc) else int(doc), len(data), removed, n, b"".join(kept)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})

    d = _rows(docs)
    # Id and hash name the text; a null id is compared as null.
    same = d["doc_id"].eqNullSafe(spots["id"]) & d["ta"].eqNullSafe(spots["_ta"])
    return d.join(spots, same, "left").select("doc_id", "text", "spots").mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_lyndon_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
