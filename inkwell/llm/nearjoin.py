"""N-gram Jaccard join by a forest of MinHash prefix tries, with exact checks.

Texts with the same set of five-word shingles are one class.  Each class has
``TREES`` signatures of MinHash values, read as paths of prefix tries.  Two
sets of similarity s share a prefix of length d in a tree with probability
``s ** d``; starting from ``LONGEST``, the prefix is shortened until a pair at
the threshold meets in some tree with the target recall (what matches a longer
prefix also matches the shorter one, so one grouping at that length serves
all lengths above it).  Classes that meet, directly or through others, form a
candidate component, found on slim rows.

Every pair of classes inside a candidate component is then verified exactly
on the shingle sets.  A component is cut into blocks by a hash and by volume;
each pair of blocks is a unit of work of bounded size, so a component of any
size is spread over many tasks.  A unit counts the links of its members and
gives a spanning forest of them, never the pairs: the links of a class are the
sum over its units, the groups are the components of the forests.

Edge cases: null and empty texts and texts without words have no shingles,
are never linked, and each such row is its own group; a text of one to four
words has one shingle; copies and repeated rows are one class (each row is
returned and counts as a link of the others); groups are named by their
smallest doc_id (null if all are null); extra columns are ignored by ``join``
and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import (
    boxed, cut, mix64, only, shingles, ship, table, unboxed, words_of)

TREES = 24
LONGEST = 8
THRESHOLD = 0.8
RECALL = 0.9999
BLOCK_CLASSES = 2048            # members of a block, on average
BLOCK_SHINGLES = 1_500_000      # shingles of a block, on average


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL,
                  longest: int = LONGEST) -> int:
    """The longest prefix at which a pair at the threshold is met with the
    target recall; 1 if none is short enough."""
    for d in range(longest, 1, -1):
        if 1 - (1 - threshold ** d) ** trees >= recall:
            return d
    return 1


def _factors(n: int) -> np.ndarray:
    return mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefixes(hashes: np.ndarray, trees: int, depth: int, factors: np.ndarray) -> np.ndarray:
    """One 64-bit hash a tree of its first ``depth`` MinHash values."""
    n = trees * depth
    a, b = factors[:n, None] | np.uint64(1), factors[n:2 * n, None]
    least = np.full(n, np.uint64(2 ** 64 - 1))
    for at in range(0, len(hashes), 8192):
        least = np.minimum(least, (hashes[at:at + 8192] * a + b).min(axis=1))
    path = np.arange(trees, dtype=np.uint64)
    for k in range(depth):
        path = mix64(path * np.uint64(31) + least.reshape(trees, depth)[:, k])
    return path.view(np.int64)


def _set_key(hashes: np.ndarray) -> str:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def _row_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes that name the row by its id and text."""
    return only(docs, "doc_id", "text").withColumn("tk", F.xxhash64("text")).withColumn(
        "rk", F.xxhash64("doc_id", F.lit(1), "text"))


def signatures(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, rk, tk, key (of the shingle set; null if empty), n, paths."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = _factors(TREES * depth)
        for b in batches:
            keys, sizes, paths = [], [], []
            for text in b["text"]:
                h = shingles(words_of(text))
                keys.append(_set_key(h) if len(h) else None)
                sizes.append(len(h))
                paths.append(prefixes(h, TREES, depth, factors) if len(h) else np.empty(0, np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "rk": b["rk"], "tk": b["tk"],
                                "key": keys, "n": sizes, "paths": paths})

    return _row_keys(docs).mapInPandas(run, "doc_id long, rk long, tk long, key string, n long, paths array<long>")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of an undirected graph of edges (a, b): the smallest node
    of each component, by smallest neighbours and pointer jumping.  Each round
    is written and compared with the one before."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
               .where("a <> b").distinct(), f"{name}-edges")
    root = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), name)
    while True:
        by = root.select(F.col("node").alias("b"), F.col("root").alias("r"))
        near = both.join(by, "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        step = root.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root", "left").select(
            "node", F.least("root", F.coalesce("far", "root")).alias("root"), "old"), name)
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        root = new.select("node", "root")


def candidates(classes: DataFrame) -> DataFrame:
    """(key, comp) of the classes that meet another one in some tree."""
    met = classes.select("key", F.explode("paths").alias("path"))
    first = met.groupBy("path").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z")
    edges = met.join(first.select("path", "a"), "path").select("a", F.col("key").alias("b")).distinct()
    return components(edges, "meet").select(F.col("node").alias("key"), F.col("root").alias("comp"))


def _verified(keys: list[str], docs: np.ndarray, sets: list[np.ndarray], side: np.ndarray, pair: tuple[int, int],
              threshold: float) -> list[tuple]:
    """(key, linked documents, root key) of the members of one unit of work.
    ``side``: the block of each member; in a unit of two blocks only pairs
    across them count, the pairs inside are another unit's."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, gram, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[gram] > 1                               # the rest is in no intersection
    owner, gram = owner[shared], gram[shared]
    names, gram = np.unique(gram, return_inverse=True)
    left = np.flatnonzero(side == pair[0])
    right = left if pair[0] == pair[1] else np.flatnonzero(side == pair[1])
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(gram, kind="stable")
    owner, gram = owner[order], gram[order]
    for at in range(0, len(names), 2048):                  # bounded slices of the vocabulary
        a, z = np.searchsorted(gram, (at, at + 2048))
        m = np.zeros((len(sets), min(2048, len(names) - at)), np.float32)
        m[owner[a:z], gram[a:z] - at] = 1
        both += m[left] @ m[right].T
    union = size[left][:, None] + size[right][None, :] - both
    linked = both >= threshold * union - 1e-9
    if right is left:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(sets), np.int64)
    links[left] += linked @ docs[right]
    if right is not left:
        links[right] += linked.T @ docs[left]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, row in zip(left, linked):
        to = find(i)
        for j in right[row]:
            if (r := find(j)) != to:
                to, r = min(to, r), max(to, r)
                root[r] = to
    return [(k, int(n), keys[find(i)]) for i, (k, n) in enumerate(zip(keys, links)) if n]


def verify(docs: DataFrame, members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n, root): linked documents and a spanning forest, from all units.
    ``members``: key, comp, copies, n, rk, tk (a row with that set)."""
    volume = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("v")).select("comp", F.greatest(
        F.ceil(F.col("m") / BLOCK_CLASSES), F.ceil(F.col("v") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(volume, "comp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [shingles(words_of(t)) for t in b["text"]]
            out = b.drop(columns="text").assign(set=[x.tobytes() for x in h])
            yield out[[_set_key(x) == k for x, k in zip(h, b["key"])]]

    rows = _row_keys(docs).select("rk", "tk", "text").join(members.drop("n"), ["rk", "tk"]).select(
        "comp", "blocks", "block", "key", "copies", "text").mapInPandas(
        sets, "comp string, blocks int, block int, key string, copies long, set binary")
    units = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "copies", "set")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, members_ = None, {}

        def done() -> pd.DataFrame:
            found = []
            if len(members_) > 1:
                keys = sorted(members_)
                found = _verified(keys, np.array([members_[k][1] for k in keys]),
                                  [np.frombuffer(members_[k][2], np.uint64) for k in keys],
                                  np.array([members_[k][0] for k in keys]), unit[1:], threshold)
            return pd.DataFrame(found, columns=["key", "n", "root"])

        for b in batches:
            out = []
            for comp, i, j, block, key, copies, data in zip(*[b[c] for c in (
                    "comp", "i", "j", "block", "key", "copies", "set")]):
                if (comp, i, j) != unit:
                    out.append(done())
                    unit, members_ = (comp, i, j), {}
                members_[key] = (block, copies, data)      # repeated rows of one class count once
            yield pd.concat(out) if out else pd.DataFrame([], columns=["key", "n", "root"])
        yield done()

    return (units.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
            .mapInPandas(run, "key string, n long, root string"))


def _solve(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Signature rows of all documents; (key, copies, first, links, group) of
    the classes, ``first`` the smallest (doc_id, rk, tk)."""
    rows = cut(signatures(docs, prefix_length(threshold)), "signatures")
    classes = cut(rows.where("key is not null").groupBy("key").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk", "tk")).alias("first"),
        F.first("n").alias("n"), F.first("paths").alias("paths")), "classes")
    comps = candidates(classes.select("key", "paths"))
    members = classes.join(comps, "key").select("key", "comp", "copies", "n", "first.rk", "first.tk")
    found = cut(verify(docs, members, threshold), "links")
    group = components(found.select(F.col("root").alias("a"), F.col("key").alias("b")), "groups").select(
        F.col("node").alias("key"), F.col("root").alias("group"))
    links = found.groupBy("key").agg(F.sum("n").alias("links"))
    return rows, classes.drop("paths", "n").join(links, "key", "left").join(group, "key", "left").select(
        "key", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "key").alias("group"))


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the group), set_id (smallest
    doc_id with the same shingle set), n_links (other documents at or above
    the threshold), n_shingles: one row per row of ``docs``."""
    rows, classes = _solve(docs, threshold)
    named = classes.groupBy("group").agg(F.min("first").alias("g"))
    classes = classes.join(named, "group").select(
        "key", F.col("first.doc_id").alias("set_id"), F.col("g.doc_id").alias("class_id"),
        (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.select("doc_id", "key", "n").join(classes, "key", "left")
    alone = F.col("key").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, of each group only the one with the smallest
    doc_id; rows without shingles all stay."""
    rows, classes = _solve(docs, threshold)
    chosen = classes.groupBy("group").agg(F.min("first").alias("g")).select("g.rk", "g.tk")
    own = boxed(docs, "doc_id", "text").select("row", F.xxhash64("text").alias("tk"),
                                               F.xxhash64("doc_id", F.lit(1), "text").alias("rk"))
    # Rows that repeat id and text: the one whose other columns hash lowest.
    kept = own.join(chosen, ["rk", "tk"], "left_semi").groupBy("rk", "tk").agg(
        F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    bare = rows.where("key is null").select("rk", "tk").distinct()
    return unboxed(kept.unionByName(own.join(bare, ["rk", "tk"], "left_semi").select("row")), docs.columns)


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
