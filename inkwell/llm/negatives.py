"""Hard negatives by an inverted multi-index, exact.

Vectors are cut in two halves, each half has a codebook (k-means on a bounded
sample; it decides speed, never rows), and the pair of codes is a vector's
cell.  For an anchor, a code's bound is the inner product with its centroid
plus the anchor half's length times the code's radius, so that the two halves'
bounds add up to at least the score of any vector of the cell.  A search walks
the cells in falling order of that sum with a heap over the two sorted lists of
codes (the multi-sequence walk), scores what is in them, and stops once the
next bound certifies that no cell left can change the answer.

Two searches use it: the first ``positives`` rows of the anchor's label, and
for each of these the first ``negatives`` rows of other labels in the window
that its score sets.

In Spark, cells are dealt to shards of at most about ``shard_rows`` rows (a
cell with more goes to several), a shard is one task's work and holds its
vectors only; anchors stream past them and are never held.  An anchor first
visits its home shard, the one with its best bound, and then only those shards
whose bounds can still beat what it found there.  Answers of shards (a few rows
an anchor each) are merged by rank.  On vectors without clusters few shards can
be ruled out, and the work is that of a blocked scan of all rows by the
anchors; the answer is the same.

Edge cases: rows with a null label, a null vector, a null or non-finite
component, or a null vec_id take no part, nor do vectors of another length
than ``dim`` or with a component beyond 2**27 after scaling (no 64-bit score);
of rows that share a vec_id the one with the smallest label, then vector,
counts; equal scores go to the smaller vec_id; an anchor without other rows of
its label has no rows; windows of negative scores are empty, that of score 0
holds score 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.centroids import LARGEST, matrix
from inkwell.llm.common import cut, only, ship, table

#: Beyond this a sum of products of ``dim`` components is not exact in floats.
FLOAT_EXACT = 2 ** 22
_INDEXED = "vec_id long, label long, v array<long>, c1 int, c2 int, r1 double, r2 double"


@dataclass
class Books:
    """One codebook a half: (codes, half dimension) each."""
    first: np.ndarray
    second: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]


@dataclass
class Needs:
    """How many rows each search returns, and its window in per cent."""
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def prepared(rows: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, label (after the relabelling of every seventh id) and ``v``."""
    x = only(rows, "vec_id", "embedding", "label").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("e"))
    fits = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= LARGEST))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") == dim)
                & F.coalesce(fits, F.lit(False)))
    other = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = x.select("vec_id", other.alias("label"), F.transform("e", lambda c: F.floor(c * scale)).alias("v"))
    one = x.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def codebook(x: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Plain k-means of a sample's halves, started from evenly spaced rows."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    x = x.astype(float)
    c = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = ((c ** 2).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
    return c


def train(vectors: DataFrame, codes: int, sample_rows: int, dim: int) -> Books:
    """Codebooks of at most ``sample_rows`` rows, those first by a hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(sample_rows).select("v").collect()
    x = np.array([r.v for r in rows], np.int64).reshape(len(rows), dim)
    return Books(codebook(x[:, :dim // 2], codes), codebook(x[:, dim // 2:], codes))


def _coded(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = ((book ** 2).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)
    return at.astype(np.int32), np.sqrt(((x - book[at]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-9


def indexed(vectors: DataFrame, books: Books, dim: int) -> DataFrame:
    """Every row with its codes and its halves' distances to them."""
    ship(vectors.sparkSession)
    h = books.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(2), dim).astype(float)
            c1, r1 = _coded(v[:, :h], books.first)
            c2, r2 = _coded(v[:, h:], books.second)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *map(pa.array, (c1, c2, r1, r2))],
                names=["vec_id", "label", "v", "c1", "c2", "r1", "r2"])

    return vectors.mapInArrow(run, _INDEXED)


@dataclass
class Deal:
    """The cells in use (at most codes * codes) and the shards they lie in."""
    cells: np.ndarray            # c1, c2, first shard, shards
    radii: tuple[np.ndarray, np.ndarray]
    shards: int


def dealt(index: DataFrame, books: Books, shard_rows: int, least: int) -> Deal:
    """Shards of whole neighbouring cells; a cell beyond ``shard_rows`` is
    split.  Small tables get shards enough for ``least`` tasks."""
    got = index.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"),
                                        F.max("r2").alias("r2")).collect()       # at most codes * codes rows
    got.sort(key=lambda r: (r.c1, r.c2))
    radii = np.zeros(len(books.first)), np.zeros(len(books.second))
    for r in got:
        radii[0][r.c1], radii[1][r.c2] = max(radii[0][r.c1], r.r1), max(radii[1][r.c2], r.r2)
    size = max(1, min(shard_rows, -(-sum(r.n for r in got) // least)))
    cells, shard, held = [], 0, 0
    for r in got:
        if held and held + r.n > size:
            shard, held = shard + 1, 0
        parts = -(-r.n // size)
        cells.append((r.c1, r.c2, shard, parts))
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + r.n)
    return Deal(np.array(cells, np.int64).reshape(-1, 4), radii, shard + 1)


def walk(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """The multi-sequence walk: pairs of positions in falling order of the sum
    of two falling lists."""
    heap = [(-(first[0] + second[0]), 0, 0)]
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, i, j
        if i + 1 < len(first) and j == 0:
            heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
        if j + 1 < len(second):
            heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))


class Shard:
    """The vectors of one shard, sorted by cell."""

    def __init__(self, ids, labels, v, c1, c2, r1, r2, books: Books):
        order = np.lexsort((ids, c2, c1))
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        big = max(int(np.abs(v).max()), 1) if len(v) else 1
        self.f = self.v.astype(float) if big <= FLOAT_EXACT else None
        c1, c2, r1, r2 = c1[order], c2[order], r1[order], r2[order]
        self.codes1, at1 = np.unique(c1, return_inverse=True)
        self.codes2, at2 = np.unique(c2, return_inverse=True)
        self.mid1, self.mid2 = books.first[self.codes1], books.second[self.codes2]
        self.rad1, self.rad2 = np.zeros(len(self.codes1)), np.zeros(len(self.codes2))
        np.maximum.at(self.rad1, at1, r1)
        np.maximum.at(self.rad2, at2, r2)
        cell = at1 * len(self.codes2) + at2
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        ends = np.append(starts[1:], len(cell))
        self.cells = {int(cell[s]): (int(s), int(e)) for s, e in zip(starts, ends)}

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds of the half scores of anchors by code."""
        h = self.mid1.shape[1]
        a1, a2 = a[:, :h].astype(float), a[:, h:].astype(float)
        n1, n2 = np.sqrt((a1 ** 2).sum(axis=1)), np.sqrt((a2 ** 2).sum(axis=1))
        slack = 1e-6 + 1e-9 * (n1 + n2)[:, None]
        return (a1 @ self.mid1.T + np.outer(n1, self.rad1) + slack,
                a2 @ self.mid2.T + np.outer(n2, self.rad2) + slack)

    def scores(self, rows: np.ndarray, a: np.ndarray) -> np.ndarray:
        if self.f is not None and np.abs(a).max() <= FLOAT_EXACT:
            return (self.f[rows] @ a.astype(float)).astype(np.int64)
        return self.v[rows] @ a

    def visited(self, u1: np.ndarray, u2: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
        """Rows of the cells in falling order of bounds, a growing number of
        cells at a time, each with the bound of all that follow."""
        o1, o2 = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
        steps, most, held = walk(u1[o1], u2[o2]), 1, []
        width = len(self.codes2)
        for bound, i, j in steps:
            if len(held) >= most:
                yield np.concatenate([np.arange(*x) for x in held]), bound
                held, most = [], most * 2
            if (rows := self.cells.get(int(o1[i]) * width + int(o2[j]))) is not None:
                held.append(rows)
        if held:
            yield np.concatenate([np.arange(*x) for x in held]), -np.inf


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` by falling score, then id."""
    if len(ids) > 4 * n:
        cut_at = np.partition(scores, len(scores) - n)[len(scores) - n]
        keep = scores >= cut_at
        ids, scores = ids[keep], scores[keep]
    o = np.lexsort((ids, -scores))[:n]
    return ids[o], scores[o]


def near(shard: Shard, a, anchor: int, label: int, u1, u2, n: int, at_least: float):
    """The first ``n`` other rows of the anchor's label in this shard; those
    that score below ``at_least`` may be missing."""
    ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    floor = at_least
    if u1.max() + u2.max() < floor:
        return ids, scores
    for rows, bound in shard.visited(u1, u2):
        rows = rows[(shard.labels[rows] == label) & (shard.ids[rows] != anchor)]
        if len(rows):
            ids, scores = best(np.concatenate([ids, shard.ids[rows]]),
                               np.concatenate([scores, shard.scores(rows, a)]), n)
        if len(ids) == n:
            floor = max(floor, scores[-1])
        if bound < floor:                            # an equal bound may hide a smaller id
            break
    return ids, scores


def inside(scores: np.ndarray, positive: int, needs: Needs) -> np.ndarray:
    return (100 * scores >= needs.low * positive) & (100 * scores <= needs.high * positive)


def hard(shard: Shard, a, label: int, u1, u2, windows: list[tuple[int, float]], needs: Needs):
    """For each (positive score, score to reach) the first rows of other
    labels in its window; one walk serves all windows."""
    n = needs.negatives
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]
    floors = [max(at_least, needs.low * p / 100 - 1e-6) if p >= 0 else np.inf for p, at_least in windows]
    if not floors or u1.max() + u2.max() < min(floors):
        return found
    for rows, bound in shard.visited(u1, u2):
        rows = rows[shard.labels[rows] != label]
        if len(rows):
            scores, ids = shard.scores(rows, a), shard.ids[rows]
            for w, (p, _) in enumerate(windows):
                fit = inside(scores, p, needs)
                if fit.any():
                    found[w] = best(np.concatenate([found[w][0], ids[fit]]), np.concatenate([found[w][1], scores[fit]]), n)
                    if len(found[w][0]) == n:
                        floors[w] = max(floors[w], found[w][1][-1])
        if bound < min(floors):
            break
    return found


#: What is sent to the shards: their vectors (kind 0), then anchors (kind 1).
_SENT = {"shard": "int", "kind": "int", "id": "long", "label": "long", "v": "array<long>", "c1": "int", "c2": "int",
         "r1": "double", "r2": "double", "home": "int", "reach": "double",
         "wants": "array<struct<positive_id: long, p: long, reach: double>>"}
_FOUND = "anchor_id long, home int, positive_id long, positive_score long, id long, score long"


def _as_sent(df: DataFrame, **values) -> DataFrame:
    """The columns of ``_SENT``; those that ``df`` lacks are null."""
    return df.select(*[(values[c] if c in values else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
                       for c, t in _SENT.items()])


def visits(asks: DataFrame, books: Books, deal: Deal, home: bool, block: int = 1 << 22) -> DataFrame:
    """Anchors with the shards to visit: the one with the best bound (home),
    or all others whose bounds reach the anchor's ``reach``."""
    ship(asks.sparkSession)
    h, cells, shards = books.half, deal.cells, deal.shards

    def tops(a: np.ndarray) -> np.ndarray:
        """The best bound of any cell, by anchor and shard."""
        n1, n2 = np.sqrt((a[:, :h] ** 2).sum(axis=1)), np.sqrt((a[:, h:] ** 2).sum(axis=1))
        u1 = a[:, :h] @ books.first.T + np.outer(n1, deal.radii[0])
        u2 = a[:, h:] @ books.second.T + np.outer(n2, deal.radii[1])
        top = np.full((len(a), shards), -np.inf)
        for c1, c2, first, parts in cells:
            s = slice(first, first + parts)
            top[:, s] = np.maximum(top[:, s], (u1[:, c1] + u2[:, c2])[:, None])
        return top + 1e-6 + 1e-9 * (n1 + n2)[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, block // shards)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                top = tops(matrix(b.column("v"), 2 * h).astype(float))
                if home:
                    rows, to = np.arange(len(top)), top.argmax(axis=1)
                else:
                    reach, seen = b.column("reach").to_numpy()[:, None], b.column("home").to_numpy()[:, None]
                    rows, to = np.nonzero((top >= reach) & (np.arange(shards)[None, :] != seen))
                to = pa.array(to.astype(np.int32))
                out = b.take(pa.array(rows))
                for name in ["shard"] + ["home"] * home:
                    out = out.set_column(out.schema.get_field_index(name), pa.field(name, pa.int32()), to)
                yield out

    return asks.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _SENT.items()))


def searched(index: DataFrame, sent: DataFrame, books: Books, deal: Deal, needs: Needs) -> DataFrame:
    """Anchors against the vectors of the shards they were sent to.  In a task
    the vectors of a shard come first; its anchors stream past.  An anchor
    without wants looks for positives."""
    # One number a shard, and only shards that someone visits are moved.
    asked = F.broadcast(sent.select("shard").distinct())
    both = _as_sent(index.join(asked, "shard", "left_semi"), kind=F.lit(0)).unionByName(sent)
    both = both.repartition(deal.shards, "shard").sortWithinPartitions("shard", "kind")
    dim = 2 * books.half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for b in batches:
            key = b.column("shard").to_numpy() * 2 + b.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                part, (this, kind) = b.slice(lo, hi - lo), divmod(int(key[lo]), 2)
                if this != at:
                    at, parts, shard = this, [], None
                if kind == 0:
                    parts.append((part.column("id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("v"), dim),
                                  *[part.column(c).to_numpy() for c in ("c1", "c2", "r1", "r2")]))
                    continue
                if shard is None:
                    shard, parts = Shard(*[np.concatenate(x) for x in zip(*parts)], books), []
                yield _answers(shard, part, needs)

    return both.mapInArrow(run, _FOUND)


def _answers(shard: Shard, asks: pa.RecordBatch, needs: Needs) -> pa.RecordBatch:
    a = matrix(asks.column("v"), shard.v.shape[1])
    u1, u2 = shard.bounds(a)
    wants = asks.column("wants").to_pylist()
    out: list[tuple] = []
    for i, (anchor, label, home, reach) in enumerate(zip(*[asks.column(c).to_pylist() for c in ("id", "label", "home", "reach")])):
        if wants[i] is None:
            ids, scores = near(shard, a[i], anchor, label, u1[i], u2[i], needs.positives, reach)
            out += [(anchor, home, None, None, x, s) for x, s in zip(ids.tolist(), scores.tolist())]
        else:
            windows = [(w["p"], w["reach"]) for w in wants[i]]
            for w, (ids, scores) in zip(wants[i], hard(shard, a[i], label, u1[i], u2[i], windows, needs)):
                out += [(anchor, home, w["positive_id"], w["p"], x, s) for x, s in zip(ids.tolist(), scores.tolist())]
    names = ["anchor_id", "home", "positive_id", "positive_score", "id", "score"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "home" else pa.int64())
                                       for n, c in zip(names, zip(*out) if out else [[]] * len(names))], names=names)


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` answers by key (a few rows a shard visited)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def _both(index, asks, books, deal, needs, keys, n, reach) -> DataFrame:
    """Home shards first, then the shards that can still matter; ``reach``
    raises what an anchor asks for by what it found at home."""
    homes = cut(visits(_as_sent(asks, kind=F.lit(1)), books, deal, True), "homes")
    at_home = cut(searched(index, homes, books, deal, needs), "at-home")
    further = cut(visits(_as_sent(reach(homes, at_home)), books, deal, False), "visits")
    away = searched(index, further, books, deal, needs)
    return cut(_first(at_home.unionByName(away), keys, n), "found")


def mined(rows: DataFrame, every: int = 50, needs: Needs | None = None, codes: int = 32, sample_rows: int = 8192,
          shard_rows: int = 1 << 17, dim: int = 64, scale: int = 256) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by ``every``."""
    needs = needs or Needs()
    spark = rows.sparkSession
    vectors = cut(prepared(rows, dim, scale), "vectors")
    books = train(vectors, codes, sample_rows, dim)
    index = cut(indexed(vectors, books, dim), "index")
    deal = dealt(index, books, shard_rows, least=2 * spark.sparkContext.defaultParallelism)
    cells = spark.createDataFrame([tuple(map(int, c)) for c in deal.cells] or [(0, 0, 0, 1)],
                                  "c1 int, c2 int, _first int, _parts int")     # at most codes * codes rows
    index = index.withColumnRenamed("vec_id", "id").join(F.broadcast(cells), ["c1", "c2"]).withColumn(
        "shard", F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts").cast("long")).cast("int"))
    anchors = vectors.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "id")
    lowest = F.lit(float("-inf"))

    def near_reach(homes, at_home):
        least = _first(at_home, ["anchor_id"], needs.positives).groupBy("anchor_id").agg(
            F.when(F.count("*") == needs.positives, F.min("score").cast("double")).alias("_r"))
        return homes.join(least.withColumnRenamed("anchor_id", "id"), "id", "left").withColumn(
            "reach", F.coalesce("_r", lowest))

    positives = _both(index, anchors.withColumn("reach", lowest), books, deal, needs, ["anchor_id"],
                      needs.positives, near_reach)

    # The window of a negative score is empty, so such positives ask nothing.
    asked = positives.where("score >= 0").groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(
        F.struct(F.col("id").alias("positive_id"), F.col("score").alias("p"), lowest.alias("reach")))).alias("wants"))

    def hard_reach(homes, at_home):
        least = _first(at_home, ["anchor_id", "positive_id"], needs.negatives).groupBy("anchor_id", "positive_id").agg(
            F.when(F.count("*") == needs.negatives, F.min("score").cast("double")).alias("_r"))
        got = least.where("_r is not null").groupBy(F.col("anchor_id").alias("id")).agg(
            F.map_from_entries(F.collect_list(F.struct("positive_id", "_r"))).alias("_m"))      # a few positives each
        x = homes.join(got, "id", "left").withColumn("wants", F.transform("wants", lambda w: F.struct(
            w["positive_id"].alias("positive_id"), w["p"].alias("p"),
            F.coalesce(F.try_element_at("_m", w["positive_id"]), lowest).alias("reach"))))
        low = lambda p: F.lit(needs.low / 100) * p - F.lit(1e-6)
        return x.withColumn("reach", F.array_min(F.transform("wants", lambda w: F.greatest(w["reach"], low(w["p"])))))

    found = _both(index, anchors.join(asked, "id").withColumn("reach", lowest), books, deal, needs,
                  ["anchor_id", "positive_id"], needs.negatives, hard_reach)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                        F.col("score").alias("negative_score"))


def op12_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH x AS (SELECT vec_id, l AS label, list_transform(e, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM (
  SELECT vec_id, embedding AS e, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
  list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS score
  FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY score DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns,
             ROW_NUMBER() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, CAST(r AS INTEGER) AS rank, n AS negative_id,
       CAST(ps AS BIGINT) AS positive_score, CAST(ns AS BIGINT) AS negative_score FROM n WHERE r <= 3"""
