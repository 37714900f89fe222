"""Centroid clustering with bounds that loosen by geometry, not by drift.

Every vector keeps its cluster, an upper bound of the distance to that
centroid and a lower bound of the distance to any other one.  When centroids
move, a vector whose upper bound stays below its lower bound keeps its cluster
unseen; only the ambiguous ones are scanned, exactly, in whole numbers.

Full drift would lower the lower bound by the longest way any other centroid
moved.  Here each cluster is a sphere (its old centroid, the largest upper
bound of its vectors), and for each other centroid that moves from m to m' the
plane through m, m' and the sphere's centre gives less: |x - m| - |x - m'| is
constant on hyperbolas with foci m and m', whose asymptotes leave the midpoint
at the angle a to the way moved when the constant is |m - m'| cos a.  Points
that the midpoint sees at a wider angle than a have gained less, so the
smallest angle at which the sphere is seen bounds the gain of all its vectors
(nothing beyond a right angle; the full drift if the sphere holds the midpoint).

A round is one pass over the vectors: each task writes its vectors with their
new cluster and bounds, and with them its sums by cluster (a row per cluster
and task).  These are added up by Spark; ``k`` rows reach the driver.  Folders
of past rounds are removed once the next round is written.

Edge cases: rows with a null vector, another number of components than
``dim``, or a null or non-finite component are left out, as are those with a
component beyond 2**27 after scaling (their squared distances do not fit in 64
bits); a null vec_id is clustered but starts no centroid; rows that repeat a
vec_id are vectors of their own; with fewer vectors than ``k`` there are fewer
centroids; equal starting centroids stay, the smaller number wins ties; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import only, remove, scratch_path, ship, table

LARGEST = 2.0 ** 27
#: Float bounds are widened by this share, exact distances are whole numbers.
SLACK = 1e-9
_STATE = ("kind int, vec_id long, v array<long>, cluster int, distance long, upper double, lower double, "
          "n long, scanned long")


def whole_vectors(rows: DataFrame, dim: int = 64, scale: int = 64, col: str = "embedding") -> DataFrame:
    """vec_id and ``v``: floor(scale * component) of the vectors that take
    part.  Computed in the JVM, the scan reads two columns."""
    x = only(rows, "vec_id", col).select(F.col("vec_id").cast("long").alias("vec_id"),
                                         F.col(f"`{col}`").cast("array<double>").alias("e"))
    fits = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) <= LARGEST))
    x = x.where((F.size("e") == dim) & F.coalesce(fits, F.lit(False)))
    return x.select("vec_id", F.transform("e", lambda c: F.floor(c * scale)).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dim)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows (or to one row)."""
    d = v - c
    return np.einsum("ij,ij->i", d, d)


def scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), its squared distance and
    the second smallest one."""
    best = squared(v, centroids[0])
    second = np.full(len(v), np.iinfo(np.int64).max)
    at = np.zeros(len(v), np.int32)
    for j in range(1, len(centroids)):
        d = squared(v, centroids[j])
        closer = d < best
        second = np.where(closer, best, np.minimum(second, d))
        best = np.where(closer, d, best)
        at[closer] = j
    return at, best, second


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the most that any of its vectors can have come nearer
    to any other centroid (see the module's text)."""
    old, new = old.astype(float), new.astype(float)
    way, middle = new - old, (new + old) / 2
    drift = np.sqrt((way ** 2).sum(axis=1))
    out = np.zeros(len(old))
    for i in range(len(old)):
        for j in range(len(old)):
            if i == j or drift[j] == 0:
                continue
            to = old[i] - middle[j]
            far = np.sqrt(to @ to)
            gain = drift[j]
            if far > radius[i]:
                seen = np.arccos(np.clip(to @ way[j] / (far * drift[j]), -1, 1))
                least = seen - np.arcsin(min(radius[i] / far, 1.0)) - SLACK
                if least > 0:
                    gain *= max(np.cos(least), 0.0)
            out[i] = max(out[i], gain)
    return out * (1 + SLACK) + SLACK


def settle(v, at, upper, lower, centroids, drift, loose):
    """The next state of vectors whose centroids have moved: cluster, upper
    and lower bound, and which were scanned."""
    upper = (upper + drift[at]) * (1 + SLACK)
    lower = lower - loose[at]
    unsure = np.flatnonzero(upper >= lower)
    if len(unsure):                                  # the true distance may settle it
        upper[unsure] = np.sqrt(squared(v[unsure], centroids[at[unsure]])) * (1 + SLACK)
        unsure = unsure[upper[unsure] >= lower[unsure]]
    if len(unsure):
        at = at.copy()
        at[unsure], best, second = scan(v[unsure], centroids)
        upper[unsure] = np.sqrt(best.astype(float)) * (1 + SLACK)
        lower[unsure] = np.sqrt(second.astype(float)) * (1 - SLACK)
    return at, upper, lower, len(unsure)


def _round(state: DataFrame, dim: int, first: bool, last: bool, centroids, drift, loose) -> DataFrame:
    """One pass: rows of kind 0 are the vectors' new state, rows of kind 1 the
    sums (in v), sizes and radii of one task by cluster."""
    ship(state.sparkSession)
    # k rows of dim numbers and k numbers each: they travel with the function.
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, radii, scanned = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k), 0
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1), dim)
            if first:
                at, best, second = scan(v, centroids)
                upper = np.sqrt(best.astype(float)) * (1 + SLACK)
                lower = np.sqrt(second.astype(float)) * (1 - SLACK)
                looked = len(v)
            else:
                at, upper, lower, looked = settle(v, b.column(2).to_numpy(), b.column(3).to_numpy().copy(),
                                                  b.column(4).to_numpy(), centroids, drift, loose)
            scanned += looked
            np.add.at(sums, at, v)
            np.add.at(sizes, at, 1)
            np.maximum.at(radii, at, upper)
            none = np.zeros(len(v), np.int64)
            # The last pass writes distances, the others the vectors for the next.
            distance, kept = (squared(v, centroids[at]), pa.nulls(len(v), b.column(1).type)) if last else (none, b.column(1))
            yield _rows(0, b.column(0), kept, at, distance, upper, lower, none, none)
        used = np.flatnonzero(sizes)
        if len(used):
            shape = pa.ListArray.from_arrays(np.arange(len(used) + 1) * dim, pa.array(sums[used].ravel()))
            seen = np.zeros(len(used), np.int64)
            seen[0] = scanned
            yield _rows(1, pa.nulls(len(used), pa.int64()), shape, used.astype(np.int32), np.zeros(len(used), np.int64),
                        radii[used], radii[used], sizes[used], seen)

    return state.mapInArrow(run, _STATE)


def _rows(kind, ids, v, at, distance, upper, lower, n, scanned) -> pa.RecordBatch:
    arrays = [pa.array(np.full(len(at), kind, np.int32)), ids, v, pa.array(at.astype(np.int32)), pa.array(distance),
              pa.array(upper), pa.array(lower), pa.array(n), pa.array(scanned)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _STATE.split(", ")])


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``1:<vec_id>``."""
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where(F.col("vec_id").isNotNull()).orderBy(key, "vec_id", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Vectors with cluster and squared distance, the final centroids, and how
    many vectors each pass had to scan."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, dim, scale)
    centroids = seeds(vectors, k)
    if not len(centroids):
        empty = vectors.where("1 = 0").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty, centroids, []
    k, path, state, looked = len(centroids), None, vectors, []
    drift = loose = np.zeros(k)
    for r in range(rounds + 1):
        old, path = path, scratch_path(spark, "clusters")
        _round(state, dim, r == 0, r == rounds, centroids, drift, loose).write.partitionBy("kind").parquet(path)
        remove(spark, old)
        both = spark.read.schema(_STATE).parquet(path)
        state = both.where("kind = 0").select("vec_id", "v", "cluster", "upper", "lower")
        told = both.where("kind = 1")
        sizes = told.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("upper").alias("radius"),
                                            F.sum("scanned").alias("scanned")).collect()       # k rows
        looked.append(sum(s.scanned for s in sizes))
        if r == rounds:
            return both.where("kind = 0").select("vec_id", "cluster", "distance"), centroids, looked
        sums = (told.select("cluster", F.posexplode("v").alias("d", "x")).groupBy("cluster", "d")
                .agg(F.sum("x").alias("x")).collect())                                          # k * dim rows
        size, radius = {s.cluster: s.n for s in sizes}, np.zeros(k)
        for s in sizes:
            radius[s.cluster] = s.radius
        new = centroids.copy()
        for s in sums:
            new[s.cluster, s.d] = s.x // size[s.cluster]
        drift = np.sqrt(((new - centroids).astype(float) ** 2).sum(axis=1)) * (1 + SLACK)
        loose = loosening(centroids, new, radius)
        centroids = new


def described(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """With the distances summed by cluster and over all, and the digest of
    each vector's centroid."""
    spark = found.sparkSession
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    over_all = F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0)))                       # of k rows
    sums = sums.withColumn("inertia", over_all).join(F.broadcast(names), "cluster")
    return found.join(F.broadcast(sums), "cluster").select(                                    # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, _ = clusters(table(spark, sf_dir, "embeddings"))
    return described(found, centroids)


def _oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> str:
    """Plain assignment and update, unrolled; whole numbers throughout."""
    dims = f"range(1, {dim + 1})"
    ctes = [f"""x AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS id, vec_id,
  list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
            f"""c0 AS MATERIALIZED (SELECT CAST(ROW_NUMBER() OVER (ORDER BY h, vec_id, v) - 1 AS INTEGER) AS j, v FROM (
  SELECT vec_id, v, sha256('1:' || CAST(vec_id AS VARCHAR)) AS h FROM x WHERE vec_id IS NOT NULL) ORDER BY h, vec_id, v LIMIT {k})"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT id, vec_id, v, j, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d, j) AS o
  FROM (SELECT x.id, x.vec_id, x.v, c.j, list_sum(list_transform({dims}, lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i]))) AS d
        FROM x, c{r} c)) WHERE o = 1)""")
        if r < rounds:
            # // cuts towards zero; the remainder is made positive first.
            ctes.append(f"""s{r} AS (SELECT j, i, SUM(v[i]) AS s, COUNT(*) AS n FROM a{r}, range(1, {dim + 1}) t(i) GROUP BY j, i),
c{r + 1} AS MATERIALIZED (SELECT c.j, COALESCE(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY j) m ON m.j = c.j)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT a.vec_id, a.j AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(SUM(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(SUM(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"""


ORACLE = _oracle()
