"""Exact integer k-means with Elkan's bounds.

Vectors become integers, so distances, sums and floors are exact and no result depends on how rows are
split. Each vector keeps its cluster, an upper bound of the distance to that centroid and a lower bound
of the distance to every centroid. After a round the bounds move with the centroids; a distance is
calculated only where neither the lower bound nor half the distance between two centroids shows that
the other centroid is farther. Bounds are doubles (the lower ones stored as floats) rounded away from the
truth, and only a *strictly* farther centroid is skipped, so equal distances are always compared as integers.

The vectors and their bounds are one table in the shared folder, rewritten each round without a shuffle; a
task sends one row of sums for each cluster. The driver holds the centroids only, k times the components.

Cases: vectors that are null, of another length, or hold null or non-finite components are left out;
rows that repeat a vec_id are vectors of their own (of equal seed hashes the smaller vector comes first),
a null vec_id hashes as the text "null"; with fewer vectors than k every vector is a seed; equal
centroids leave the later ones empty, and these stay where they are; an empty table gives no rows;
other columns are not read. Integers beyond 64 bits, and distances and inertias beyond them, are
held at the end of the range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

K = 40
ROUNDS = 5
DIMENSIONS = 64
SCALE = 256
SEED = 2
LARGEST = (1 << 63) - 1

SAFE = 1 << 27  # components up to here have squared distances that fit 64 bits; others are summed as Python integers
SLACK = 1e-14  # more than the rounding of a conversion, a root and a sum together
STATE = "vec_id long, x array<long>, cluster int, upper double, lower array<float>"


def points(table: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("v").isNotNull() & (F.size("v") == dimensions) & sound)
    return v.select("vec_id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x)).alias("x"))


def seeds(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors of smallest hash."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    return [list(r.x) for r in vectors.orderBy(F.sha2(key.cast("binary"), 256), "x").select("x").limit(k).collect()]


class Centroids:
    """Centroids, half the distances between them, rounded down, and how far each moved in the last round, rounded up."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows, k = rows, len(rows)
        apart = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
        self.half = np.array([[apart(a, b) / 2 * (1 - SLACK) for b in rows] for a in rows]).reshape(k, k)
        others = self.half + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.nearest = others.min(axis=1, initial=np.inf)
        self.moved = np.array([apart(a, b) * (1 + SLACK) for a, b in zip(rows, before or rows)])
        self.small = all(-SAFE <= x <= SAFE for row in rows for x in row)
        self.array = np.array(rows, np.int64 if self.small else object)

    def __len__(self) -> int:
        return len(self.rows)

    def squared(self, x: np.ndarray, c) -> np.ndarray:
        """Exact squared distances of rows to centroid c, or to one centroid each."""
        d = x - self.array[c]
        return (d * d).sum(axis=1)


def matrix(column: pa.Array, like: Centroids) -> np.ndarray:
    """Vectors of a batch as a matrix of 64-bit integers, or of Python integers where those could overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return x if like.small and (not x.size or (x.min() >= -SAFE and x.max() <= SAFE)) else x.astype(object)


def root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(float))


def assign(x: np.ndarray, cents: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Moves each row to its nearest centroid, the smaller number of equals, in place; returns how many distances that took."""
    asked = np.flatnonzero(upper >= cents.nearest[cluster])
    best = cents.squared(x[asked], cluster[asked])
    upper[asked] = root(best) * (1 + SLACK)
    lower[asked, cluster[asked]] = root(best) * (1 - SLACK)
    count = len(asked)
    for c in range(len(cents)):
        at, now = cluster[asked], upper[asked]
        open_ = np.flatnonzero((at != c) & (now >= lower[asked, c]) & (now >= cents.half[at, c]))
        if not len(open_):
            continue
        rows = asked[open_]
        d = cents.squared(x[rows], c)
        count += len(rows)
        lower[rows, c] = root(d) * (1 - SLACK)
        nearer = (d < best[open_]) | ((d == best[open_]) & (c < cluster[rows]))
        won = rows[nearer]
        best[open_[nearer]] = d[nearer]
        cluster[won], upper[won] = c, root(d[nearer]) * (1 + SLACK)
    return count


def floats_below(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y).astype(np.float32)


def with_clusters(vectors: DataFrame, cents: Centroids) -> DataFrame:
    """One assignment of all vectors; ``vectors`` comes from points(), or from here with its bounds before ``cents`` moved."""
    fresh, k = "cluster" not in vectors.columns, len(cents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            x = matrix(batch.column("x"), cents)
            if fresh:
                cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k))
            else:
                cluster = batch.column("cluster").to_numpy().copy()
                upper = (batch.column("upper").to_numpy() + cents.moved[cluster]) * (1 + SLACK)
                lower = batch.column("lower").flatten().to_numpy().reshape(n, k).astype(float)
                lower = np.maximum(lower * (1 - SLACK) - cents.moved * (1 + SLACK), 0)
            assign(x, cents, cluster, upper, lower)
            bounds = pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(floats_below(lower).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(cluster), pa.array(upper), bounds], ["vec_id", "x", "cluster", "upper", "lower"])

    return vectors.mapInArrow(run, STATE)


def moved(state: DataFrame, cents: Centroids) -> Centroids:
    """Centroids at the floor of their vectors' mean; those without vectors stay."""
    k = len(cents)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = [0] * k, [0] * k
        for batch in batches:
            x, cluster = matrix(batch.column("x"), cents), batch.column("cluster").to_numpy()
            for c in np.unique(cluster).tolist():
                rows = x[cluster == c]
                sums[c] = sums[c] + rows.sum(axis=0).astype(object)
                sizes[c] += len(rows)
        held = [c for c in range(k) if sizes[c]]
        cells = [[Decimal(int(v)) for v in sums[c]] for c in held]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([sizes[c] for c in held], pa.int64()), pa.array(cells, pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "total"])

    parts = state.select("x", "cluster").mapInArrow(add, "cluster int, n long, total array<decimal(38,0)>")
    cells = parts.select("cluster", "n", F.posexplode("total").alias("at", "total")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    rows = [list(r) for r in cents.rows]
    for r in cells.collect():  # k times the components
        rows[r.cluster][r.at] = int(r.total) // r.n
    return Centroids(rows, cents.rows)


def distances(state: DataFrame, cents: Centroids) -> DataFrame:
    """(vec_id, cluster, distance): the squared distance to the own centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster")
            d = cents.squared(matrix(batch.column("x"), cents), cluster.to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, pa.array(np.minimum(d, LARGEST).astype(np.int64))], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "x", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(spark: SparkSession, table: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector of ``table(vec_id, embedding)`` that takes part."""
    scratch = Scratch(spark, "clusters")
    state = scratch.write(points(table, dimensions, scale))
    cents = Centroids(seeds(state, k, seed))
    for at in range(rounds + 1 if len(cents) else 0):
        before, state = state, scratch.write(with_clusters(state, cents))
        scratch.drop(before)
        if at < rounds:
            cents = moved(state, cents)
    if not len(cents):
        state = spark.createDataFrame([], STATE)
    near = scratch.write(distances(state, cents))
    inertia = {r.cluster: int(r.total) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    all_ = min(sum(inertia.values()), LARGEST)
    shown = [(c, min(total, LARGEST), all_, hashlib.sha256(",".join(map(str, cents.rows[c])).encode()).hexdigest()) for c, total in inertia.items()]
    facts = spark.createDataFrame(shown, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, read(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The rounds written out: all distances, the first nearest centroid, the floor of the mean."""
    parts = [f"""p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
 c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS c, x FROM p) WHERE c < {K})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.r, q.c, list_sum(list_transform(list_zip(p.x, q.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p, c{i} AS q) GROUP BY 1)""")
        if i < ROUNDS:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT q.c, coalesce(m.x, q.x) AS x FROM c{i} AS q LEFT JOIN (SELECT c, list(m ORDER BY i) AS x FROM (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
  FROM (SELECT a.c, g.i, sum(p.x[g.i]) AS s, count(*) AS n FROM a{i} AS a JOIN p USING (r), generate_series(1, {DIMENSIONS}) AS g(i) GROUP BY 1, 2)) GROUP BY 1) AS m ON q.c = m.c)""")
    return "WITH " + ",\n ".join(parts) + f"""
 SELECT p.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(q.x, ',')) AS centroid_sha256
 FROM p JOIN a{ROUNDS} AS a USING (r) JOIN c{ROUNDS} AS q ON a.c = q.c"""


OP12_SQL = _sql()
