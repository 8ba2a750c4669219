"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are dealt over shards by a hash of their id; the shards' number grows as the root of the
rows, so both a shard and the copies of the queries stay moderate. A task builds its shard's tree:
each node takes a vantage point, splits its vectors at the median distance to it and keeps the range
of distances on either side. All queries of a block walk the tree together, nearer side first. The
triangle inequality rules a side out if it lies further from the query's distance than ``factor``
times the k-th best distance so far: at one the search is exact, below one it prunes more and may
miss. Each shard returns its k nearest, which are ranked again over the shards.

Cases: see ``vectors.usable``; vectors only meet others of their dimension; fewer candidates than k
are all returned; ties go to the smaller id; a query is never its own candidate; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read
from .vectors import as_binary, cosine, matrix, unit, usable

FACTOR = 0.8
K = 5
LEAF = 48
SHARDS = 0.14  # times the root of the number of vectors
QUERY_BLOCK = 65536  # queries that walk a shard's tree together; a shard's vectors are sent once for each block


class VantageTree:
    """Tree over unit vectors; distances are Euclidean, so order is that of the cosine."""

    def __init__(self, units: np.ndarray):
        self.units = units
        self.root = self.build(np.arange(len(units)))

    def build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        point = rows[len(rows) // 2]
        far = distance(self.units[rows] @ self.units[point])
        middle = np.median(far)
        inner = far <= middle
        if inner.all():  # many copies of one vector
            return rows
        sides = [(rows[s], float(far[s].min()), float(far[s].max())) for s in (inner, ~inner)]
        return self.units[point], [(self.build(r), low, high) for r, low, high in sides]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest per query, -1 where there are fewer; ``own`` is each query's row or -1."""
        self.queries, self.own, self.k, self.factor = queries, own, k, factor
        self.best = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1)
        self.visit(self.root, np.arange(len(queries)))
        return self.rows, self.best

    def visit(self, node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            near = self.queries[asked] @ self.units[node].T
            near[node == self.own[asked, None]] = -np.inf
            score = np.concatenate([self.best[asked], near], axis=1)
            row = np.concatenate([self.rows[asked], np.broadcast_to(node, near.shape)], axis=1)
            top = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
            self.best[asked], self.rows[asked] = np.take_along_axis(score, top, 1), np.take_along_axis(row, top, 1)
            return
        point, sides = node
        away = distance(self.queries[asked] @ point)
        gap = np.stack([np.maximum(low - away, away - high) for _, low, high in sides])
        first = gap.argmin(axis=0)
        for turn in (0, 1):
            for s in (0, 1):
                go = (first == s) if turn == 0 else (first != s)
                reach = distance(self.best[asked, -1])
                self.visit(sides[s][0], asked[go & (gap[s] <= self.factor * reach + 1e-9)])


def distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def nearest(spark: SparkSession, table: DataFrame, queries: str, k: int = K, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows to every row that the condition ``queries`` names."""
    scratch = Scratch(spark, "vantage")
    rows = scratch.write(usable(table).withColumn("asks", F.expr(queries)))
    n, asking = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()
    shards = max(1, math.ceil(SHARDS * math.sqrt(n)))
    blocks = max(1, math.ceil(asking / QUERY_BLOCK))
    schema = "shard int, block int, dimension int, vec_id long, vector binary, asks boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def deal(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            vector, asks = as_binary(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            size = np.array([len(v) // 8 for v in vector.to_pylist()], np.int32)
            for asked, times in ((False, blocks), (True, shards)):
                take = np.flatnonzero(asks) if asked else np.arange(len(ids))
                take = np.repeat(take, times)
                step = np.tile(np.arange(times, dtype=np.int32), len(take) // times)
                shard = step if asked else (mixed[take] % np.uint64(shards)).astype(np.int32)
                block = (mixed[take] // np.uint64(shards) % np.uint64(blocks)).astype(np.int32) if asked else step
                pick = pa.array(take)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(block), pa.array(size[take]), batch.column(0).take(pick), vector.take(pick), pa.array(np.full(len(take), asked))], names)

    def search(key, table):
        asks = table.column("asks").to_numpy()
        ids, vectors = table.column("vec_id").to_numpy(), matrix(table.column("vector"))
        order = np.argsort(ids[~asks], kind="stable")
        held, x = ids[~asks][order], vectors[~asks][order]
        query, q = ids[asks], vectors[asks]
        if not len(held) or not len(query):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        place = np.searchsorted(held, query)
        own = np.where((place < len(held)) & (held[np.minimum(place, len(held) - 1)] == query), place, -1)
        tree, qu = VantageTree(unit(x)), unit(q)
        spare = k + 3  # near-ties in the product are settled by the exact measure
        out = []
        for at in range(0, len(query), 1024):
            part = slice(at, at + 1024)
            found, _ = tree.search(qu[part], own[part], spare, factor)
            who, col = np.nonzero(found >= 0)
            row = found[who, col]
            score = cosine(q[part][who], x[row])
            by = np.lexsort((held[row], -score, who))
            who, row, score = who[by], row[by], score[by]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            top = place < k
            out.append((query[part][who[top]], held[row[top]], score[top]))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    met = rows.select("vec_id", "vector", "asks").mapInArrow(deal, schema).groupBy("shard", "block", "dimension").applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vp_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
