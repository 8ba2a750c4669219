"""Bounded k-means against plain exact k-means in Python integers."""

import hashlib
import math
import random

import pytest

from ledgerloom.llm import elkan_clusters as elkan

SCHEMA = "vec_id long, embedding array<double>, label int, x string, cluster int, upper string, lower string, distance string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 0, "x", 1, "u", "l", "d") for i, v in zip(range(len(vectors)) if ids is None else ids, vectors)], SCHEMA)


def plain(vectors, ids, k, rounds, dimensions=3, scale=4, seed=2):
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in zip(ids, vectors) if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    cents = [x for _, x in sorted(held, key=lambda p: (hashlib.sha256(f"{seed}:{'null' if p[0] is None else p[0]}".encode()).hexdigest(), p[1]))[:k]]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for step in range(rounds + 1):
        of = [min(range(len(cents)), key=lambda c: (gap(x, cents[c]), c)) for _, x in held]
        if step < rounds:
            for c in range(len(cents)):
                own = [x for (_, x), a in zip(held, of) if a == c]
                if own:
                    cents[c] = [sum(col) // len(own) for col in zip(*own)]
    near = [gap(x, cents[a]) for (_, x), a in zip(held, of)]
    top = (1 << 63) - 1
    return sorted(((i, a, min(d, top), min(sum(min(e, top) for e, b in zip(near, of) if b == a), top), min(sum(min(e, top) for e in near), top), hashlib.sha256(",".join(map(str, cents[a])).encode()).hexdigest()) for (i, _), a, d in zip(held, of, near)), key=str)


def check(spark, vectors, ids=None, k=7, rounds=4):
    ids = list(range(len(vectors))) if ids is None else ids
    got = elkan.clusters(spark, table(spark, vectors, ids), k=k, rounds=rounds, dimensions=3, scale=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(vectors, ids, k, rounds)


def test_random_and_ties(spark):
    rng = random.Random(1)
    check(spark, [[rng.uniform(-3, 3) for _ in range(3)] for _ in range(400)])
    check(spark, [[rng.randrange(-2, 3) / 2 for _ in range(3)] for _ in range(500)], k=12)  # a grid: many equal distances and vectors
    check(spark, [[c * 10 + rng.gauss(0, 1) for _ in range(3)] for c in range(6) for _ in range(80)], k=9, rounds=6)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0, 2.0], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 0.0], [0.0, 0.0, 0.0], [1.0] * 4]
    check(spark, odd + [[1.0, 2.0, 3.0]] * 30 + [[-0.1, 0.1, 5.0], [2.0, 2.0, 2.0]], [*range(8), *range(10, 25), *[25] * 15, None, 25])
    check(spark, [[1.0, 1.0, 1.0]], k=7)
    check(spark, [[2e9, -1e9, 3.0], [1.0, 2.0, 3.0], [2e9, -1e9, 4.0], [1e17, 0.0, 0.0], [1.0, 2.0, 2.5]], k=2)  # beyond 64-bit squares
    assert elkan.clusters(spark, table(spark, odd[:6]), dimensions=3).count() == 0
    assert elkan.clusters(spark, table(spark, [[1.0]]).where("vec_id < 0")).count() == 0


def test_bounds_skip_distances(spark, monkeypatch):
    rng = random.Random(4)
    vectors = [[math.floor(4 * (c * 20 + rng.gauss(0, 1))) for _ in range(3)] for c in range(10) for _ in range(60)]
    import numpy as np

    x, k = np.array(vectors), 10
    cents = elkan.Centroids([vectors[60 * c] for c in range(k)])
    cluster, upper, lower = np.zeros(600, np.int32), np.full(600, np.inf), np.zeros((600, k))
    first = elkan.assign(x, cents, cluster, upper, lower)
    assert first < 600 * k  # between centroids already
    assert elkan.assign(x, cents, cluster, upper, lower) < 60  # nothing moved
    assert all(elkan.floats_below(np.array([v]))[0] <= v for v in (0.1, 1 / 3, 1e9 + 0.3, 0.0))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    import duckdb

    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{path}/embeddings.parquet')")
    found = con.execute(elkan.OP12_SQL)
    columns = [d[0] for d in found.description]
    assert sorted(map(tuple, elkan.op12_elkan_clusters(spark, path).select(*columns).collect())) == sorted(found.fetchall())
