"""Importance resampling against a plain count of all runs, with small chunks, and against its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from ledgerloom.llm import importance_resampling as resampling

SCHEMA = "doc_id long, text string, lang string, row string, rank string, score string, at string, words string, long string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "r", "k", "s", "a", "w", "l") for i, t in zip(range(len(texts)) if ids is None else ids, texts)], SCHEMA)


def runs(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, Counter(" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1))


def plain(docs, target, n, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t, held = Counter(), Counter(), []
    for i, text in docs:
        words, seen = runs(text, n)
        held.append((i, len(words), seen))
        for f, c in seen.items():
            s[bucket(f)] += c
    for text in target:
        for f, c in runs(text, n)[1].items():
            t[bucket(f)] += c
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t_all + 0.0) / ((s[b] + 1) * (u_all + 0.0)))) for t_all, u_all in [(s.total() + buckets, t.total() + buckets)] for b in s}
    rows = []
    for i, words, seen in held:
        weight = sum(gain[bucket(f)] * c for f, c in seen.items())
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, seen.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def texts(rng, count, vocabulary=60):
    return [" ".join(rng.choice(["W", "w", "é", "ß9"]) + str(rng.randrange(vocabulary)) + rng.choice(["", ",", "\n", "-", "_"]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60, 400]))) for _ in range(count)]


@pytest.mark.parametrize("n,chunk", [(1, 1 << 18), (1, 50), (3, 1 << 18), (3, 50), (4, 7)])
def test_against_plain_counts(spark, n, chunk):
    rng = random.Random(n * 100 + chunk)
    docs = [None, "", " -- ", "a" * 300, "A-b_c\x00d\x7fÉé日本"] + texts(rng, 60)
    docs += [docs[8]] * 3 + ["one two " * 3000]
    ids = [*range(len(docs) - 3), None, 7, 7]
    target = [None, ""] + texts(rng, 15, 20)
    got = resampling.resampled(spark, table(spark, docs, ids), table(spark, target), n=n, buckets=500, percent=30, least_words=20, chunk=chunk)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(list(zip(ids, docs)), target, n, 500, 30, 20)


def test_cuts_own_every_start_once():
    rng = random.Random(5)
    for text in [x.encode().lower() for x in texts(rng, 40)] + [b"", b"abc" * 50, b" a"]:
        for n in (1, 2, 5):
            for size in (1, 6, 40):
                whole, parts = resampling.run_counts(text, b"", n), [resampling.run_counts(a, b, n) for a, b in resampling.cut(text, n, size)]
                assert sum(w for w, _ in parts) == whole[0] and sum((c for _, c in parts), Counter()) == whole[1]


def test_cases(spark):
    docs, nothing = table(spark, ["a b " * 30, None]), table(spark, ["x"]).where("doc_id < 0")
    assert resampling.resampled(spark, nothing, docs).count() == 0
    assert sorted(map(tuple, resampling.resampled(spark, docs, nothing).collect()), key=str) == plain([(0, "a b " * 30), (1, None)], [], 1, 10_000, 10, 20)
    same = table(spark, ["a b " * 30] * 40)  # only the noise tells these apart
    assert sorted(map(tuple, resampling.resampled(spark, same, docs).collect()), key=str) == plain([(i, "a b " * 30) for i in range(40)], ["a b " * 30, None], 1, 10_000, 10, 20)


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{path}/{name}.parquet')")
    found = con.execute(resampling.OP13_SQL)
    columns = [d[0] for d in found.description]
    got = resampling.op13_importance_resampling(spark, path).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(found.fetchall(), key=str)
