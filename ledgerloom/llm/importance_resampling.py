"""Target-distribution importance resampling of documents by hashed word runs.

Every run of 1 to n consecutive words falls into one of a fixed number of buckets (CRC-32 of its
bytes). A bucket's gain is the rounded log ratio of its smoothed share in the target texts to its
share in the documents; a document weighs the sum of its runs' gains. Adding Gumbel noise drawn from a
hash of the id and keeping the highest scores is sampling without replacement by these weights.

Long texts are cut into overlapping chunks so that no text is one task's work: a cut falls between two
words, a chunk owns the runs that start in it and carries the n-1 words that follow, and the counts and
weights of chunks are added up by document. Counts of a chunk are written once; the totals of the
corpus and the weights are two passes over those, not over the texts. What the driver holds is two totals and
a gain for each bucket.

Cases: a null or empty text has no words, no features and weight zero; rows that repeat a doc_id are
documents of their own, with the same noise; equal scores are ranked by doc_id, a null doc_id last
(its noise is that of the text "null"), rows that are equal in both in any order; without target texts
all gains come from the documents alone; an empty table gives no rows; columns other than doc_id
and text are not read. A word longer than a chunk stays whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

N = 1  # longest run of words
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
CHUNK = 1 << 18  # bytes of text whose runs one chunk owns

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")  # of UTF-8 after lower-casing
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
COUNTED = "row long, doc_id long, alone boolean, words long, features long, buckets binary, times binary"


def cut(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """(own, carry) chunks of a text: cuts between words about every ``size`` bytes, and the n-1 words after each."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        stop = end
        for _, m in zip(range(n - 1), WORD.finditer(text, end)):
            stop = m.end()
        yield text[at:end], text[end:stop]
        at = end


def run_counts(own: bytes, carry: bytes, n: int) -> tuple[int, Counter]:
    """Words of ``own``, and how often each run of up to n words starts in it."""
    words = WORD.findall(own)
    seen = Counter(words)
    if n > 1:
        after = WORD.findall(carry)[: n - 1]
        for k in range(2, n + 1):
            line = words + after[: k - 1]
            seen.update(map(b" ".join, zip(*(line[i:] for i in range(k)))))
    return len(words), seen


def counted(docs: DataFrame, n: int = N, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Counts by bucket of every chunk of ``docs(doc_id, text)``, ``row`` telling documents apart; texts of more than one chunk are dealt out."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("long", F.octet_length("text") > chunk)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
                for k, (own, carry) in enumerate(cut(text.as_py().lower(), n, chunk)):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([-1 - row.as_py()]), "doc_id": pa.array([doc.as_py()], pa.int64()), "chunk": [k], "own": pa.array([own]), "carry": pa.array([carry])})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, ids, times = [], [], [], []
            split = "own" in batch.schema.names
            for i in range(batch.num_rows):
                own, carry = (batch.column("own")[i].as_py(), batch.column("carry")[i].as_py()) if split else (batch.column("text")[i].as_py().lower(), b"")
                w, seen = run_counts(own, carry, n)
                found = np.fromiter(seen.values(), np.uint32, len(seen))
                words.append(w)
                features.append(int(found.sum(dtype=np.int64)))
                ids.append((np.fromiter(map(crc32, seen), np.uint32, len(seen)) % buckets).astype(np.uint32).tobytes())
                times.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([not split] * len(words)), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())], ["row", "doc_id", "alone", "words", "features", "buckets", "times"])

    short = rows.where(~F.col("long")).select("row", "doc_id", "text").mapInArrow(count, COUNTED)
    pieces = rows.where("long").select("row", "doc_id", "text").mapInArrow(spread, "row long, doc_id long, chunk long, own binary, carry binary")
    return short.unionByName(pieces.repartition("row", "chunk").mapInArrow(count, COUNTED))


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Runs of all chunks by bucket; a task adds up its own first and sends one row for each bucket at most, as does the grouping."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for ids, times in zip(batch.column("buckets").to_pylist(), batch.column("times").to_pylist()):
                np.add.at(sums, np.frombuffer(ids, np.uint32), np.frombuffer(times, np.uint32))
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(sums[held])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in counts.select("buckets", "times").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket, from the totals of both."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, words, n_features, weight) of every document; only chunks of cut texts are grouped."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("buckets").to_pylist(), batch.column("times").to_pylist())
            weight = [int(gain[np.frombuffer(i, np.uint32)] @ np.frombuffer(t, np.uint32).astype(np.int64)) for i, t in pairs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "alone", "words", "features")), pa.array(weight, pa.int64())], ["row", "doc_id", "alone", "words", "n_features", "weight"])

    each = counts.mapInArrow(weigh, "row long, doc_id long, alone boolean, words long, n_features long, weight long")
    parts = each.where(~F.col("alone")).groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("words", "n_features", "weight")))
    return each.where("alone").drop("alone").unionByName(parts)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 1 by score, ties to the smaller doc_id: sorted by ranges, places counted within a range and added up over the ranges."""
    placed = scratch.write(rows.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return out.withColumn("rank", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "start", "at")


def resampled(spark: SparkSession, docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs(doc_id, text)``; rank is null where it is not drawn."""
    scratch = Scratch(spark, "resampling")
    source = scratch.write(counted(docs, n, buckets, chunk))
    wanted = counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets, chunk)
    gain = gains(totals(source, buckets), totals(wanted, buckets))
    scored = scratch.write(weighed(source, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    scratch.drop(source)
    able = scored.where(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    shown = ["doc_id", "n_features", "weight", "score"]
    out = ranked(scratch, able).select(*shown, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return out.unionByName(scored.where(F.col("words") < least_words).select(*shown, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: CRC-32 is a fold over the bytes of each distinct word, with its table made by the same rule.
OP13_SQL = """WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
 d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 g AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
 f AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY 1, 2),
 v AS (SELECT DISTINCT w FROM f UNION SELECT DISTINCT w FROM g),
 y AS (SELECT w, list_transform(range(1, len(hex(encode(w))), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT) AS b FROM v),
 h AS MATERIALIZED (SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM y, crc),
 s AS (SELECT b, sum(n) AS s FROM f JOIN h USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS t FROM g JOIN h USING (w) GROUP BY 1),
 k AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
 m AS (SELECT r, sum(n * gain) AS weight FROM f JOIN h USING (w) JOIN k USING (b) GROUP BY 1),
 c AS (SELECT r, doc_id, len(w) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
 q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, (10 * count(*) OVER ()) // 100 AS drawn FROM c WHERE n >= 20)
 SELECT doc_id, n::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN rank <= drawn THEN rank END AS rank FROM c LEFT JOIN q USING (r)"""
