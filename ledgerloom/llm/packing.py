"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut at multiples of the sequence length; whole pieces fill sequences of their
own, and only the histogram of the tails, at most one entry per length, reaches the driver. A linear
program over patterns (multisets of tail lengths that share a sequence) is solved by column
generation: a knapsack dynamic program prices new patterns against the duals, a revised simplex
takes them in. The fractional solution is rounded down, the few tails left over are filled greedily
to exact sums where one or two tails allow, and the patterns' slots are dealt to the documents by
their rank among the tails of the same length. Ranks come from salted buckets, so that a length a
third of all documents share is still ranked in parallel.

Cases: a null or empty text is the end id alone; texts of any length are cut, never truncated; a
null doc_id is packed like any other; rows that repeat are packed each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read, shuffle_width
from .tokens import RANKS, encoder, token_ids

LENGTH = 1024
END = 0
SALTS = 8  # ranking buckets for each shuffle partition
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# --- the linear program, on a histogram of at most LENGTH - 1 entries ---------------------------------
def padded(total: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Positions a sequence of ``total`` ids takes: itself at a power of two, else the full length."""
    total = np.asarray(total)
    return np.where((total & (total - 1)) == 0, total, length)


def price(lengths: np.ndarray, dual: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the best dual value of each exact sum, and the last item taken."""
    value, item = np.full(length + 1, -np.inf), np.zeros(length + 1, np.int64)
    value[0] = 0
    upto = np.searchsorted(lengths, np.arange(length + 1), side="right")
    for total in range(1, length + 1):
        k = upto[total]
        if k:
            gain = value[total - lengths[:k]] + dual[:k]
            item[total] = best = int(gain.argmax())
            value[total] = gain[best]
    return value, item


def filled(have: np.ndarray, length: int) -> list[int]:
    """Lengths for one sequence from those that ``have`` marks: the longest first, then exact fills by one or two, else the longest."""
    take, room = [], length
    while room and have[: room + 1].any():
        pick = [int(np.flatnonzero(have[: room + 1])[-1])]
        if take:
            if have[room]:
                pick = [room]
            else:
                a = np.flatnonzero(have[: room // 2 + 1])
                a = a[(a > 0) & (have[room - a] > (a * 2 == room))]
                if len(a):
                    pick = [int(room - a[-1]), int(a[-1])]
        for size in pick:
            have[size] -= 1
            take.append(size)
            room -= size
    return take


def first_basis(lengths: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A feasible basis: each pattern is used until it exhausts a length that no later pattern holds."""
    m = len(lengths)
    place = np.zeros(length + 1, np.int64)
    place[lengths] = np.arange(m)
    left = demand.astype(float)
    basis, use = np.zeros((m, m)), np.zeros(m)
    open_ = np.ones(m, bool)
    for _ in range(m):
        have = np.zeros(length + 1, np.int64)
        have[lengths[open_]] = length
        pattern = np.bincount(place[filled(have, length)], minlength=m)
        held = np.flatnonzero(pattern)
        i = held[np.argmin(left[held] / pattern[held])]
        use[i] = max(left[i] / pattern[i], 0.0)
        left = left - use[i] * pattern
        basis[:, i], open_[i] = pattern, False
    return basis, use


def solve(lengths: np.ndarray, demand: np.ndarray, length: int = LENGTH, gap: float = 1e-4, rounds: int = 1000) -> list[tuple[np.ndarray, float]]:
    """Patterns (count of each length) with their fractional use.

    Ends within ``gap`` of the fewest positions possible, at the optimum, or after ``rounds`` pivots;
    the patterns cover the demand whenever it ends.
    """
    m = len(lengths)
    # demands a little apart, so that no pivot is empty
    demand = demand * (1 + 1e-7 * np.random.default_rng(0).random(m))
    basis, use = first_basis(lengths, demand, length)
    cost = padded((lengths @ basis).astype(np.int64), length).astype(float)
    inverse = np.linalg.inv(basis)
    floor = float(lengths @ demand)  # no sequence takes fewer positions than its ids
    pool, pool_cost = np.empty((m, 0)), np.empty(0)
    sums = np.arange(length + 1)
    for step in range(rounds):
        if cost @ use <= floor * (1 + gap):
            break
        dual = cost @ inverse
        reduced = pool_cost - dual @ pool
        if not len(reduced) or reduced.min() > -1e-6 * length:
            value, item = price(lengths, dual, length)
            slack = padded(sums, length) - value
            slack[0] = np.inf
            found = [s for s in np.argsort(slack)[:100].tolist() if slack[s] < -1e-6 * length]
            if not found:
                break
            new = np.zeros((m, len(found)))
            for j, total in enumerate(found):
                while total:
                    new[item[total], j] += 1
                    total -= int(lengths[item[total]])
            pool, pool_cost = new, padded(np.array(found), length).astype(float)
            reduced = pool_cost - dual @ pool
        enter = int(reduced.argmin())
        column = pool[:, enter]
        drop = inverse @ column
        ratio = np.full(m, np.inf)
        real = drop > 1e-9
        ratio[real] = np.maximum(use[real], 0) / drop[real]
        leave = int(ratio.argmin())
        amount = ratio[leave]
        use = use - amount * drop
        use[leave] = amount
        row = inverse[leave] / drop[leave]
        inverse -= np.outer(drop, row)
        inverse[leave] = row
        basis[:, leave], cost[leave] = column, pool_cost[enter]
        if step % 400 == 399:  # rounding errors do not build up
            inverse = np.linalg.inv(basis)
            use = inverse @ demand
    return [(basis[:, j].round().astype(np.int64), float(use[j])) for j in range(m) if use[j] > 0]


def leftovers(lengths: np.ndarray, left: np.ndarray, length: int) -> list[list[int]]:
    """Sequences (lists of lengths) for the tails that rounding left: exact fills by one or two tails, else the longest."""
    have = np.zeros(length + 1, np.int64)
    have[lengths] = left
    out = []
    while have.any():
        out.append(filled(have, length))
    return out


def plan(histogram: dict[int, int], length: int = LENGTH) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each tail length its slots (first rank, tails per sequence, first sequence, offset); and the sequences used."""
    lengths = np.array(sorted(histogram), np.int64)
    slots: dict[int, list[tuple[int, int, int, int]]] = {int(x): [] for x in lengths}
    if not len(lengths):
        return slots, 0
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    rank, sequence = np.zeros(len(lengths), np.int64), 0
    solved = solve(lengths, demand.astype(float), length)
    whole = [(p, int(use + 1e-5)) for p, use in solved]
    again = [(p, 1) for p, _ in sorted(solved, key=lambda s: int(s[1] + 1e-5) - s[1])]  # the largest fractions are rounded up while they fit
    for pattern, times in whole + again:
        held = pattern > 0
        times = min(times, int(((demand - rank)[held] // pattern[held]).min()))
        if times <= 0:
            continue
        offset = 0
        for i in np.flatnonzero(held).tolist():
            slots[int(lengths[i])].append((int(rank[i]), int(pattern[i]), sequence, offset))
            rank[i] += times * pattern[i]
            offset += int(pattern[i] * lengths[i])
        sequence += times
    place = {int(x): i for i, x in enumerate(lengths)}
    for take in leftovers(lengths, demand - rank, length):
        offset = 0
        for size in take:
            i = place[size]
            slots[size].append((int(rank[i]), 1, sequence, offset))
            rank[i] += 1
            offset += size
        sequence += 1
    return slots, sequence


# --- on Spark -----------------------------------------------------------------------------------
def tokenised(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """doc_id, n (ids with the end id), and the crc32 of each piece's ids."""

    def run(batches):
        import zlib

        coder = encoder(vocabulary)
        for batch in batches:
            n, crcs = [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(token_ids(coder, text), np.uint32(END)).astype("<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[a : a + length].tobytes()) for a in range(0, len(ids), length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "n", "crcs"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, crcs array<long>")


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str = RANKS, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    cut = scratch.write(tokenised(docs, vocabulary, length))
    buckets = SALTS * shuffle_width(spark)
    rows = cut.withColumn("tail", (F.col("n") % length).cast("int")).withColumn("full", F.floor(F.col("n") / length))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "n", "crcs"), F.lit(buckets)).cast("int"))

    counts = rows.groupBy("bucket", "tail").agg(F.count("*").alias("docs"), F.sum("full").alias("full"))
    counts = scratch.write(counts)
    histogram = {r["tail"]: r["docs"] for r in counts.where("tail > 0").groupBy("tail").agg(F.sum("docs").alias("docs")).collect()}
    slots, used = plan(histogram, length)

    before = Window.partitionBy("tail").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("bucket", "tail", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("tail_from"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    whole = counts.groupBy("bucket").agg(F.sum("full").alias("full")).select("bucket", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_from"))
    order = [F.col("doc_id"), F.col("n"), F.xxhash64("crcs")]
    in_bucket = Window.partitionBy("bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    in_tail = Window.partitionBy("bucket", "tail").orderBy(*order)
    ranked = rows.withColumn("full_rank", F.coalesce(F.sum("full").over(in_bucket), F.lit(0))).withColumn("tail_rank", F.row_number().over(in_tail) - 1)
    ranked = ranked.join(first, ["bucket", "tail"]).join(whole, "bucket")
    ranked = ranked.select("doc_id", "n", "crcs", "tail", (F.col("full_rank") + F.col("full_from")).alias("whole_at"), (F.col("tail_rank") + F.col("tail_from")).alias("tail_at"))
    table = {t: tuple(np.array(x, np.int64) for x in zip(*s)) for t, s in slots.items()}

    def pieces(batches):
        for batch in batches:
            doc, n, crcs, tail, whole_at, tail_at = (batch.column(i) for i in range(6))
            n, tail, whole_at, tail_at = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (n, tail, whole_at, tail_at))
            total = -(-n // length)
            row = np.repeat(np.arange(len(n)), total)
            k = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
            size = np.minimum(length, n[row] - k * length)
            sequence, offset = used + whole_at[row] + k, np.zeros(len(row), np.int64)
            tails = np.flatnonzero(size < length)
            for t in np.unique(size[tails]).tolist():
                mine = tails[size[tails] == t]
                rank, each, seq, at = table[t]
                slot = np.searchsorted(rank, tail_at[row[mine]], side="right") - 1
                local = tail_at[row[mine]] - rank[slot]
                sequence[mine] = seq[slot] + local // each[slot]
                offset[mine] = at[slot] + local % each[slot] * t
            yield pa.RecordBatch.from_arrays(
                [doc.take(pa.array(row)), *(pa.array(x) for x in (k * length, size)), crcs.flatten(), *(pa.array(x) for x in (n[row], sequence, offset))],
                [c.split()[0] for c in PIECES.split(", ")],
            )

    return ranked.mapInArrow(pieces, PIECES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return pack(spark, docs)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents"))
