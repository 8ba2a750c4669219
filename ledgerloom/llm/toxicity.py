"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents, drawn by class in the order of a hash of the id, becomes an
inverted index over TF-IDF weights of all their terms. Terms are words and the first letters of longer
words, each hashed to one of SLOTS numbers; document frequencies of the numbers are counted over all
documents, so every term of a text has its weight, indexed or not, and cosines are exact for them.
Posting lists are cut into blocks of examples, and each term keeps its largest weight per block: a
block is scored only while the sum of those maxima can still beat the k-th best, so the k nearest by
cosine are exact. The few terms that very many examples hold would be in every block anyway; their
lists are kept as columns that many texts are multiplied with at once, and a block's bound holds the
best of these sums instead of the sum of maxima, which is closer. Their votes are weighted by distance and turned into probabilities by a logistic
curve fitted on the sample itself, each example judged by the others and weighted to the labels' own
class shares. The nearest examples are returned as evidence.

Cases: null and empty texts, and texts that share no term with the index, get the share of label 1;
without labelled rows every score is zero; labels that repeat an id count once, as their maximum;
null labels and ids are not learnt from; a null doc_id is scored and counts as held out; rows are
scored one by one, so repeated rows repeat their result; equal cosines go to the smaller example;
long texts count whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, is_held_out, read
from .packed import portions, restored, squeezed

SAMPLE = {1: 1200, 0: 1800}  # labelled rows of each class in the index, at most
SLOTS = 1 << 20  # numbers that terms are hashed to
SHARES = 64  # pieces that document counts travel in
BLOCK = 64  # examples in a posting block
FIRST = 8  # blocks scored before the k-th best is known
SOFTEN = 1.05  # a vote weighs 1 / (SOFTEN - cosine)
THRESHOLD = 0.3
NEIGHBOURS = 0.6  # times the square root of the number of examples: the k of the k nearest
EVIDENCE = 5
FREQUENT = 0.1  # terms that this share of the examples holds keep their posting lists as full columns
PORTION = 1 << 21  # bytes of text whose terms are counted at once
BATCH = 64  # texts that meet the full columns at once
LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
STEMS = (4, 5)  # longer words count by so many first letters too, so that forms of a word meet

Terms = tuple[np.ndarray, np.ndarray]


def slots_of(words: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w.encode()) & (SLOTS - 1) for w in words], np.int64)


def counted(texts: list[str | None]) -> list[Terms]:
    """(slots, times) of each text's terms: lower-cased runs of letters, every character beyond ASCII a letter, and stems."""
    plain = pa.array([(t or "").lower().encode().translate(LETTERS) for t in texts], pa.large_binary()).cast(pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(plain))
    size, flat = pc.list_value_length(words).to_numpy().astype(np.int64), words.flatten().dictionary_encode()
    code, known = flat.indices.to_numpy().astype(np.int64), flat.dictionary
    pair, times = tallied(np.repeat(np.arange(len(texts)), size) << 32 | code, None)
    text, code = pair >> 32, pair & 0xFFFFFFFF
    length, listed = pc.utf8_length(known).to_numpy(), known.to_pylist()
    slot, more, n_times = [np.where(length > 0, slots_of(listed), -1)[code]], [text], [times]
    for n in STEMS:
        long = length[code] > n
        stem = np.full(len(listed), -1)
        at = np.flatnonzero(length > n)
        stem[at] = slots_of(["*" + listed[i][:n] for i in at.tolist()])
        slot.append(stem[code[long]])
        more.append(text[long])
        n_times.append(times[long])
    slot = np.concatenate(slot)
    pair, total = tallied(np.concatenate(more)[slot >= 0] << 32 | slot[slot >= 0], np.concatenate(n_times)[slot >= 0])
    edges = np.searchsorted(pair, np.arange(len(texts) + 1) << 32)
    return [(pair[a:b] & 0xFFFFFFFF, total[a:b]) for a, b in zip(edges, edges[1:])]


def tallied(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs, or the sum of its times."""
    if not len(keys):
        return keys, keys
    order = None if times is None else np.argsort(keys)
    keys = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))) if order is None else np.add.reduceat(times[order], first)


class BlockMaxIndex:
    """Examples by term in blocks of BLOCK, each (term, block) cell with its largest weight; ``nearest`` is exact, in doubles."""

    def __init__(self, counts: list[Terms], idf: np.ndarray):
        self.idf, self.n = idf, len(counts)
        held = np.bincount(np.concatenate([c[0] for c in counts] or [np.empty(0, np.int64)]), minlength=len(idf))
        # examples with the same telling terms go to the same blocks, which keeps the maxima apart
        self.example = np.array(sorted(range(self.n), key=lambda i: counts[i][0][np.lexsort((counts[i][0], -held[counts[i][0]]))[:6]].tolist()), np.int64)
        vectors = [self.vector(counts[i]) for i in self.example]
        term, weight = (np.concatenate([v[k] for v in vectors] or [np.empty(0)]) for k in (0, 1))
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(v[0]) for v in vectors])
        del vectors
        self.blocks = -(-self.n // BLOCK)
        frequent = held >= max(FREQUENT * self.n, 2)
        self.column = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        full = frequent[term.astype(np.int64)]
        self.columns = np.zeros((int(frequent.sum()), max(self.blocks, 1) * BLOCK))
        self.columns[self.column[term[full].astype(np.int64)], doc[full]] = weight[full]
        term, doc, weight = term[~full].astype(np.int64), doc[~full], weight[~full]
        order = np.lexsort((doc, term))
        term, self.doc, self.weight = term[order], doc[order], weight[order]
        cell = term * max(self.blocks, 1) + self.doc // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
        self.start = np.append(first, len(cell)).astype(np.int32)  # postings of each cell
        self.block = (self.doc[first] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0)
        self.cells = np.searchsorted(term[first], np.arange(len(idf) + 1)).astype(np.int32)  # cells of each term

    def vector(self, counts: Terms) -> Terms:
        t = counts[0]
        w = (1 + np.log(counts[1])) * self.idf[t]
        norm = math.sqrt(float(w @ w))
        return (t, w / norm) if norm else (t[:0], w[:0])

    def nearest(self, texts: list[Terms], k: int, skip: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text (examples, cosines) of the k nearest that share a term, nearest first, ties to the smaller example."""
        for at in range(0, len(texts), BATCH):
            vectors = [self.vector(c) for c in texts[at : at + BATCH]]
            asked = np.zeros((len(vectors), len(self.columns)))
            for i, (t, w) in enumerate(vectors):
                column = self.column[t]
                asked[i, column[column >= 0]] = w[column >= 0]
            base = asked @ self.columns
            for i, (t, w) in enumerate(vectors):
                yield self.ranked(base[i], t, w, k, skip[at + i] if skip else -1)

    def ranked(self, base: np.ndarray, t: np.ndarray, w: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        cell, w = flat_ranges(self.cells[t], self.cells[t + 1], w)
        block = self.block[cell]
        bound = (base.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, w * self.most[cell], len(base) // BLOCK)) * (1 + 1e-9)
        order = np.argsort(-bound, kind="stable")
        score, least, at, step = np.zeros(len(base)), 0.0, 0, FIRST
        while at < len(order) and bound[order[at]] >= max(least, 1e-12):
            wave = order[at : at + step]
            wave = wave[bound[wave] >= least]
            chosen = np.zeros(len(bound), bool)
            chosen[wave] = True
            use = chosen[block]  # cells stay in the order of terms, so equal examples get equal sums
            posting, weight = flat_ranges(self.start[cell[use]], self.start[cell[use] + 1], w[use])
            score += np.bincount(self.doc[posting], self.weight[posting] * weight, len(score))
            score.reshape(-1, BLOCK)[wave] += base.reshape(-1, BLOCK)[wave]
            at, step = at + step, len(order)
            if len(score) > k + 1:
                least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]  # one spare, as an example may skip itself
        found = np.flatnonzero(score[: self.n] > 0)
        found = found[self.example[found] != skip]
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        found = found[np.lexsort((self.example[found], -score[found]))][:k]
        return self.example[found], score[found]


def flat_ranges(start: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges one after the other, and each range's value repeated for them."""
    size = (end - start).astype(np.int64)
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0), np.repeat(value, size)


class Model:
    """The index, the labels of its examples and the calibration."""

    def __init__(self, ids: list[int], labels: list[int], known: list[Terms], idf: np.ndarray, share: float):
        self.ids, self.labels, self.share = np.array(ids, np.int64), np.array(labels, np.int64), share
        self.k = max(1, math.ceil(NEIGHBOURS * math.sqrt(len(ids))))
        self.index = BlockMaxIndex(known, idf)
        self.curve = None
        if len(set(labels)) == 2:
            votes = [self.vote(*x) for x in self.index.nearest(known, self.k, list(range(len(known))))]
            use = np.array([v is not None for v in votes])
            if len(set(self.labels[use])) == 2:
                self.curve = self.fit(np.array([v for v in votes if v is not None]), self.labels[use])

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float | None:
        if not len(near):
            return None
        w = 1 / (SOFTEN - np.minimum(cosine, 1.0))
        return float(w @ self.labels[near] / w.sum())

    @staticmethod
    def logit(vote):
        vote = np.clip(vote, 0.01, 0.99)
        return np.log(vote / (1 - vote))

    def fit(self, votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
        """Weighted logistic curve (slope, intercept) by Newton steps with a little shrinkage."""
        x = np.stack([self.logit(votes), np.ones(len(votes))], axis=1)
        weight = np.where(labels == 1, self.share / labels.mean(), (1 - self.share) / (1 - labels.mean()))
        at, ridge = np.array([1.0, 0.0]), np.diag([1e-2, 1e-4])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ at))
            slope = x.T @ (weight * (labels - p)) - ridge @ at
            bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
            step = np.linalg.solve(bend, slope)
            at = at + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-9:
                break
        return float(at[0]), float(at[1])

    def score(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        """(probability, evidence) of each text."""
        out = []
        for near, cosine in self.index.nearest(counted(texts), self.k):
            vote = self.vote(near, cosine)
            if vote is None or self.curve is None:
                out.append((self.share, []))
                continue
            p = 1 / (1 + math.exp(-(self.curve[0] * float(self.logit(vote)) + self.curve[1])))
            out.append((p, [{"doc_id": int(self.ids[i]), "cosine": float(c), "toxic": int(self.labels[i])} for i, c in zip(near[:EVIDENCE], cosine)]))
        return out


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from at most SAMPLE labelled documents outside the held-out fold; statistics over all documents."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out("doc_id", 4, 2))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("example")).agg(F.max("toxic").cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not shares:
        return None
    drawn = [usable.where(F.col("label") == c).orderBy(F.xxhash64("example"), "example").limit(n) for c, n in SAMPLE.items()]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # bounded by SAMPLE

    def count(batches):
        for whole in batches:
            for batch in portions(whole, 2, PORTION):
                found = counted(batch.column(2).to_pylist())
                packed = [pa.array([x[j].astype(np.int32).tobytes() for x in found], pa.binary()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["example", "label", "terms", "times"])

    rows = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("example")).groupBy("example", "label").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(count, "example long, label int, terms binary, times binary").toPandas().sort_values("example")
    if not len(found):
        return None
    total, df = frequencies(docs)
    known = [(np.frombuffer(t, np.int32).astype(np.int64), np.frombuffer(k, np.int32)) for t, k in zip(found["terms"], found["times"])]
    return Model(found["example"].tolist(), found["label"].tolist(), known, np.log1p(total / (1 + df)), shares.get(1, 0) / sum(shares.values()))


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents in all, and those that hold each slot: counted per task, summed in SHARES pieces as they arrive."""
    names, kinds, size = ["share", "counts", "n"], "share int, counts binary, n long", SLOTS // SHARES

    def shares(held: np.ndarray, n: int):
        return pa.RecordBatch.from_arrays([pa.array(range(SHARES), pa.int32()), pa.array([squeezed(x.tobytes()) for x in held.reshape(SHARES, size)], pa.binary()), pa.array([n] + [0] * (SHARES - 1), pa.int64())], names)

    def count(batches):
        held, n = np.zeros(SLOTS, np.int64), 0
        for whole in batches:
            for batch in portions(whole, 0, PORTION):
                n += len(batch)
                held += np.bincount(np.concatenate([t for t, _ in counted(batch.column(0).to_pylist())]), minlength=SLOTS)
        if n:
            yield shares(held, n)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        n = 0
        for batch in batches:
            n += sum(batch.column(2).to_pylist())
            for share, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[share] = held.get(share, 0) + np.frombuffer(restored(counts), np.int64)
        packed = [squeezed(x.tobytes()) for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary()), pa.array([n] * bool(held) + [0] * (len(held) - 1), pa.int64())], names)

    sums = docs.select(F.col("text").cast("string")).mapInArrow(count, kinds).repartitionById(SHARES, F.col("share")).mapInArrow(add, kinds)
    total, df = 0, np.zeros((SHARES, size), np.float64)
    for row in sums.collect():  # SLOTS numbers, however many documents
        total += row["n"]
        df[row["share"]] = np.frombuffer(restored(bytes(row["counts"])), np.int64)
    return total, df.ravel()


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with a column ``toxicity`` struct<score double, evidence array<struct<doc_id, cosine, toxic>>>."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(train(docs, labels)))  # bounded by SAMPLE

    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = cloudpickle.loads(held.value)
        for texts in parts:
            once = pa.RecordBatch.from_arrays([pa.array(list(dict.fromkeys(texts)), pa.string())], ["text"])
            known = {}
            for batch in portions(once, 0, PORTION):
                part = batch.column(0).to_pylist()
                known |= zip(part, model.score(part) if model else [(0.0, [])] * len(part))
            found = [known[t] for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in found], "evidence": [e for _, e in found]})

    kind = "score double, evidence array<struct<doc_id: long, cosine: double, toxic: int>>"
    return docs.withColumn("toxicity", F.pandas_udf(judge, kind)(F.col("text").cast("string")))


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every document."""
    out = scored(spark, docs.select("doc_id", "text"), labels)
    return out.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), F.col("toxicity.score").alias("score"), (F.col("toxicity.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.evidence").alias("evidence"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold."""
    return scored(spark, docs, read(spark, sf_dir, "labels")).where(F.col("toxicity.score") < THRESHOLD).select(docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
