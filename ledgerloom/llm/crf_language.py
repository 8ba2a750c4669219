"""Language of words and documents by a linear-chain conditional random field.

The words of a text are a chain whose labels are languages. A word's score for a language adds the
weights of its letter n-grams (one to three letters, with a mark at both ends), of its affixes (up to
three letters) and of the lexicon that holds it; learned transitions score pairs of neighbours. Forward-backward
gives each word's probability of each language, so a text that switches gets spans, and a document the language
with the greatest expected share of its words.

Learning takes a bounded sample: of each language PER_LANGUAGE documents at most, in the order of a hash of the
id, and of each a window of WINDOW letters at a hashed place. Half of the windows are cut into runs
of words that are dealt anew into chains, so that transitions learn to switch. What the driver holds
is that sample and its weights. Prediction takes whole texts: the chain is cut into blocks whose transfer matrices are
multiplied first, so a text of any length is exact while only a group of blocks is held as vectors.

Cases: a null text, and one without letters, is ``und`` with score 0, as is every text when nothing can be learnt;
with one learnt language every text with letters is that one; runs of more than 64 letters count as words of 64;
equal shares go to the language that sorts first; null languages and ids are not learnt from, a null
doc_id is held out; rows that repeat a doc_id are predicted each by their own text; an empty table gives no rows;
columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import is_held_out, read

PER_LANGUAGE = 200  # documents learnt from, of each language
WINDOW = 1200  # letters of each
SEEN_IN = 3  # documents a word of the lexicon occurs in, and distinct words an n-gram does
PURE = 0.8  # share of a lexicon word's documents that are of its language
RUN = 12  # mean words of a run of a switching chain
CHAIN = 60  # words of a chain learnt from
STEPS = 50
DECAY = 1e-4

BLOCK = 64  # words whose transfer matrix is multiplied at once
GROUP = 1 << 12  # blocks held as vectors at a time
HELD_WORDS = 1 << 18  # words gathered before they are labelled, and distinct words whose scores are kept
SCORED = 1 << 14  # words scored at a time
PIECE = 1 << 20  # letters split at a time

WORD = re.compile(r"[^\W\d_]{1,64}")
GAP = re.compile(r"[\W\d_]")
MARK, OTHER, BITS = 0, 1, 15


def words_of(text: str) -> Iterator[list[str]]:
    """The lower-case words of a text, a piece at a time."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


# --- features of words, all words of a call at once -----------------------------------------------
class Letters:
    """Numbers of the characters seen in learning; all others are one."""

    def __init__(self, seen: str):
        self.seen = seen

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, affixes, starts): three codes for every letter and mark, two for every word (-1: none), and where words begin."""
        if not hasattr(self, "table"):
            self.table = np.full(0x110000, OTHER, np.int64)
            self.table[np.frombuffer(self.seen.encode("utf-32-le"), np.uint32)] = np.arange(2, 2 + len(self.seen))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(sizes) - sizes
        line = np.full(int(sizes.sum()), MARK, np.int64)
        inner = np.ones(len(line), bool)
        inner[starts] = inner[starts + sizes - 1] = False
        line[inner] = self.table[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        left = np.repeat(starts + sizes, sizes) - np.arange(len(line))  # letters and marks from here to the word's end
        padded = np.concatenate([line, np.zeros(3, np.int64)])
        two = (padded[:-3] << BITS) | padded[1:-2]
        three = (two << BITS) | padded[2:-1]
        grams = np.stack([np.where(inner, line | 1 << 60, -1), np.where(left >= 2, two | 2 << 60, -1), np.where(left >= 3, three | 3 << 60, -1)])
        four = (three << BITS) | padded[3:]
        long = sizes >= 5
        affixes = np.stack([np.where(long, four[starts] | 4 << 60, -1), np.where(long, four[np.maximum(starts + sizes - 4, 0)] | 5 << 60, -1)])
        return grams, affixes, starts


class Model:
    """Weights of a chain over ``names``."""

    def __init__(self, names: list[str], letters: Letters, keys: np.ndarray, lexicon: dict[str, int]):
        n = len(names)
        self.names, self.letters, self.keys, self.lexicon = names, letters, keys, lexicon
        self.grams = np.zeros((len(keys) + 1, n))  # the last row is that of features not learnt
        self.entries = np.zeros((n + 1, n))  # by the lexicon that holds a word; the last row is that of no lexicon
        self.steps = np.zeros((n, n))
        self.first = np.zeros(n)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, codes)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == codes, at, len(self.keys)) if len(self.keys) else np.zeros_like(codes)

    def scores(self, words: list[str]) -> np.ndarray:
        """Score of every word for every language."""
        if not words:
            return np.zeros((0, len(self.names)))
        grams, affixes, starts = self.letters.codes(words)
        total = np.add.reduceat(sum(self.grams[self.rows(g)] for g in grams), starts)
        held = np.fromiter((self.lexicon.get(w, len(self.names)) for w in words), np.int64, len(words))
        return total + sum(self.grams[self.rows(a)] for a in affixes) + self.entries[held]


# --- forward-backward ----------------------------------------------------------------------------
class Chains:
    """Chains of words cut into blocks; ``posteriors`` yields probabilities for one group of blocks after the other."""

    def __init__(self, sizes: np.ndarray, first: np.ndarray, steps: np.ndarray):
        """``sizes``: words of each chain, none zero; ``first`` and ``steps``: log scores of a chain's first label and of neighbours."""
        self.first, self.steps = np.exp(first - first.max()), np.exp(steps - steps.max())
        begins = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        self.chain = np.repeat(np.arange(len(sizes)), blocks)
        self.number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.begin = begins[self.chain] + self.number * BLOCK
        self.size = np.minimum(sizes[self.chain] - self.number * BLOCK, BLOCK)
        self.blocks = blocks

    def groups(self) -> Iterator[np.ndarray]:
        """Blocks by number, the longest first, so that the blocks which have a t-th word are the first ones of a group."""
        for at in range(0, len(self.chain), GROUP):
            group = np.arange(at, min(at + GROUP, len(self.chain)))
            yield group[np.argsort(-self.size[group], kind="stable")]

    def transfer(self, e) -> np.ndarray:
        """The product of every block's steps, scaled."""
        n = len(self.first)
        out = np.empty((len(self.chain), n, n))
        for group in self.groups():
            p = np.broadcast_to(np.eye(n), (len(group), n, n)).copy()
            for t in range(int(self.size[group[0]])):
                m = int(np.count_nonzero(self.size[group] > t))
                now = (p[:m].reshape(-1, n) @ self.steps).reshape(m, n, n)
                if t == 0:
                    now[self.number[group] == 0] = self.first
                now *= e(self.begin[group[:m]] + t)[:, None, :]
                p[:m] = now / now.sum(axis=(1, 2), keepdims=True)
            out[group] = p
        return out

    def ends(self, e) -> tuple[np.ndarray, np.ndarray]:
        """What enters every block from its left, and from its right."""
        n = len(self.first)
        left, right = np.full((len(self.chain), n), 1 / n), np.full((len(self.chain), n), 1 / n)
        if len(self.chain) == len(self.blocks):
            return left, right
        p = self.transfer(e)
        at = np.cumsum(self.blocks) - self.blocks
        order = np.argsort(-self.blocks, kind="stable")
        for k in range(1, int(self.blocks.max())):
            here = at[order[: np.count_nonzero(self.blocks > k)]] + k
            v = np.einsum("ij,ijk->ik", left[here - 1], p[here - 1])
            left[here] = v / v.sum(axis=1, keepdims=True)
        for k in range(int(self.blocks.max()) - 1, 0, -1):
            here = at[order[: np.count_nonzero(self.blocks > k)]] + k
            v = np.einsum("ijk,ik->ij", p[here], right[here])
            right[here - 1] = v / v.sum(axis=1, keepdims=True)
        return left, right

    def posteriors(self, e, pairs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, probabilities) of words; ``e`` gives exponentiated scores of positions. ``pairs`` takes the expected number of each step, of chains of one block."""
        left, right = self.ends(e)
        for group in self.groups():
            longest, n = int(self.size[group[0]]), len(self.first)
            ahead = np.zeros((longest, len(group), n))
            held = [int(np.count_nonzero(self.size[group] > t)) for t in range(longest)]
            seen = [e(self.begin[group[:m]] + t) for t, m in enumerate(held)]
            now = left[group]
            for t, m in enumerate(held):
                now = now[:m] @ self.steps
                if t == 0:
                    now[self.number[group] == 0] = self.first
                now = now * seen[t]
                now /= now.sum(axis=1, keepdims=True)
                ahead[t, :m] = now
            back = right[group].copy()
            where, found = [], []
            for t in range(longest - 1, -1, -1):
                m = held[t]
                p = ahead[t, :m] * back[:m]
                where.append(self.begin[group[:m]] + t)
                found.append(p / p.sum(axis=1, keepdims=True))
                after = seen[t] * back[:m]
                if pairs is not None and t:
                    both = ahead[t - 1, :m, :, None] * self.steps * after[:, None, :]
                    pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                after = after @ self.steps.T
                back[:m] = after / after.sum(axis=1, keepdims=True)
            yield np.concatenate(where), np.concatenate(found)


# --- learning, on the sample -----------------------------------------------------------------------
def chains_of(texts: list[tuple[int, list[str]]], rng) -> list[tuple[list[int], list[str]]]:
    """(labels, words) of chains: even windows as they are, odd ones cut into runs and dealt anew."""
    runs, out = [], []
    for k, (label, words) in enumerate(texts):
        at = 0
        while at < len(words):
            size = CHAIN if k % 2 == 0 else int(rng.geometric(1 / RUN))
            (out if k % 2 == 0 else runs).append(([label] * len(words[at : at + size]), words[at : at + size]))
            at += size
    labels, words = [], []
    for k in rng.permutation(len(runs)).tolist():
        labels += runs[k][0]
        words += runs[k][1]
    return out + [(labels[at : at + CHAIN], words[at : at + CHAIN]) for at in range(0, len(words), CHAIN)]


def fit(sample: list[tuple[str, list[str]]]) -> Model | None:
    """Weights from (language, words) pairs, by ADAM steps on the chains' likelihood with weight decay."""
    sample = [(lang, words) for lang, words in sample if words]
    if not sample:
        return None
    names = sorted({lang for lang, _ in sample})
    number = {x: i for i, x in enumerate(names)}
    texts = [(number[lang], words) for lang, words in sample]
    held: dict[str, Counter] = defaultdict(Counter)
    for label, words in texts:
        for w in set(words):
            held[w][label] += 1
    lexicon = {w: c.most_common(1)[0][0] for w, c in held.items() if c.total() >= SEEN_IN and c.most_common(1)[0][1] >= PURE * c.total()}
    types = list(held)
    letters = Letters("".join(c for c, _ in Counter("".join(types)).most_common((1 << BITS) - 2)))
    grams, affixes, starts = letters.codes(types)
    owner = np.repeat(np.arange(len(types)), np.diff(np.append(starts, grams.shape[1])))
    codes, of = np.concatenate([*grams, *affixes]), np.concatenate([owner] * 3 + [np.arange(len(types))] * 2)
    codes, of = codes[codes >= 0], of[codes >= 0]
    keys, times = np.unique(codes, return_counts=True)
    model = Model(names, letters, keys[times >= SEEN_IN], lexicon)
    at = model.rows(codes)
    of, at = of[at < len(model.keys)], at[at < len(model.keys)]
    entry = np.fromiter((lexicon.get(w, len(names)) for w in types), np.int64, len(types))

    chains = chains_of(texts, np.random.default_rng(0))
    type_no = {w: i for i, w in enumerate(types)}
    line = np.fromiter((type_no[w] for _, words in chains for w in words), np.int64)
    truth = np.fromiter((x for labels, _ in chains for x in labels), np.int64)
    sizes = np.fromiter((len(words) for _, words in chains), np.int64)
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(line), bool)
    inside[begins] = False
    n = len(names)
    seen_pairs = np.zeros((n, n))
    np.add.at(seen_pairs, (truth[:-1][inside[1:]], truth[1:][inside[1:]]), 1)
    seen_first = np.bincount(truth[begins], minlength=n)

    weights = [model.grams[:-1], model.entries, model.steps, model.first]  # views and the arrays themselves
    mean, spread = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by = lambda where, what, size: np.stack([np.bincount(where, column, minlength=size) for column in np.ascontiguousarray(what.T)], axis=1)
    for step in range(1, STEPS + 1):
        scores = by(of, model.grams[at], len(types)) + model.entries[entry]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        pairs, off = np.zeros((n, n)), np.zeros((len(line), n))
        for where, p in Chains(sizes, model.first, model.steps).posteriors(lambda i: e[line[i]], pairs):
            off[where] = p
        first = off[begins].sum(axis=0)
        off[np.arange(len(line)), truth] -= 1
        of_type = by(line, off, len(types))
        found = [by(at, of_type[of], len(model.keys)), by(entry, of_type, n + 1), pairs - seen_pairs, first - seen_first]
        for w, g, m, v in zip(weights, found, mean, spread):
            g = g / len(line) + DECAY * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame) -> Model | None:
    """A model from the rows of ``docs(doc_id, text, lang)`` that are not held out."""
    lang, text, hash_ = F.col("lang").cast("string"), F.col("text").cast("string"), F.xxhash64("doc_id")
    rows = docs.select("doc_id", lang.alias("lang"), text.alias("text"), hash_.alias("hash")).where("doc_id is not null and lang is not null and text is not null")
    rows = rows.where(~is_held_out("doc_id", 4, 2))
    start = F.pmod(F.col("hash"), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    rows = rows.select("doc_id", "lang", "hash", F.substring("text", start, F.lit(WINDOW)).alias("text"))
    order = Window.partitionBy("lang").orderBy("hash", "doc_id", "text")
    drawn = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_LANGUAGE).select("lang", "doc_id", "text").toPandas()
    drawn = drawn.sort_values(["lang", "doc_id", "text"])
    letters = lambda w: any(map(str.isalpha, w))
    return fit([(lang, [w for piece in words_of(text) for w in piece if letters(w)]) for lang, text in zip(drawn["lang"], drawn["text"])])


# --- prediction --------------------------------------------------------------------------------------
LABELLED = "doc_id long, n_words long, shares array<double>, spans array<struct<lang:string,first:long,words:long>>"


class Labeller:
    """Labels documents in groups and keeps the scores of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.new: list[str] = []
        self.table, self.able = np.zeros((1024, len(self.model.names))), np.zeros(1024, bool)

    def numbers(self, text: str) -> np.ndarray:
        """Numbers of the words of a text; words not met before wait in ``new``."""
        parts = []
        for words in words_of(text):
            known = len(self.number)
            ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
            fresh = np.flatnonzero(ids >= known)
            self.new += [words[i] for i in fresh[np.unique(ids[fresh], return_index=True)[1]].tolist()]
            parts.append(ids)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def learn(self) -> None:
        """Scores the new words, all at once."""
        end = len(self.number)
        while end > len(self.able):
            self.table, self.able = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.able, np.zeros_like(self.able)])
        for at in range(0, len(self.new), SCORED):
            words = self.new[at : at + SCORED]
            here = slice(end - len(self.new) + at, end - len(self.new) + at + len(words))
            scores = self.model.scores(words)
            self.table[here] = np.exp(scores - scores.max(axis=1, keepdims=True))
            self.able[here] = [w.isalpha() or any(map(str.isalpha, w)) for w in words]
        self.new = []

    def label(self, docs: list, lines: list[np.ndarray]) -> pa.RecordBatch:
        """Rows of LABELLED of documents given by the numbers of their words."""
        self.learn()
        lines = [ids[self.able[ids]] for ids in lines]
        n, sizes = len(self.model.names), np.fromiter(map(len, lines), np.int64, len(lines))
        line = np.concatenate(lines)
        shares, best = np.zeros((len(lines), n)), np.zeros(len(line), np.int8 if n < 128 else np.int32)
        if len(line):
            chain = np.repeat(np.arange(len(lines)), sizes)
            chains = Chains(sizes[sizes > 0], self.model.first, self.model.steps)
            for where, p in chains.posteriors(lambda i: self.table[line[i]]):
                best[where] = p.argmax(axis=1)
                for k in range(n):
                    shares[:, k] += np.bincount(chain[where], p[:, k], minlength=len(lines))
            turns = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (chain[1:] != chain[:-1])]))
            begins = (np.cumsum(sizes) - sizes)[chain[turns]]
            of = np.bincount(chain[turns], minlength=len(lines))
            lengths = np.diff(np.append(turns, len(line)))
        else:
            turns = begins = lengths = np.zeros(0, np.int64)
            of = np.zeros(len(lines), np.int64)
        names = pa.array(self.model.names, pa.string())
        span = pa.StructArray.from_arrays([names.take(pa.array(best[turns].astype(np.int64))), pa.array(turns - begins), pa.array(lengths)], ["lang", "first", "words"])
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of)), pa.int32()), span)
        shares = shares / np.maximum(sizes, 1)[:, None]
        cells = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(lines) + 1, n), pa.int32()), pa.array(shares.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes), cells, spans], ["doc_id", "n_words", "shares", "spans"])


def labelled(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, shares, spans) of every document: expected share of each of ``model.names``, and runs of words of one likeliest language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, ids, lines, held = Labeller(model), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                ids.append(doc.as_py())
                lines.append(labeller.numbers(text.as_py() or ""))
                held += len(lines[-1])
                if held >= HELD_WORDS or len(lines) >= HELD_WORDS:
                    yield labeller.label(ids, lines)
                    ids, lines, held = [], [], 0
                    if len(labeller.number) > HELD_WORDS:
                        labeller.reset()
        if lines:
            yield labeller.label(ids, lines)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LABELLED)


def languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, and the ``spans`` of its words."""
    model = train(docs)
    if model is None:
        none = F.lit(None).cast("array<struct<lang:string,first:long,words:long>>")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out("doc_id", 4, 2).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("spans"))
    out = labelled(docs, model)
    score = F.array_max("shares")
    name = F.element_at(F.array(*[F.lit(x) for x in model.names]), F.array_position("shares", score).cast("int"))
    found = F.col("n_words") > 0
    return out.select("doc_id", is_held_out("doc_id", 4, 2).alias("held_out"), F.when(found, name).otherwise("und").alias("lang_pred"), F.when(found, F.least(score, F.lit(1.0))).otherwise(0.0).alias("score"), "spans")


def op11_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(spark, read(spark, sf_dir, "documents")).drop("spans")
