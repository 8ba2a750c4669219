"""Repeated byte strings through prefix-free parsing.

Every match-long window of a text names a trigger: the first smallest rolling hash among its grams.
A phrase is a run of windows with the same trigger, so phrases overlap by one byte less than a match,
every window lies in exactly one phrase, and equal windows name the same trigger wherever they stand
(triggers by remainder leave stretches without any, hence the minimum). The corpus then is

* the parse: each document as its sequence of phrase ids, a hash of the phrase beside its trigger's;
* the dictionary: the distinct phrases.

The parse is shuffled first, by trigger. A phrase that a smaller document's parse holds is lost as a
whole, without a look at its bytes. A distinct phrase can lose single bytes only if another phrase has
its trigger: only such phrases send their text, once each, with the smallest document of the parse.
Their suffixes of match length and more are sorted; with the documents of the parse this gives corpus
order, and in each run of suffixes that agree over the match length all documents but the smallest
lose those bytes. Texts are shuffled twice, to look up dictionary phrases and to be cut; highly
repetitive text costs one dictionary entry per distinct phrase, however often it repeats.

All steps are partition functions between shuffles of packed arrays; a batch sends a phrase once
however often it holds it. Phrases count as equal if 80 bits of hash are, besides the bucket.

Cases: a null text is an empty one; texts shorter than the match lose nothing; a null doc_id is
neither smaller nor larger than another and loses nothing; rows that share a doc_id do not remove
each other's bytes but are each judged against smaller ids; identical rows get the same result;
an empty table gives no rows; extra columns are ignored, and kept by the pipeline stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, shuffle_width
from .packed import PACKED, TEXTS, by_bucket, from_bytes, from_low_bytes, joined, low_bytes, pack, portions, received, rows, send_texts, spread, unpack

MATCH = 50
GRAM = 16
GRAMS = MATCH - GRAM + 1  # in a window
PHRASE = MATCH + GRAMS - 1  # bytes of a phrase at most: a trigger stays in so many windows
PIECE_BITS = 20
PIECE = 1 << PIECE_BITS  # bytes parsed at a time
WINDOWS = 1 << 22  # suffixes sorted at a time
GRAM_BYTES, PHRASE_BYTES = 4, 6  # of the hashes sent
PARSE, COVERED, ASKED, ENTRIES, SPANS = range(TEXTS + 2, TEXTS + 7)
BASE = 0xD6E8FEB86659FD93


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    size = 1
    while size < n:
        step = np.uint64(pow(base, size, 1 << 64))
        out[size : 2 * size] = out[: min(size, n - size)] * step
        size *= 2
    return out


class Hashes:
    """Hash of any stretch of a piece in constant time, from sums of byte codes times powers of a base."""

    codes = np.random.default_rng(50).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    up = down = np.empty(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Hashes.up) <= len(data):  # powers are made once in a worker
            n = max(PIECE, len(data)) + 1
            Hashes.up, Hashes.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(np.uint64)
        return mixed(x)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


# --- parsing -----------------------------------------------------------------------------------
def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram at every position of a byte array."""
    m = len(data) - GRAM + 1
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += words[GRAM - 8 : GRAM - 8 + m]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def phrases(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, trigger's hash) of the phrases of texts laid end to end; ``starts`` has their places and the end."""
    if len(data) < MATCH:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(data)
    place = np.uint64(PIECE * 2 - 1)
    least = sliding_least((h & ~place) | np.arange(len(h), dtype=np.uint64), GRAMS)  # ties go to the first
    trigger = (least & place).astype(np.int64)
    inside = np.ones(len(trigger), bool)
    for at in starts[1:-1].tolist():  # windows across two texts
        inside[max(at - MATCH + 1, 0) : at] = False
    new = inside.copy()
    new[1:] &= (trigger[1:] != trigger[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (trigger[1:] != trigger[:-1]) | ~inside[1:]
    first = np.flatnonzero(new)
    return first, np.flatnonzero(last) + MATCH, h[trigger[first]]


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, text of each start, offset in it) of at most PIECE bytes; long texts overlap by a match."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - MATCH + 1, 0), PIECE):
            part = text[at : at + PIECE + MATCH - 1]
            if size + len(part) > PIECE and held:
                yield laid(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield laid(held)


def laid(held: list[tuple[int, int, bytes]]):
    doc, offset, parts = zip(*held)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return np.frombuffer(b"".join(parts), np.uint8), starts, np.array(doc), np.array(offset)


def parse(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(trigger, phrase, text, first byte, length) of all phrases of the texts, in their order."""
    out = []
    for data, starts, of, offset in pieces(texts):
        first, end, trigger = phrases(data, starts)
        name = Hashes(data).of(first, end)
        piece = np.searchsorted(starts, first, side="right") - 1
        out.append([mixed(trigger), name, of[piece], first - starts[piece] + offset[piece], end - first])
    return tuple(joined(out, "<u8", "<u8", "<i8", "<i8", "<i8"))


def as_bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() if not isinstance(t, bytes) else t for t in column.to_pylist()]


def low(x: np.ndarray, n: int) -> np.ndarray:
    return x & np.uint64((1 << 8 * n) - 1)


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


# --- partition functions -----------------------------------------------------------------------
def send_parse(width: int):
    """Documents to their phrase ids by trigger; of a phrase that a batch repeats only the smallest document goes on."""

    def run(batches):
        for whole in batches:
            for batch in portions(whole, 1):
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                trigger, name, text, start, size = parse(as_bytes(batch.column(1)))
                if not len(text):
                    continue
                doc, out = ids[text], []
                key = low(trigger, GRAM_BYTES) ^ name  # both at once: one sort
                order = np.lexsort((doc, key))
                head = order[np.flatnonzero(runs_of(key[order]))]
                least = np.empty(len(doc), np.int64)
                least[order] = doc[np.repeat(head, np.diff(np.append(np.flatnonzero(runs_of(key[order])), len(order))))]
                lost = doc > least
                out += flags(COVERED, width, 0, doc[lost], start[lost], size[lost], name[lost])
                at = np.flatnonzero(~lost)
                bucket = ((trigger[at] >> np.uint64(40)) % np.uint64(width)).astype(np.int64)
                for b, i in by_bucket(bucket, width):
                    i = at[i]
                    columns = [low_bytes(trigger[i], GRAM_BYTES), low_bytes(name[i], PHRASE_BYTES), np.diff(doc[i], prepend=0), low_bytes(start[i], 4), size[i].astype(np.uint8)]
                    out.append((b, PARSE, pack(*columns)))
                yield rows(out)

    return run


def flags(kind: int, width: int, bucket: int, doc: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray) -> list[tuple[int, int, bytes]]:
    """What is decided on phrases, for the bucket of their document; ``bucket`` is where an asked phrase is to be sent."""
    order = np.lexsort((start, doc))
    doc, start, size, name = doc[order], start[order], size[order], name[order]
    home = np.array([bucket], np.int64)
    check = low(name, 4).astype(np.uint32)
    return [(b, kind, pack(home, np.diff(doc[i], prepend=0), start[i].astype(np.int32), size[i].astype(np.uint8), check[i])) for b, i in by_bucket(spread(doc, width), width)]


def judge_parse(width: int):
    """Phrase ids of a share of the triggers to the phrases that a smaller document has, and the phrases to be looked up."""

    def run(batches):
        parts, home, out = [], 0, []
        for batch in batches:
            for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == PARSE:
                    trigger, name, step, start, size = unpack(blob, "u1", "u1", "<i8", "u1", "u1")
                    parts.append([from_low_bytes(trigger, GRAM_BYTES), from_low_bytes(name, PHRASE_BYTES), np.cumsum(step), from_low_bytes(start, 4).astype(np.int32), size])
                    home = bucket
                else:  # decided in its batch
                    doc = unpack(blob, "<i8", "<i8", "<i4", "u1", "<u4")[1]
                    out.append((int(spread(doc[:1], width)[0]), kind, blob))
        yield rows(out)
        if not parts:
            return
        trigger, name, doc, start, size = joined(parts, "<u8", "<u8", "<i8", "<i4", "u1")
        del parts
        order = np.argsort(trigger, kind="stable")
        same = trigger[order][1:] == trigger[order][:-1]
        several = np.zeros(len(order), bool)
        several[order[1:][same]] = True
        several[order[:-1][same]] = True
        trigger, name, doc, start, size = (x[several] for x in (trigger, name, doc, start, size))
        if not len(trigger):
            return
        order = np.lexsort((doc, name, trigger))
        trigger, name, doc, start, size = (x[order] for x in (trigger, name, doc, start, size))
        group = runs_of(trigger)
        which = np.cumsum(group) - 1
        begins = np.flatnonzero(group)
        phrase = runs_of(trigger, name)
        first = doc[np.flatnonzero(phrase)[np.cumsum(phrase) - 1]]
        other = (np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)) & (np.add.reduceat(phrase.astype(np.int64), begins) > 1)
        lost = doc > first
        asked = ~lost & other[which]
        yield rows(flags(COVERED, width, 0, doc[lost], start[lost], size[lost], name[lost]))
        yield rows(flags(ASKED, width, home, doc[asked], start[asked], size[asked], name[asked]))

    return run


def text_hashes(texts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)


def look_up(width: int):
    """Texts and flags of the same documents to dictionary entries and spans."""

    def run(batches):
        texts: list[bytes] = []
        ids, found = [], {COVERED: [], ASKED: []}
        for kind, blob in received(batches):
            if kind == TEXTS:
                batch = from_bytes(blob)
                held = [(i, t) for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))) if i is not None]
                ids += [i for i, _ in held]
                texts += [t for _, t in held]
            else:
                home, step, start, size, check = unpack(blob, "<i8", "<i8", "<i4", "u1", "<u4")
                found[kind].append([np.full(len(step), home[0]), np.cumsum(step), start, size, check])
        if not ids:
            return
        doc, th = np.array(ids, np.int64), text_hashes(texts)
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(length) - length
        data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(PHRASE, np.uint8)])
        del texts
        order = np.argsort(doc, kind="stable")
        shared = bool((np.diff(doc[order]) == 0).any())

        def located(kind: int):
            home, of, start, size, check = joined(found[kind], "<i8", "<i8", "<i4", "u1", "<u4")
            lo, hi = np.searchsorted(doc[order], of, "left"), np.searchsorted(doc[order], of, "right")
            n = hi - lo
            row = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            home, start, size, check = (np.repeat(x, n) for x in (home, start.astype(np.int64), size.astype(np.int64), check))
            if shared:  # of rows that share an id only the one with this phrase is meant
                fits = start + size <= length[row]
                row, home, start, size, check = (x[fits] for x in (row, home, start, size, check))
                same = np.array([low(Hashes(data[a : a + s]).of(np.array([0]), np.array([s])), 4)[0] == c for a, s, c in zip((begin[row] + start).tolist(), size.tolist(), check.tolist())], bool)
                row, home, start, size = (x[same] for x in (row, home, start, size))
            return row, home, start, size

        row, _, start, size = located(COVERED)
        if len(row):
            yield rows(spans(width, doc, th, *merged(row, start, start + size)))
        row, home, start, size = located(ASKED)
        for at in range(0, len(row), 1 << 18):
            r, h, s, n = (x[at : at + (1 << 18)] for x in (row, home, start, size))
            out = []
            for b, i in by_bucket(h, width):
                entry = data[(begin[r[i]] + s[i])[:, None] + np.arange(PHRASE)]
                entry[np.arange(PHRASE) >= n[i][:, None]] = 0
                out.append((b, ENTRIES, pack(entry, n[i].astype(np.uint8), np.diff(doc[r[i]], prepend=0), th[r[i]], s[i].astype(np.int32))))
            yield rows(out)

    return run


def spans(width: int, doc: np.ndarray, th: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    d, t = doc[row], th[row]
    return [(b, SPANS, pack(np.diff(d[i], prepend=0), t[i], start[i], end[i])) for b, i in by_bucket(spread(d, width), width)]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the spans of each document, touching spans joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    base = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * np.int64(1 << 40)
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], (base + start)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], start[first], (reach - base)[last]


def suffix_runs(entry: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entry, place) of the dictionary suffixes whose first MATCH bytes a smaller document has.

    Suffixes are sorted a share of their hashes at a time, first by hash and, where hashes repeat, by
    their bytes and the document the parse gives.
    """
    count = size - MATCH + 1
    which = np.repeat(np.arange(len(entry)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    up, down = powers(BASE, PHRASE), powers(pow(BASE, -1, 1 << 64), PHRASE)
    key, edges = np.empty(len(which), np.uint64), np.concatenate([[0], np.cumsum(count)])
    for at in range(0, len(entry), 1 << 16):
        part = entry[at : at + (1 << 16)]
        total = np.zeros((len(part), PHRASE + 1), np.uint64)
        np.cumsum(Hashes.codes[part] * up, axis=1, out=total[:, 1:])
        mine = slice(edges[at], edges[at + len(part)])
        w, p = which[mine] - at, place[mine]
        key[mine] = mixed((total[w, p + MATCH] - total[w, p]) * down[p])
    shares = -(-len(key) // WINDOWS)
    share = key % np.uint64(max(shares, 1))
    for s in range(shares):
        mine = np.flatnonzero(share == s)
        order = mine[np.argsort(key[mine], kind="stable")]
        same = key[order][1:] == key[order][:-1]
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        order = order[several]
        if not len(order):
            continue
        w, p = which[order], place[order]
        suffix = np.zeros((len(w), -(-MATCH // 8) * 8), np.uint8)
        suffix[:, :MATCH] = entry[w[:, None], p[:, None] + np.arange(MATCH)]
        words = suffix.view(">u8").astype(np.uint64)
        by = np.lexsort((doc[w], *(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), key[order]))
        words, w, p = words[by], w[by], p[by]
        new = runs_of(*words.T)
        least = doc[w][np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = doc[w] > least
        yield w[hit], p[hit]


def judge_dictionary(width: int):
    """Dictionary entries of a share of the triggers to the spans that smaller documents hold; spans already known pass."""

    def run(batches):
        parts, out = [], []
        for kind, blob in received(batches):
            if kind == SPANS:
                doc = unpack(blob, "<i8", "<i8", "<i8", "<i8")[0]
                out.append((int(spread(doc[:1], width)[0]), SPANS, blob))
            else:
                e, n, step, th, start = unpack(blob, "u1", "u1", "<i8", "<i8", "<i4")
                parts.append([e.reshape(-1, PHRASE), n.astype(np.int64), np.cumsum(step), th, start.astype(np.int64)])
        yield rows(out)
        if not parts:
            return
        entry, size, doc, th, start = (np.concatenate([p[i] for p in parts]) for i in range(5))
        found = list(suffix_runs(entry, size, doc))
        if found:
            which, place = (np.concatenate(x) for x in zip(*found))
            which, first, end = merged(which, place, place + MATCH)
            yield rows(spans(width, doc, th, which, start[which] + first, start[which] + end))

    return run


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut(names: list[str], whole_characters: bool):
    """Texts and spans of the same documents to their rows with what stays of the text, and the runs that went."""

    def run(batches):
        blobs, parts = [], []
        for kind, blob in received(batches):
            if kind == SPANS:
                step, *rest = unpack(blob, "<i8", "<i8", "<i8", "<i8")
                parts.append([np.cumsum(step), *rest])
            else:
                blobs.append(blob)
        doc, th, start, end = joined(parts, "<i8", "<i8", "<i8", "<i8")
        order = np.lexsort((th, doc))
        doc, th, start, end = doc[order], th[order], start[order], end[order]
        edges = [*np.flatnonzero(runs_of(doc, th)).tolist(), len(doc)]
        place = {(int(doc[a]), int(th[a])): (a, b) for a, b in zip(edges, edges[1:])}
        for blob in blobs:
            batch = from_bytes(blob)
            texts = as_bytes(batch.column(1))
            kept, runs = [], []
            for i, h, text in zip(batch.column(0).to_pylist(), text_hashes(texts).tolist(), texts):
                if (i, h) in place:
                    a, b = place[i, h]
                    _, first, last = merged(np.zeros(b - a, np.int64), start[a:b], end[a:b])
                    first, last = first.tolist(), last.tolist()
                    text = b"".join([text[x:y] for x, y in zip([0, *last], [*first, len(text)])])
                    text = text.decode(errors="ignore").encode() if whole_characters else text
                    runs.append([{"start": x, "end": y} for x, y in zip(first, last)])
                else:
                    runs.append([])
                kept.append(text)
            columns = [batch.column(0), *batch.columns[2:], pa.array(kept, pa.binary()), pa.array(runs, RUNS)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


# --- the operator ------------------------------------------------------------------------------
def dedup(spark: SparkSession, docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """``docs`` with all its columns but the text, and what stays of the text: kept binary, runs array<struct<start, end>>.

    Ids come as longs. ``whole_characters`` drops the bytes of characters that a cut splits as well.
    """
    width = shuffle_width(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    source = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *others)
    named = source.where("doc_id is not null").select("doc_id", "text")

    parsed = named.where(F.octet_length("text") >= MATCH).mapInArrow(send_parse(width), PACKED)
    decided = parsed.repartitionById(width, F.col("bucket")).mapInArrow(judge_parse(width), PACKED)
    texts = named.mapInArrow(send_texts(width), PACKED)
    entries = texts.unionByName(decided).repartitionById(width, F.col("bucket")).mapInArrow(look_up(width), PACKED)
    spans = entries.repartitionById(width, F.col("bucket")).mapInArrow(judge_dictionary(width), PACKED)
    both = source.mapInArrow(send_texts(width), PACKED).unionByName(spans).repartitionById(width, F.col("bucket"))
    runs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(source.schema[c] for c in others), T.StructField("kept", T.BinaryType()), T.StructField("runs", runs)])
    return both.mapInArrow(cut(["doc_id", *others, "kept", "runs"], whole_characters), schema)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that earlier ones hold; characters that a cut splits go, and so do emptied documents.

    Null and empty texts stay as they are, and so do documents without a doc_id.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # clash with nothing
    plain = docs.select("doc_id", "text", *(F.col(c).alias(n) for c, n in inner.items()), F.col("text").isNull().alias("no_text"))
    out = dedup(spark, plain, whole_characters=True).where("size(runs) = 0 or kept <> X''")
    text = F.when(~F.col("no_text"), F.decode("kept", "UTF-8"))
    found = {c: F.col(n) for c, n in inner.items()} | {"doc_id": F.col("doc_id"), "text": text}
    return out.select(*(found[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    out = dedup(spark, read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
