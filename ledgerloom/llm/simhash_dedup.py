"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are cut into ranges of equal size along their Gray rank, where neighbours share long
bit patterns. The ranges are the top level of the index: for each, the bits all members share are
kept as a (mask, pattern) pair. A fingerprint visits a range only if the differences its pattern
already forces stay within the threshold. Inside a range, one task builds the lower levels the
same way, each node holding only the shared bits its ancestors do not hold, and walks them with
accumulated differences, so whole groups fall away at once. Ranges hold distinct fingerprints, so
any number of copies weighs as much as one document.

``simhash_groups`` links documents by their fingerprints alone. The pipeline stage asks for a Jaccard
similarity of SIMILAR over sets of five-word shingles and uses the index to find candidates: its
fingerprints are of distinct single words, and every document leaves its UNSURE bits with the least
majority out of the comparison, as near copies differ in those. Rows carry a min-hash sketch of the
shingles; a task gives a spanning forest of the pairs that the sketch finds alike, the most alike
first, and its edges are verified by the shingles themselves before they link. Where one fails, the task
searches again among the parts that are still apart, until no pair between two parts is unverified.

Cases: a null or empty text has no words and fingerprint zero, which links like any other; a null
doc_id gets its fingerprint and the component of that fingerprint, but is never a component's
name; rows that repeat a doc_id are each returned; an empty table gives no rows; extra columns
are ignored. The stage keeps documents without a doc_id, and judges rows that share one by their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, read, shuffle_width
from .packed import PACKED, by_bucket, from_bytes, pack, portions, received, rows, send_texts, spread, unpack

RANGES = 256  # top-level nodes at least; one more for every RANGE_SIZE fingerprints beyond that
RANGE_SIZE = 65536
CHUNKS = 4  # tasks that share one range's visitors
FANOUT = 16
WIDTH = 3
SEED = 42
SIGN = -(1 << 63)
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)
STAGE_WIDTH = 5
SIMILAR = 0.8  # of the sets of word shingles, in the stage
UNSURE, SURE_DISTANCE = 20, 1
SKETCH = 64  # least hashes of the shingles
DOUBT = 0.15  # sketches may fall short of the similarity by so much: three deviations
LAYERS, HELD = 32, 1 << 21  # forests that a task gives in one round at most, and pairs it holds before it thins them out
MIXERS = np.random.default_rng(5).integers(0, 1 << 63, (2, SKETCH), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64-bit SimHash of a text's word shingles, ASCII lower-cased; zero without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    if len(words) < width:
        shingles = [words]
    else:
        shingles = zip(*(words[i:] for i in range(width)))
    hashes = b"".join([digest(join(s), SEED) for s in shingles])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 20):
        part = bits[at : at + (1 << 20)]
        ones += (np.ones(len(part), np.float32) @ part.astype(np.float32)).astype(np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            known: dict[str | None, int] = {}
            out = []
            for text in batch.column(1).to_pylist():
                fp = known.get(text)
                if fp is None:
                    fp = known[text] = fingerprint(text)
                out.append(fp)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected Gray order."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(fp):
    """The same rank as a Spark column, sign bit flipped so that longs sort as unsigned numbers."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(SIGN))


class GrayIndex:
    """Levels of (own mask, pattern) over Gray-sorted fingerprints; level 0 is the leaves' parents."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        low = high = self.fps
        shared = []
        while len(low) > 1 or not shared:
            starts = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            shared.append((~(low ^ high), low))
        self.levels = []
        for k, (mask, pattern) in enumerate(shared):
            if k + 1 < len(shared):
                mask = mask & ~np.repeat(shared[k + 1][0], FANOUT)[: len(mask)]
            self.levels.append((mask, pattern))

    def search(self, queries: np.ndarray, distance: int, sure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, member position) at most ``distance`` bits apart; ``sure`` are the bits of each query that count."""
        sure = np.full(len(queries), ALL_BITS) if sure is None else sure
        who = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        gone = np.zeros(len(queries), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[k]
            gone = gone + np.bitwise_count((queries[who] ^ pattern[node]) & mask[node] & sure[who])
            near = gone <= distance
            who, node, gone = who[near], node[near], gone[near]
            below = len(self.levels[k - 1][0]) if k else len(self.fps)
            child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            who, gone = np.repeat(who, FANOUT), np.repeat(gone, FANOUT)
            real = child < below
            who, node, gone = who[real], child[real], gone[real]
        near = np.bitwise_count((queries[who] ^ self.fps[node]) & sure[who]) <= distance
        return who[near], self.order[node[near]]


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as the given pairs, as one edge from each node to its group's smallest node."""
    nodes, flat = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = flat[: len(left)], flat[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Ranges:
    """The top level of the index: cuts along the Gray rank and the bits that each range shares."""

    def __init__(self, distinct: DataFrame):
        total = distinct.count()
        count = max(RANGES, -(-total // RANGE_SIZE))
        rank = gray_rank_column(F.col("fp"))
        cuts = distinct.agg(F.percentile_approx(rank, [i / count for i in range(1, count)], 100 * count)).first()[0] or []
        self.bounds = np.unique(np.array(cuts, np.int64))

        def placed(batches):
            for batch in batches:
                fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(self.place(fps).astype(np.int32)), batch.column(0)], ["range", "fp"])

        held = distinct.select("fp").mapInArrow(placed, "range int, fp long").groupBy("range").agg(F.bit_and("fp").alias("low"), F.bit_or("fp").alias("high")).collect()
        self.n = len(self.bounds) + 1
        low, high = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.real = np.zeros(self.n, bool)
        for row in held:
            low[row["range"]], high[row["range"]], self.real[row["range"]] = row["low"], row["high"], True
        self.pattern, self.mask = low.view(np.uint64), (~(low ^ high)).view(np.uint64)

    def place(self, fps: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, (gray_rank(fps) ^ np.uint64(1 << 63)).view(np.int64), side="right")

    def visits(self, fps: np.ndarray, sure: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, range) of the ranges besides its own that each fingerprint visits; one of two ranges visits the other."""
        own, rows, ranges = self.place(fps), [], []
        for at in range(0, len(fps), 2048):
            part = slice(at, at + 2048)
            near = np.bitwise_count((fps[part, None] ^ self.pattern) & self.mask & sure[part, None]) <= distance
            step = (np.arange(self.n) - own[part, None]) % self.n
            near &= self.real & (step > 0) & ((2 * step < self.n) | ((2 * step == self.n) & (own[part, None] * 2 < self.n)))
            who, to = np.nonzero(near)
            rows.append(who + at)
            ranges.append(to)
        return np.concatenate(rows) if rows else np.empty(0, np.int64), np.concatenate(ranges) if ranges else np.empty(0, np.int64)


def dealt(table: DataFrame, ranges: Ranges, distance: int) -> DataFrame:
    """Rows (fp, node, ...) of a table, with a column ``sure`` or all bits sure, as members and visitors of ranges and chunks."""
    names = table.columns

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            nodes = batch.column(1).to_numpy(zero_copy_only=False)
            sure = batch.column(names.index("sure")).to_numpy(zero_copy_only=False).view(np.uint64) if "sure" in names else np.full(len(fps), ALL_BITS)
            everyone, chunk, own = np.arange(len(fps)), (nodes % CHUNKS).astype(np.int32), ranges.place(fps)
            for c in range(CHUNKS):  # members go to each chunk of their range
                yield out(batch, everyone, own, np.full(len(fps), c, np.int32), True)
            who, to = ranges.visits(fps, sure, distance)
            yield out(batch, who, to, chunk[who], False)

    def out(batch, who, to, chunk, member):
        columns = batch.take(pa.array(who)).columns
        return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(chunk), pa.array(np.full(len(who), member)), *columns], ["range", "chunk", "member", *names])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(deal, f"range int, chunk int, member boolean, {kinds}")


def found_pairs(key, table, distance: int, sure: np.ndarray | None = None):
    """(row, row) of the pairs within the distance in one chunk of a range, a block of queries at a time."""
    member = table.column("member").to_numpy()
    fps, nodes = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy()
    if not member.any():
        return
    held = np.flatnonzero(member)
    index = GrayIndex(fps[held])
    inside = member & (nodes % CHUNKS == key[1].as_py())
    for asked in (np.flatnonzero(~member), np.flatnonzero(inside)):
        for at in range(0, len(asked), 2048):
            q = asked[at : at + 2048]
            a, b = index.search(fps[q], distance, None if sure is None else sure[q])
            a, b = q[a], held[b]
            yield a[nodes[a] != nodes[b]], b[nodes[a] != nodes[b]]


def links(scratch: Scratch, distinct: DataFrame, distance: int) -> DataFrame:
    """Edges (src, dst) that connect nodes of ``distinct(fp, node)`` as all links within ``distance`` do."""

    def search(key, table):
        nodes = table.column("node").to_numpy()
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b in found_pairs(key, table, distance):
            a, b = forest(nodes[a], nodes[b])
            src.append(a)
            dst.append(b)
        a, b = forest(np.concatenate(src), np.concatenate(dst))
        return pa.table({"src": pa.array(a), "dst": pa.array(b)})

    return dealt(distinct, Ranges(distinct), distance).groupBy("range", "chunk").applyInArrow(search, "src long, dst long")


def simhash_groups(spark: SparkSession, docs: DataFrame, distance: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs))
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"))
    found = components(scratch, links(scratch, distinct, distance))
    named = distinct.join(found, distinct.node == found.id, "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- the stage: five-word shingles, verified -----------------------------------------------------
def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Distinct 32-bit hashes of the shingles, sorted; fewer words than a shingle are one shingle, none are none."""
    import xxhash

    if not words:
        return np.empty(0, np.uint32)
    shingles = zip(*(words[i:] for i in range(STAGE_WIDTH))) if len(words) >= STAGE_WIDTH else [words]
    join, digest = b" ".join, xxhash.xxh3_64_digest
    return np.unique(np.frombuffer(b"".join([digest(join(s))[:4] for s in shingles]), "<u4"))


def word_print(words: list[bytes]) -> tuple[int, int]:
    """(fingerprint of the distinct words, the bits that are sure)."""
    import xxhash

    distinct = set(words)
    if not distinct:
        return 0, int(ALL_BITS)
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, distinct)), np.uint8).reshape(-1, 8), axis=1)
    lead = 2 * bits.sum(axis=0, dtype=np.int64) - len(bits)
    sure = np.ones(64, bool)
    sure[np.argsort(np.abs(lead), kind="stable")[:UNSURE]] = False
    return int.from_bytes(np.packbits(lead > 0).tobytes(), "big"), int.from_bytes(np.packbits(sure).tobytes(), "big")


def sketch(shingles: np.ndarray) -> bytes:
    """Low bytes of the least hashes of the shingles under SKETCH mixers."""
    least = np.full(SKETCH, ALL_BITS)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096].astype(np.uint64)[:, None] * MIXERS[0] + MIXERS[1]
        least = np.minimum(least, (part >> np.uint64(20)).min(axis=0))
    return ((least ^ least >> np.uint64(16)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def stage_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, class1, class2, fp, sure, sketch): classes hold the texts with the same words, th hashes the text itself."""
    import xxhash

    def run(batches):
        for whole in batches:
            for batch in portions(whole, 2):
                known: dict[str | None, tuple] = {}
                for text in batch.column(2).to_pylist():
                    if text not in known:
                        words = (text or "").encode().lower().split()
                        name = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8").tolist()
                        known[text] = (*name, *word_print(words), sketch(shingle_hashes(words)))
                found = list(zip(*[known[t] for t in batch.column(2).to_pylist()]))
                prints = [pa.array(np.array(found[k], np.uint64).view(np.int64)) for k in (2, 3)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), *prints, pa.array(found[4], pa.binary())], ["doc_id", "th", "class1", "class2", "fp", "sure", "sketch"])

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_key("text").alias("th"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, th long, class1 long, class2 long, fp long, sure long, sketch binary")


def text_key(column: str):
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


def spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the pairs that make a forest of greatest weight."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.lexsort((b, a, -weight))
    x, y = flat[: len(a)][order], flat[len(a) :][order]
    label, kept = np.arange(len(nodes)), []
    rank = np.arange(len(order))
    while len(rank):
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, label[x[rank]], rank)
        np.minimum.at(best, label[y[rank]], rank)
        take = np.unique(best[best < len(order)])
        kept.append(take)
        while True:  # parts that the chosen pairs join take the smallest name
            low = np.minimum(label[x[take]], label[y[take]])
            new = np.arange(len(nodes))
            np.minimum.at(new, label[x[take]], low)
            np.minimum.at(new, label[y[take]], low)
            new = new[label]
            if np.array_equal(new, label):
                break
            label = new
        rank = rank[label[x[rank]] != label[y[rank]]]
    return order[np.concatenate(kept)] if kept else np.empty(0, np.int64)


def layered(a: np.ndarray, b: np.ndarray, weight: np.ndarray, layers: int) -> np.ndarray:
    """Positions of the pairs in the first so many forests of greatest weight, each of the pairs that the ones before left."""
    left, kept = np.arange(len(a)), [np.empty(0, np.int64)]
    for _ in range(layers):
        if not len(left):
            break
        take = left[spanning(a[left], b[left], weight[left])]
        kept.append(take)
        left = np.setdiff1d(left, take, assume_unique=True)
    return np.concatenate(kept)


def candidates(members: DataFrame, asked: DataFrame, layers: int) -> DataFrame:
    """Pairs (range, chunk, src, dst, more) to verify: per task some forests of the pairs of different parts whose sketches are alike.

    ``members`` are dealt rows with the part that each node belongs to so far, ``asked(range, chunk, src, dst)`` the pairs that
    were verified before; ``more`` tells that a task left pairs out.
    """

    def search(key, table, done):
        nodes, parts = table.column("node").to_numpy(), table.column("part").to_numpy()
        sure = table.column("sure").to_numpy().view(np.uint64)
        sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        order = np.argsort(nodes)
        at = [order[np.searchsorted(nodes[order], done.column(c).to_numpy())] for c in ("src", "dst")]
        done = np.minimum(*at) * len(nodes) + np.maximum(*at)
        held, alike, seen = np.empty(0, np.int64), np.empty(0), False

        def kept(pairs, same):
            nonlocal seen
            pairs, first = np.unique(pairs, return_index=True)
            keep = layered(parts[pairs // len(nodes)], parts[pairs % len(nodes)], same[first], layers)
            seen |= len(keep) < len(pairs)
            return pairs[keep], same[first][keep]

        for a, b in found_pairs(key, table, SURE_DISTANCE, sure):
            apart = parts[a] != parts[b]
            a, b = a[apart], b[apart]
            same = np.concatenate([(sketches[a[i : i + 65536]] == sketches[b[i : i + 65536]]).mean(axis=1) for i in range(0, len(a), 65536)] or [np.empty(0)])
            pairs = np.minimum(a, b) * len(nodes) + np.maximum(a, b)
            near = (same >= SIMILAR - DOUBT) & ~np.isin(pairs, done)
            pairs, same = kept(pairs[near], same[near])
            held, alike = np.concatenate([held, pairs]), np.concatenate([alike, same])
            if len(held) > HELD:
                held, alike = kept(held, alike)
        held, alike = kept(held, alike)
        src, dst = nodes[held // max(len(nodes), 1)], nodes[held % max(len(nodes), 1)]
        where = [pa.array(np.full(len(held), k.as_py(), np.int32)) for k in key]
        return pa.table([*where, pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst)), pa.array(np.full(len(held), seen))], ["range", "chunk", "src", "dst", "more"])

    tasks = members.groupBy("range", "chunk").cogroup(asked.groupBy("range", "chunk"))
    return tasks.applyInArrow(search, "range int, chunk int, src long, dst long, more boolean")


WANTED = 9  # kind of the blocks that name the texts to be fetched


def fetched(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted classes (node, doc_id, th); texts travel packed, and only wanted ones go on."""

    def names(batches):
        for batch in batches:
            node, doc, th = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield rows([(b, WANTED, pack(node[i], doc[i], th[i])) for b, i in by_bucket(spread(doc, width), width)])

    def fetch(batches):
        blobs, want = [], {}
        for kind, blob in received(batches):
            if kind == WANTED:
                node, doc, th = unpack(blob, "<i8", "<i8", "<i8")
                want |= zip(zip(doc.tolist(), th.tolist()), node.tolist())
            else:
                blobs.append(blob)
        for blob in blobs:
            batch = from_bytes(blob)
            node, found = [], []
            for i, text, th in zip(*(c.to_pylist() for c in batch.columns)):
                if (at := want.pop((i, th), None)) is not None:
                    node.append(at)
                    found.append(shingle_hashes((text or "").encode().lower().split()).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(found, pa.binary())], ["node", "shingles"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key("text").alias("th"))
    both = texts.mapInArrow(send_texts(width), PACKED).unionByName(wanted.select("node", "doc_id", "th").mapInArrow(names, PACKED))
    return both.repartitionById(width, F.col("bucket")).mapInArrow(fetch, "node long, shingles binary")


def similar_enough(batches):
    """(src, dst) of the pairs whose shingle sets are alike."""
    for batch in batches:
        src, dst = [], []
        for i, j, x, y in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= SIMILAR * (len(x) + len(y) - both):
                src.append(i)
                dst.append(j)
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def verified_groups(spark: SparkSession, scratch: Scratch, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of the classes that verified pairs link.

    Pairs are verified in rounds: a forest of each task's pairs first, then more and more forests of the pairs whose ends are still
    apart, in the tasks where a pair failed and others are left, until there are none.
    """
    ranges = Ranges(classes)
    asked = spark.createDataFrame([], "range int, chunk int, src long, dst long")
    labelled, still, layers, linked, sets = classes.withColumn("part", F.col("node")), None, 1, None, None
    while True:
        members = dealt(labelled.select("fp", "node", "sure", "sketch", "part"), ranges, SURE_DISTANCE)
        if still is not None:
            members, asked = (t.join(F.broadcast(still), ["range", "chunk"], "left_semi") for t in (members, asked))
        found = scratch.write(candidates(members, asked, layers))
        pairs = found.select("src", "dst").distinct()
        if sets is None:  # the first forests reach every class that has a pair
            ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            sets = scratch.write(fetched(docs, classes.join(ends, "node"), shuffle_width(spark)))
        met = pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("one")), "src").join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("other")), "dst")
        edges = scratch.write(met.select("src", "dst", "one", "other").mapInArrow(similar_enough, "src long, dst long"))
        linked = edges if linked is None else linked.unionByName(edges)
        groups = components(scratch, linked)
        still = scratch.write(found.where("more").join(edges, ["src", "dst"], "left_anti").select("range", "chunk").distinct())
        if still.isEmpty():
            return groups
        asked = asked.unionByName(found.select("range", "chunk", "src", "dst"))
        named = groups.select(F.col("id").alias("node"), F.col("component").alias("part"))
        labelled = scratch.write(classes.join(named, "node", "left").withColumn("part", F.coalesce("part", "node")))
        layers = min(4 * layers, LAYERS)


def near_groups(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, th, keeper): rows of ``docs`` with a near copy, and the document of their group that stays."""
    scratch = Scratch(spark, "near")
    prints = scratch.write(stage_prints(docs))
    least = F.min(F.struct("doc_id", "th")).alias("least")
    classes = prints.groupBy("class1", "class2").agg(least, F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("sure").alias("sure"), F.first("sketch").alias("sketch"))
    classes = scratch.write(classes.select("class1", "class2", F.monotonically_increasing_id().alias("node"), "least.doc_id", "least.th", "copies", "fp", "sure", "sketch"))
    groups = verified_groups(spark, scratch, docs, classes)
    named = classes.join(groups, F.col("node") == F.col("id"), "left").select("class1", "class2", "doc_id", "copies", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked"))
    keepers = named.where("linked").groupBy("component").agg(F.min("doc_id").alias("keeper"))
    decided = named.join(keepers, "component", "left").where("linked or copies > 1").select("class1", "class2", F.coalesce("keeper", "doc_id").alias("keeper"))
    return prints.select("doc_id", "th", "class1", "class2").join(decided, ["class1", "class2"]).select("doc_id", "th", "keeper")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near copies; documents without a doc_id stay."""
    gone = near_groups(spark, docs).where("doc_id <> keeper").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("_id")) & (text_key("text") == F.col("_th")), "left_anti").select(docs.columns)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark, read(spark, sf_dir, "documents"))
