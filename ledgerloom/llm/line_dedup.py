"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit distance, one occurrence per connected group.

Lines are lower-cased with white space collapsed; blank ones are left alone (in the narrow form, those
under MIN_WORDS words). Equal lines become one class first. Classes whose 64-bit SimHashes of distinct words are at most DISTANCE bits apart
agree on two of four 16-bit blocks, so the join runs on the six pairs of blocks, packed by bucket.
So near are few of the lines that are alike, so WIDE candidates are added: lines that share one of
WORD_BANDS min-hash bands of their words with SimHashes at most FAR bits apart, and lines under
FEW_WORDS words that share one of CHAR_BANDS bands of their letter triples. A word's chance to be a
band's least hash grows with the square of its length, so bands rest on telling words and stay small.
A first round over hashes alone finds the blocks of candidates, a second over SimHashes and lengths the
lines with one they may be alike; only the texts of these are fetched, once each. Two lines are linked if their edit similarity is at least SIMILARITY. Every line
is verified against the first of its block; blocks whose other lines are then of different groups are
verified pair by pair, each pair only while its lines are not yet connected. Tasks return forests.
Of every connected group the first occurrence, by document and line, stays.

Cases: a null text is empty and has no lines to lose; a null doc_id neither loses lines nor makes
others lose theirs; rows that share a doc_id count as one document; equal lines at different places
are decided by place, so there are no ties; an empty table gives no rows; extra columns are ignored,
and kept by the pipeline stage.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, read, shuffle_width
from .edits import Letters, ranges
from .packed import PACKED, beside, by_bucket, gathered, joined, pack, portions, received, rows, send_texts, spread, unpack, values

MIN_WORDS = 5
DISTANCE = 2
SIMILARITY = 0.8
BLOCKS = [0, 16, 32, 48]  # first bits of the blocks; any two of them are equal within DISTANCE
PAIRS = list(combinations(BLOCKS, 2))
WORD_LANES = 9  # least hashes of the words, as a square of three by three
WORD_LINES = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6)]  # those that make a band; two bands share one at most
CHAR_ROWS = 4  # least hashes that make a band of letters
WORD_BANDS, CHAR_BANDS = len(WORD_LINES), 16
CHAR_LINES = np.arange(CHAR_BANDS * CHAR_ROWS).reshape(CHAR_BANDS, CHAR_ROWS).tolist()
FEW_WORDS = 12  # lines under so many words are compared by letters too
FAR = 20
KINDS = len(PAIRS) + WORD_BANDS + CHAR_BANDS
REACH = [DISTANCE] * len(PAIRS) + [FAR] * WORD_BANDS + [64] * CHAR_BANDS  # SimHash bits between candidates, by kind
MIXERS = np.random.default_rng(4).integers(0, 1 << 63, (2, CHAR_ROWS * CHAR_BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
BAG = 256
LINE_SCHEMA = "doc_id long, line int, h1 long, h2 long, copies long, size int, sim long, bands binary"
CLASS_SCHEMA = "line_id long, doc_id long, line int, h1 long, h2 long, copies long, size int, sim long"
PORTION = 1 << 21  # bytes of texts that are worked on at once
QUICK = 2  # level at which texts are compressed
GROUP = 8 << 20  # bytes of packed rows that are read at once
LINE = [("doc_id", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int64()), ("size", pa.int32()), ("sim", pa.int64()), ("bands", pa.binary())]
CLASS = [("line_id", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("copies", pa.int64()), ("size", pa.int32()), ("sim", pa.int64())]
BLOB = [("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())]
SHORT, LONG = 128, 4096  # letters from which the short ways are tried first, where many pairs are alike, and beyond which a pair has a table of its own
TOGETHER = 1 << 21  # letters of the longer lines that are compared at once
PENDING = 4096  # pairs that are gathered before they are compared


def words_of(lines: pa.Array) -> pa.Array:
    """Lower-cased words of each line, split at any white space; blank lines have one empty word."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(lines)))


def normal_lines(lines: list[str]) -> list[str]:
    return pc.binary_join(words_of(pa.array(lines, pa.string())), " ").to_pylist()


def normal(line: str) -> str:
    return normal_lines([line])[0]


def line_key(text: str) -> int:
    import xxhash

    return xxhash.xxh3_128_intdigest(text.encode())


def low_half(text: str) -> int:
    """The first half of the key as a signed number."""
    return int.from_bytes(line_key(text).to_bytes(16, "little")[:8], "little", signed=True)


def word_hashes(words: list[str] | list[bytes]) -> np.ndarray:
    """64-bit hashes, as rows of bytes."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint8).reshape(-1, 8)


def line_keys(lines: list[bytes]) -> np.ndarray:
    """``line_key`` of each line as two signed numbers, the low half first."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">i8").reshape(-1, 2)[:, ::-1].astype(np.int64)


def numbered(lines: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct features, number of each feature of all lines in turn, features of each line)."""
    place: dict[str, int] = {}
    at = [place.setdefault(w, len(place)) for features in lines for w in features]
    return list(place), np.array(at, np.int64), np.array([len(f) for f in lines], np.int64)


def simhashes(lines: list[list[str]]) -> np.ndarray:
    """SimHash of each line's words."""
    words, at, sizes = numbered(lines)
    return simhash_of(word_hashes(words), at, sizes)


def simhash_of(hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHashes of lines given as numbers of hashes, from their bits as byte-wide counters in eight integers."""
    lanes = np.ascontiguousarray(np.unpackbits(hashes, axis=1).view("<u8").T)  # one after the other, as rows of eight are slow to sum
    starts, parts = np.cumsum(sizes) - sizes, -(-sizes // 255)  # byte counters hold 255 words
    first = np.cumsum(parts) - parts
    short = np.repeat(starts, parts) + 255 * (np.arange(int(parts.sum())) - np.repeat(first, parts))
    counts = np.stack([np.add.reduceat(lane[at], short) for lane in lanes], axis=1).view(np.uint8).reshape(len(short), 64)
    if len(short) != len(starts):
        counts = np.add.reduceat(counts.astype(np.int64), first, axis=0)
    ones = 2 * counts.astype(np.int64) > sizes[:, None]
    return np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)


def band_keys(hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray, lines: list, weight: np.ndarray | None = None) -> np.ndarray:
    """Min-hash bands of lines given as numbers of hashes: a row of 32-bit keys, each over the lanes of one of ``lines``."""
    n = 1 + max(max(x) for x in lines)
    lanes = ((hashes.view("<u8") * MIXERS[0, :n] + MIXERS[1, :n]) >> np.uint64(32)).astype(np.uint32)
    if weight is not None:  # the least of exponential times falls to a word in proportion to its weight
        lanes = -np.log((lanes.astype(np.float32) + 1) / np.float32(1 << 32 | 1 << 9)) / weight.astype(np.float32)[:, None]
    starts = np.cumsum(sizes) - sizes
    least = np.stack([np.minimum.reduceat(lane[at], starts) for lane in np.ascontiguousarray(lanes.T)], axis=1).view(np.uint32)
    key = np.zeros((len(sizes), len(lines)), np.uint64)
    for k in range(len(lines[0])):
        key = (key ^ least[:, [x[k] for x in lines]]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32)


def triples(lines: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Letter triples of lines, once for each line, as ``numbered`` has them; a space stands before and after a line."""
    letters = np.frombuffer("".join([f" {x} " for x in lines]).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(lines)), [len(x) + 2 for x in lines])
    within = owner[2:] == owner[:-2]
    known, at = np.unique((letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])[within], return_inverse=True)
    told = np.unique(owner[2:][within] << 32 | at)
    return ["".join(map(chr, (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF))) for x in known.tolist()], told & 0xFFFFFFFF, np.bincount(told >> 32, minlength=len(lines))


def bands_of(lines: pa.Array, word_bands: np.ndarray, few: np.ndarray) -> pa.Array:
    """Keys of the word bands of each line, then those of the letter bands of the ``few`` lines with few words."""
    words, letters = word_bands.view(np.uint8), np.empty((0, 4 * CHAR_BANDS), np.uint8)
    if len(few):
        known, at, sizes = triples([x.decode() for x in values(lines.take(pa.array(few)))])
        letters = band_keys(word_hashes(known), at, sizes, CHAR_LINES).view(np.uint8)
    size = np.full(len(words), words.shape[1])
    size[few] += letters.shape[1]
    ends = np.cumsum(size)
    data = np.empty(int(ends[-1]), np.uint8)
    data[(ends - size)[:, None] + np.arange(words.shape[1])] = words
    data[(ends[few] - letters.shape[1])[:, None] + np.arange(letters.shape[1])] = letters
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data)])


def occurrences(source: DataFrame, wide: bool, width: int) -> DataFrame:
    """Rows of two sorts: ``LINE`` of every line that takes part, and ``source`` packed by bucket as ``BLOB``, so that it is read once.

    Of equal lines that a task finds close by, the first has their number as ``copies``, the others 0 and no more than place and hashes.
    """

    least = 1 if wide else MIN_WORDS

    def run(batches):
        for whole in batches:
            for sent in send_texts(width, level=QUICK)(portions(whole, 1, min(1 << 25, max(1 << 22, width << 18)))):  # blobs of a size for the heap
                yield of_two_sorts(LINE, blobs=sent)
            whole = whole.filter(pc.is_valid(whole.column(0))) if whole.column(0).null_count else whole
            for part in portions(whole, 1, PORTION):
                lists = pc.split_pattern(pc.fill_null(part.column(1), ""), "\n")
                flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
                number = np.arange(len(flat)) - np.searchsorted(parent, parent)
                words = words_of(flat)
                lines = pc.binary_join(words, " ")
                use = pc.and_(pc.greater_equal(pc.list_value_length(words), least), pc.not_equal(lines, ""))
                place = np.flatnonzero(use.to_numpy(zero_copy_only=False))
                if not len(place):
                    continue
                coded = lines.take(pa.array(place)).dictionary_encode()
                which = coded.indices.to_numpy()
                words = words.take(pa.array(place[np.unique(which, return_index=True)[1]]))
                of, count = pc.list_parent_indices(words).to_numpy().astype(np.int64), pc.list_value_length(words).to_numpy()
                flat_words = words.flatten().dictionary_encode()
                told = np.sort(of << 32 | flat_words.indices.to_numpy())
                told = told[np.concatenate([[True], told[1:] != told[:-1]])]  # once each, or a separator would outweigh the rest
                hashes, at, sizes = word_hashes(values(flat_words.dictionary)), told & 0xFFFFFFFF, np.bincount(told >> 32, minlength=len(words))
                key = line_keys(values(coded.dictionary))[which]
                bands = pa.array([b""] * len(words), pa.binary())
                if wide:
                    weight = pc.utf8_length(flat_words.dictionary).to_numpy().astype(np.float32) ** 2
                    bands = bands_of(coded.dictionary, band_keys(hashes, at, sizes, WORD_LINES, weight), np.flatnonzero(count < FEW_WORDS))
                doc = part.column(0).to_numpy()[parent[place]]
                order = np.lexsort((number[place], doc, which))
                first = order[np.searchsorted(which[order], np.arange(len(words)))]
                copies = np.zeros(len(place), np.int64)
                copies[first] = np.bincount(which)
                lead = pa.array(which, mask=copies == 0)
                facts = pc.utf8_length(coded.dictionary), pa.array(simhash_of(hashes, at, sizes).view(np.int64)), bands
                yield of_two_sorts(LINE, [doc, number[place].astype(np.int32), key[:, 0].copy(), key[:, 1].copy(), copies, *(x.take(lead) for x in facts)])
        pa.default_memory_pool().release_unused()  # workers stay, and others run beside them

    return source.mapInArrow(run, f"{LINE_SCHEMA}, {PACKED}")


def of_two_sorts(kinds: list, rows: list | None = None, blobs: pa.RecordBatch | None = None) -> pa.RecordBatch:
    """A batch of rows of ``kinds`` or of packed blobs, with nulls for the others' columns."""
    n = len(rows[0]) if blobs is None else len(blobs)
    arrays = [pa.nulls(n, t) for _, t in kinds] if rows is None else [x if isinstance(x, pa.Array) else pa.array(x) for x in rows]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(n, t) for _, t in BLOB)] if blobs is None else [*arrays, *blobs.columns], [n for n, _ in kinds + BLOB])


def classes_of(width: int):
    """Rows (LINE) of the same hashes together to rows (CLASS) of different lines, and their keys packed by bucket."""

    def run(batches):
        from pyspark import TaskContext

        batches = list(batches)
        if not batches:
            return
        table = pa.concat_batches(batches)
        del batches
        h1, h2, doc, line, copies = (table.column(n).to_numpy() for n in ("h1", "h2", "doc_id", "line", "copies"))
        order = np.lexsort((line, doc, h2, h1))
        starts = np.flatnonzero(np.append(True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)))
        copies, first = np.add.reduceat(copies[order], starts), pa.array(order[starts])
        ids = pa.array((TaskContext.get().partitionId() << 33) + np.arange(len(starts)))
        kept = table.select(["doc_id", "line", "h1", "h2", "size", "sim", "bands"]).take(first)
        yield of_two_sorts(CLASS, [ids, *kept.columns[:4], copies, *kept.columns[4:6]])
        for at in range(0, len(kept), 1 << 16):
            yield of_two_sorts(CLASS, blobs=to_blocks(width, ids[at : at + (1 << 16)], *(kept.column(n)[at : at + (1 << 16)] for n in ("sim", "bands"))))

    return run


def block_key(sim: np.ndarray, pair: tuple[int, int]) -> np.ndarray:
    low = np.uint64(0xFFFF)
    return ((sim >> np.uint64(pair[0])) & low) << np.uint64(16) | ((sim >> np.uint64(pair[1])) & low)


def keys_of(sim: np.ndarray, bands: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, positions, keys): the lines that are candidates by each kind of key."""
    everyone = np.arange(len(sim))
    for kind, pair in enumerate(PAIRS):
        yield kind, everyone, block_key(sim, pair).astype(np.uint32)
    size, first = np.array([len(b) for b in bands], np.int64), len(PAIRS)
    for low, high in ((0, WORD_BANDS), (WORD_BANDS, WORD_BANDS + CHAR_BANDS)):
        at = np.flatnonzero(size >= 4 * high)
        if len(at):
            keys = np.frombuffer(b"".join([bands[i][4 * low : 4 * high] for i in at.tolist()]), "<u4").reshape(len(at), -1)
            for k in range(high - low):
                yield first + low + k, at, keys[:, k]


def to_blocks(width: int, ids: pa.Array, sim: pa.Array, bands: pa.Array) -> pa.RecordBatch:
    """Lines packed by bucket of each of their keys."""
    ids, sim, out = ids.to_numpy(), sim.to_numpy().view(np.uint64), []
    for kind, at, key in keys_of(sim, values(bands)):
        mixed = (key + np.uint64(kind << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for b, i in by_bucket(((mixed >> np.uint64(33)) % np.uint64(width)).astype(np.int64), width):
            out.append((b, kind, pack(ids[at[i]], sim[at[i]] if kind < len(PAIRS) else sim[:0], key[i] if kind >= len(PAIRS) else key[:0])))
    return rows(out)


def close_pairs(key: np.ndarray, sim: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with equal keys and at most ``most`` differing bits, a slice at a time."""
    order = np.argsort(key, kind="stable")
    key, sim = key[order], sim[order]
    left = np.arange(len(key))
    for step in range(1, len(key)):
        left = left[: np.searchsorted(left, len(key) - step)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            return
        near = left[np.bitwise_count(sim[left] ^ sim[left + step]) <= most]
        if len(near):
            yield order[near], order[near + step]


def keyed(kind: int, parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, SimHashes, keys) of one kind; its key is sent only if the SimHash does not hold it."""
    ids, sim, key = joined(parts, "<i8", "<u8", "<u4")
    return ids, sim, block_key(sim, PAIRS[kind]) if kind < len(PAIRS) else key


def partners(batches):
    """(block, line_id): the lines that share a key with another in this share of the keys."""
    parts: dict[int, list] = {}
    for kind, blob in received(batches):
        parts.setdefault(kind, []).append(unpack(blob, "<i8", "<u8", "<u4"))
    for kind, found in parts.items():
        ids, sim, key = keyed(kind, found)
        hit = np.zeros(len(ids), bool)
        if kind < len(PAIRS):
            for a, b in close_pairs(key, sim, DISTANCE):
                hit[a] = hit[b] = True
        else:
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            hit[order[1:][same]] = hit[order[:-1][same]] = True
        yield pa.RecordBatch.from_arrays([pa.array(key[hit].astype(np.int64) | kind << 32), pa.array(ids[hit])], ["block", "line_id"])


def send_members(width: int):
    """Rows (block, line_id, sim, size) packed by bucket of the block."""

    def run(batches):
        for batch in gathered(batches):
            block, line, sim, size = (batch.column(k).to_numpy() for k in range(4))
            yield rows([(b, 0, pack(block[i], line[i], sim[i], size[i])) for b, i in by_bucket(spread(block, width), width)])

    return run


def within_reach(block: np.ndarray, sim: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each line has another in its block that SimHash and length allow to be alike; sorted by block and size."""
    reach, found, left = np.array(REACH)[block >> 32], np.zeros(len(block), bool), np.arange(len(block))
    for step in range(1, len(block)):
        go = np.zeros(len(left), bool)
        for low, high, other in ((left, left + step, left + step), (left - step, left, left - step)):
            at = np.flatnonzero((low >= 0) & (high < len(block)))
            low, high = low[at], high[at]
            may = (block[low] == block[high]) & (size[high] - size[low] <= size[high] * (1 - SIMILARITY) + 1e-9)  # once false, false for all steps beyond
            at, low, high = at[may], low[may], high[may]
            go[at] = True
            found[left[at[np.bitwise_count(sim[low] ^ sim[high]) <= reach[low]]]] = True
        left = left[go & ~found[left]]
        if not len(left):
            break
    return found


def candidates(batches):
    """(block, line_id, leader): lines with one they may be alike in their block; leader: the first such line of the block, where it may be alike too."""
    parts = [unpack(blob, "<i8", "<i8", "<u8", "<i4") for _, blob in received(batches)]
    block, line, sim, size = joined(parts, "<i8", "<i8", "<u8", "<i4")
    order = np.lexsort((size, block))
    order = order[within_reach(block[order], sim[order], size[order].astype(np.int64))]
    order = order[np.lexsort((line[order], block[order]))]
    block, line, sim, size = block[order], line[order], sim[order], size[order].astype(np.int64)
    first = np.searchsorted(block, block)
    room = np.maximum(size, size[first]) * (1 - SIMILARITY) + 1e-9
    star = (np.bitwise_count(sim ^ sim[first]) <= np.array(REACH)[block >> 32]) & (np.abs(size - size[first]) <= room) & (line != line[first])
    yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(line), pa.array(line[first], mask=~star)], ["block", "line_id", "leader"])


def edit_distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one integer; past ``most`` any larger number.

    A column's values are the column's number and the sum of the steps below; as they differ by one at most between
    rows, some rows tell whether every way through the column is already too long.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    for column, c in enumerate(b, 1):
        same = at.get(c, 0)
        zero = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(zero | up) & mask, zero & up
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(zero | plus)) & mask, plus & zero & mask
        if column % 32 == 0 and column > most:
            reach, step = int(most), max(4, int(most) // 6)
            rows = range(max(0, column - reach), min(len(a), column + reach) + step, step)
            if all(column + (up & (1 << r) - 1).bit_count() - (down & (1 << r) - 1).bit_count() - step > most for r in rows):
                return len(b) + len(a)
    return score


def common_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a[low:at] == b[low:at] else (low, at - 1)
    return low


def gaps(x: list[str], y: list[str], room: float) -> float:
    """Letters to change at most, if words that stand once in both texts stay: an upper bound of the edit distance."""
    once = {w: i for i, w in enumerate(y)}
    twice = {w for w, n in Counter(y).items() if n > 1} | {w for w, n in Counter(x).items() if n > 1}
    cost, i, j = 0, 0, 0
    for at, w in enumerate([*x, None]):
        to = len(y) if w is None else once.get(w, -1)
        if w is not None and (to < j or w in twice):
            continue
        cost += max(sum(map(len, x[i:at])) + at - i, sum(map(len, y[j:to])) + to - j)
        if cost > room:
            return cost
        i, j = at + 1, to + 1
    return cost


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both texts without the start and the end they share."""
    at = common_start(a, b)
    a, b = a[at:], b[at:]
    if at := common_start(a[::-1], b[::-1]):
        a, b = a[:-at], b[:-at]
    return a, b


def surely(a: str, b: str, room: float) -> bool:
    """Whether one of a few ways to edit a text into the other, which need no table, is short enough."""
    if max(len(a), len(b)) <= room:
        return True
    x, y = a.split(" "), b.split(" ")  # word for word is one way to edit
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q) <= room:
        return True
    return gaps(x, y, room) <= room


def alike(a: str, b: str) -> bool:
    longest = max(len(a), len(b))
    room = longest * (1 - SIMILARITY) + 1e-9
    if longest - min(len(a), len(b)) > room:
        return False
    a, b = trimmed(a, b)
    return surely(a, b, room) or edit_distance(a, b, room) <= room


def alike_pairs(texts: list[str], sizes: np.ndarray, i: np.ndarray, j: np.ndarray, short: int = SHORT) -> np.ndarray:
    """``alike`` of many pairs: what the short ways do not settle goes through one table, very long lines through their own."""
    longest = np.maximum(sizes[i], sizes[j])
    room = longest * (1 - SIMILARITY) + 1e-9
    good = np.zeros(len(i), bool)
    left = np.abs(sizes[i] - sizes[j]) <= room
    for k in np.flatnonzero(left & (longest > short)).tolist():
        a, b = trimmed(texts[i[k]], texts[j[k]])
        good[k] = surely(a, b, room[k])
        if longest[k] > LONG:
            good[k] = good[k] or edit_distance(a, b, room[k]) <= room[k]
            left[k] = False
    left = np.flatnonzero(left & ~good)
    if len(left):
        for some in np.split(left, np.flatnonzero(np.diff(np.cumsum(longest[left]) // TOGETHER)) + 1):
            which, at = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
            letters = Letters([texts[k] for k in which.tolist()])
            good[some] = letters.within(at[: len(some)], at[len(some) :], room[some].astype(np.int64))
    return good


class Bags:
    """How often each text has each letter pair, pairs hashed to BAG numbers, up to 255 of each; counted when first asked for."""

    def __init__(self, texts: list[str], sizes: np.ndarray):
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.pairs = ((letters[:-1] * np.uint32(37) + letters[1:]) & np.uint32(BAG - 1)).astype(np.uint16)
        self.place, self.held, self.total, self.size = np.full(len(texts), -1), np.zeros((64, BAG), np.uint8), np.zeros(64, np.int64), 0

    def of(self, which: np.ndarray) -> np.ndarray:
        """Places of the texts' counts in ``held``."""
        new = np.unique(which[self.place[which] < 0])
        while self.size + len(new) > len(self.held):
            self.held, self.total = np.concatenate([self.held, np.zeros_like(self.held)]), np.concatenate([self.total, np.zeros_like(self.total)])
        for some in np.array_split(new, -(-len(new) // 128)) if len(new) else []:
            n = np.maximum(self.sizes[some] - 1, 0)
            at, _ = ranges(self.starts[some], n)
            key = np.repeat(np.arange(len(some)) * BAG, n)
            key += self.pairs[at]
            mine = slice(self.size, self.size + len(some))
            self.held[mine] = np.minimum(np.bincount(key, minlength=len(some) * BAG), 255).reshape(len(some), BAG)
            self.total[mine] = self.held[mine].sum(axis=1)
            self.place[some] = np.arange(self.size, self.size + len(some))
            self.size += len(some)
        return self.place[which]


def may_be_alike(sizes: np.ndarray, bags: Bags, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False only where the lengths or the letter pairs rule the similarity out: an edit changes two pairs at most."""
    room = np.maximum(sizes[i], sizes[j]) * (1 - SIMILARITY) + 1e-9
    may = np.abs(sizes[i] - sizes[j]) <= room
    at, even = np.flatnonzero(may), np.uint64(0x00FF00FF00FF00FF)
    for some in np.array_split(at, -(-len(at) // 512)) if len(at) else []:
        a, b = bags.of(i[some]), bags.of(j[some])
        most = np.maximum(bags.held[a], bags.held[b]).view("<u8")
        both = most & even
        most >>= np.uint64(8)
        most &= even
        both += most  # sums of two bytes, so that BAG of them fit into 16 bits
        either = both.sum(axis=1).view("<u2").reshape(len(some), 4).sum(axis=1, dtype=np.int64)
        may[some] = either - np.minimum(bags.total[a], bags.total[b]) <= 2 * room[some]
    return may


def linked(batches):
    """(src, dst) of the pairs of lines that are alike."""
    for whole in batches:
        for part in portions(whole, 3):
            texts = [*part.column(2).to_pylist(), *part.column(3).to_pylist()]
            n = np.arange(len(part))
            good = alike_pairs(texts, np.array([len(t) for t in texts]), n, n + len(part))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in part.columns[:2]], ["src", "dst"])


def send_mixed(width: int):
    """Rows (block, line_id, label, sim, text) packed by bucket of the block."""

    def run(batches):
        for batch in gathered(batches, 1 << 15):
            block, line, label, sim = (batch.column(k).to_numpy() for k in range(4))
            texts, out = values(batch.column(4)), []
            for b, i in by_bucket(spread(block, width), width):
                mine = [texts[j] for j in i.tolist()]
                out.append((b, 0, pack(block[i], line[i], label[i], sim[i], np.array([len(t) for t in mine], np.int64), np.frombuffer(b"".join(mine), np.uint8))))
            yield rows(out)

    return run


def send_labels(width: int):
    """Rows (block, line_id, label) packed by bucket of the block."""

    def run(batches):
        for batch in gathered(batches):
            block, line, label = (batch.column(k).to_numpy() for k in range(3))
            yield rows([(b, 0, pack(block[i], line[i], label[i])) for b, i in by_bucket(spread(block, width), width)])

    return run


def mixed_blocks(batches):
    """(block, line_id, label) of the blocks with lines of different groups, without their first line, which has been compared with all others."""
    block, line, label = joined([unpack(blob, "<i8", "<i8", "<i8") for _, blob in received(batches)], "<i8", "<i8", "<i8")
    order = np.lexsort((line, block))
    order = order[1:][block[order[1:]] == block[order[:-1]]]
    order = order[np.lexsort((label[order], block[order]))]
    block, line, label = block[order], line[order], label[order]
    mixed = label[np.searchsorted(block, block)] != label[np.searchsorted(block, block, side="right") - 1]
    yield pa.RecordBatch.from_arrays([pa.array(x[mixed]) for x in (block, line, label)], ["block", "line_id", "label"])


def connected(label: np.ndarray, at: np.ndarray, line: np.ndarray, texts: list[str], sizes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels of the groups after pairs of lines, of groups ``at``, are verified: first one of the pairs between two groups, then ever more."""
    quota = 1
    while True:
        a, b = label[at[left]], label[at[right]]
        left, right, a, b = (x[a != b] for x in (left, right, a, b))
        if not len(left):
            return label
        key = np.minimum(a, b) * len(label) + np.maximum(a, b)
        order = np.argsort(key, kind="stable")
        key = key[order]
        now = np.zeros(len(left), bool)
        now[order[np.arange(len(key)) - np.searchsorted(key, key) < quota]] = True
        good = np.flatnonzero(now)[alike_pairs(texts, sizes, line[left[now]], line[right[now]], LONG)]  # few of these are alike
        if len(good):
            root = label.tolist()
            for x, y in zip(a[good].tolist(), b[good].tolist()):
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
            label = np.array(root)
            while not np.array_equal(label, up := label[label]):
                label = up
        left, right, quota = left[~now], right[~now], 8 * quota


def verified(batches):
    """A forest (src, dst) that links the groups of lines which pairs in this share of the blocks connect."""
    parts, texts, place = [], [], {}
    for _, blob in received(batches):
        block, line, label, sim, size, data = unpack(blob, "<i8", "<i8", "<i8", "<u8", "<i8", "u1")
        data, ends = data.tobytes(), np.cumsum(size).tolist()
        for x, a, b in zip(line.tolist(), [0, *ends], ends):
            if x not in place:  # a line of several blocks is held once
                place[x] = len(texts)
                texts.append(data[a:b].decode())
        parts.append([block, np.array([place[x] for x in line.tolist()], np.int64), label, sim])
    if not parts:
        return
    del place
    block, line, group, sim = joined(parts, "<i8", "<i8", "<i8", "<u8")
    names, at = np.unique(group, return_inverse=True)
    label = np.arange(len(names))
    sizes = np.array([len(t) for t in texts])
    bags = Bags(texts, sizes)
    reach = np.array(REACH)[block >> 32]
    held, n, most = [], 0, 1
    for left, right in close_pairs(block, sim, 64):
        apart = (label[at[left]] != label[at[right]]) & (np.bitwise_count(sim[left] ^ sim[right]) <= reach[left])
        left, right = left[apart], right[apart]
        apart = may_be_alike(sizes, bags, line[left], line[right])
        held.append((left[apart], right[apart]))
        n += int(apart.sum())
        if n >= most:  # neighbours at once, as they may be all that connects a block
            label = connected(label, at, line, texts, sizes, *map(np.concatenate, zip(*held)))
            held, n, most = [], 0, PENDING
    if n:
        label = connected(label, at, line, texts, sizes, *map(np.concatenate, zip(*held)))
    moved = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["src", "dst"])


class Told:
    """Facts (doc_id, line, h1, ...) about lines of documents."""

    def __init__(self, facts: pa.Table | None):
        facts = facts.sort_by("doc_id") if facts is not None else pa.table({n: pa.array([], pa.int64()) for n in ("doc_id", "line", "h1")})
        self.facts, (self.ids, self.line, self.h1) = facts, (facts[n].to_numpy() for n in ("doc_id", "line", "h1"))

    def lines(self, batch: pa.RecordBatch) -> tuple[np.ndarray, pa.ListArray, np.ndarray, np.ndarray, pa.Array]:
        """Of a batch of texts: rows with facts, their lines, and the facts that hold with the place of their line among these and its normal form."""
        ids = pc.fill_null(batch.column(0), 0).to_numpy()
        low = np.searchsorted(self.ids, ids, side="left")
        count = (np.searchsorted(self.ids, ids, side="right") - low) * pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(count)
        lists = pc.split_pattern(pc.fill_null(batch.column(1), "").take(pa.array(at)), "\n")
        starts = lists.offsets.to_numpy().astype(np.int64)
        fact, _ = ranges(low[at], count[at])
        row = np.repeat(np.arange(len(at)), count[at])
        place = starts[row] + self.line[fact]
        there = place < starts[row + 1]
        fact, place = fact[there], place[there]
        normal = pc.binary_join(words_of(lists.flatten().take(pa.array(place))), " ")
        same = line_keys(values(normal))[:, 0] == self.h1[fact]  # else the line of another row with this id
        return at, lists, fact[same], place[same], normal.filter(pa.array(same))


def fetch(texts, wanted):
    """Texts and their wanted lines to (line_id, sim, text), each once: rows that share an id are in one task."""
    told = Told(wanted)
    open_ = np.ones(len(told.ids), bool)
    for batch in texts:
        _, _, fact, _, lines = told.lines(batch)
        fact, first = np.unique(fact, return_index=True)
        fact, first = fact[open_[fact]], first[open_[fact]]
        if len(fact):
            open_[fact] = False
            yield pa.RecordBatch.from_arrays([*(told.facts[n].combine_chunks().take(pa.array(fact)) for n in ("line_id", "sim")), lines.take(pa.array(first))], ["line_id", "sim", "text"])


def similar_groups(scratch: Scratch, texts: DataFrame, classes: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(id, component) of the line classes that are linked to another; joins hash the side with one row for each line."""

    def by_block(df: DataFrame, send, run, schema: str) -> DataFrame:
        return df.mapInArrow(send(width), PACKED).repartitionById(width, F.col("bucket")).mapInArrow(run, schema)

    hashes = keys.repartitionById(width, F.col("bucket"))
    facts = classes.select("line_id", "sim", "size").hint("shuffle_hash")
    members = hashes.mapInArrow(partners, "block long, line_id long").join(facts, "line_id").select("block", "line_id", "sim", "size")
    blocks = scratch.write(by_block(members, send_members, candidates, "block long, line_id long, leader long"))
    wanted = classes.join(blocks.select("line_id").distinct().hint("shuffle_hash"), "line_id").select("doc_id", "line", "line_id", "sim", "h1")
    lines = scratch.write(beside(texts, wanted, width, fetch, "line_id long, sim long, text string"))

    stars = blocks.where("leader is not null").select("leader", "line_id").distinct()
    stars = stars.join(lines.select(F.col("line_id").alias("leader"), F.col("text").alias("one")), "leader").join(lines.select("line_id", F.col("text").alias("other")), "line_id")
    first = components(scratch, stars.select("leader", "line_id", "one", "other").mapInArrow(linked, "src long, dst long"))
    told = blocks.join(first.hint("shuffle_hash"), F.col("line_id") == F.col("id"), "left").select("block", "line_id", F.coalesce("component", "line_id").alias("label"))
    mixed = by_block(told, send_labels, mixed_blocks, "block long, line_id long, label long").join(lines, "line_id").select("block", "line_id", "label", "sim", "text")
    more = by_block(mixed, send_mixed, verified, "src long, dst long")
    return components(scratch, first.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(more))


def doomed_lines(spark: SparkSession, source: DataFrame, wide: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line, h1): the occurrences that go; and the packed texts of ``source``."""
    scratch, width = Scratch(spark, "lines"), shuffle_width(spark)
    both = scratch.write(occurrences(source, wide, width), GROUP)
    seen, texts = both.where("bucket is null"), both.where("bucket is not null").select("bucket", "blob")
    once = seen.where("copies > 0").select(*(n for n, _ in LINE)).repartition(width, "h1")
    both = scratch.write(once.mapInArrow(classes_of(width), f"{CLASS_SCHEMA}, {PACKED}"), GROUP)
    classes, keys = both.where("bucket is null").select(*(n for n, _ in CLASS)), both.where("bucket is not null").select("bucket", "kind", "blob")

    groups = similar_groups(scratch, texts, classes, keys, width)
    named = classes.select("h1", "h2", F.struct("doc_id", "line").alias("first"), "copies", "line_id").join(groups.hint("shuffle_hash"), F.col("line_id") == F.col("id"), "left").where("copies > 1 or component is not null")
    keepers = named.where("component is not null").groupBy("component").agg(F.min("first").alias("keeper"))
    decided = named.join(keepers, "component", "left").select("h1", "h2", F.coalesce("keeper", "first").alias("keeper"))
    gone = seen.select("doc_id", "line", "h1", "h2").join(decided.hint("shuffle_hash"), ["h1", "h2"]).where(F.struct("doc_id", "line") != F.col("keeper")).select("doc_id", "line", "h1")
    return gone, texts


def without(others: list[str]):
    """Rows (doc_id, text, ...) without the lines listed for them, with the numbers of lines and of lines removed."""

    def run(texts, gone):
        told = Told(gone)
        for batch in texts:
            at, lists, _, place, _ = told.lines(batch)
            text = pc.fill_null(batch.column(1), "")
            count = np.where(pc.equal(text, "").to_numpy(zero_copy_only=False), 0, pc.count_substring(text, "\n").to_numpy().astype(np.int64) + 1)
            lost = np.zeros(len(batch), np.int64)
            if len(place):
                lines, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
                stays = np.ones(len(lines), bool)
                stays[place] = False
                left = np.append(0, np.cumsum(stays))[starts]
                lost[at] = np.diff(starts) - np.diff(left)
                less = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), lines.filter(pa.array(stays))), "\n")
                which = np.arange(len(batch))
                which[at] = len(batch) + np.arange(len(at))
                text = pa.concat_arrays([text, less]).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], text, pa.array(count), pa.array(lost)], ["doc_id", *others, "text", "n_lines", "n_removed"])

    return run


def dedup_lines(spark: SparkSession, docs: DataFrame, wide: bool = False) -> DataFrame:
    """``docs`` with what stays of each text, and a column ``lines`` struct<text, n_lines, n_removed> beside; ids come as longs.

    A null text stays null and is empty in ``lines``.
    """
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "doc_id"}  # clash with nothing
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c).alias(n) for c, n in inner.items()))
    added = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    # a text is not sent twice: an extra column has it only if it was null
    source = source.withColumn(inner["text"], F.col("text").isNull()) if "text" in inner else source
    schema = T.StructType([source.schema["doc_id"], *(source.schema[n] for n in inner.values()), *added])
    gone, texts = doomed_lines(spark, source, wide)
    out = beside(texts, gone, shuffle_width(spark), without(list(inner.values())), schema)
    text = F.when(~F.col(inner["text"]), F.col("text"))
    lines = F.struct("text", "n_lines", "n_removed").alias("lines")
    return out.select(*(F.col("doc_id") if c == "doc_id" else text.alias("text") if c == "text" else F.col(inner[c]).alias(c) for c in docs.columns if c != "lines"), lines)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; a document that loses all its lines goes."""
    inner = {c: c if c in ("doc_id", "text") else f"k{i}" for i, c in enumerate(docs.columns)}
    out = dedup_lines(spark, docs.select(*(F.col(c).alias(n) for c, n in inner.items())), wide=True)
    out = out.where((F.col("lines.n_removed") == 0) | (F.trim("lines.text") != ""))
    return out.select(*(F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in inner.items()))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark, read(spark, sf_dir, "documents").select("doc_id", "text"), wide=True)
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", F.sha2(F.col("lines.text").cast("binary"), 256).alias("kept_sha256"))
