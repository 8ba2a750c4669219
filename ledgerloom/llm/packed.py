"""Packed arrays between stages: one compressed block for each (batch, bucket) instead of a row for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "bucket int, kind int, blob binary"
LEVEL = 5
TEXTS, FACTS = 0, 1  # kinds of the blocks of ``send_texts``


def squeezed(raw: bytes, level: int = LEVEL) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def restored(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed block."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return squeezed(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = restored(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def values(texts: pa.Array) -> list[bytes]:
    """The values of a text array as bytes, empty ones for nulls; several times as fast as ``to_pylist``."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(1, int)
    low, ends = int(ends[0]), (ends - ends[0]).tolist()
    data = data.slice(low, ends[-1]).to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of 64-bit numbers, column by column so that equal bytes lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T)


def from_low_bytes(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = x.reshape(n, -1).T
    return out.view("<u8").ravel()


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "blob"])


def by_bucket(bucket: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in their order) for each bucket that has any."""
    order = np.argsort(bucket.astype(np.uint16 if width <= 65536 else np.int64), kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(width + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


def spread(ids: np.ndarray, width: int) -> np.ndarray:
    """Bucket of each id."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(width)).astype(np.int64)


def received(batches) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())


def joined(parts: list[list[np.ndarray]], *kinds: str) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, kind) for i, kind in enumerate(kinds)]


def gathered(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``least`` rows or more each, so that fewer blocks are packed."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= least:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def portions(batch: pa.RecordBatch, column: int, size: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of one text column, at least a row each."""
    import pyarrow.compute as pc

    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        base = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def send_texts(width: int, kind: int = TEXTS, level: int = LEVEL):
    """Rows (doc_id, text, ...) packed by the bucket of the id; rows without an id are dealt out by their place."""

    def run(batches):
        for at, whole in enumerate(batches if kind == TEXTS else gathered(batches)):
            for batch in portions(whole, 1) if kind == TEXTS else [whole]:
                ids = [at + n if i is None else i for n, i in enumerate(batch.column(0).to_pylist())]
                bucket = spread(np.array(ids, np.int64), width)
                out = []
                for b, i in by_bucket(bucket, width):
                    out.append((b, kind, squeezed(to_bytes(batch.take(pa.array(i))), level)))
                yield rows(out)

    return run


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(restored(blob)).read_next_batch()


def beside(texts: DataFrame, facts: DataFrame, width: int, run, schema) -> DataFrame:
    """Texts as ``send_texts`` packs them, (bucket, blob), and rows (doc_id, ...) of the same documents, met in one task by ``run(texts, facts)``.

    ``run`` gets the batches of texts one by one and the facts as one table, and gives batches of ``schema``.
    """

    def meet(batches):
        blobs, told = [], []
        for kind, blob in received(batches):
            if kind == TEXTS:
                blobs.append(blob)
            else:
                told.append(from_bytes(blob))
        yield from run(map(from_bytes, blobs), pa.Table.from_batches(told).combine_chunks() if told else None)
        pa.default_memory_pool().release_unused()

    both = texts.select("bucket", F.lit(TEXTS).alias("kind"), "blob").unionByName(facts.mapInArrow(send_texts(width, FACTS), PACKED))
    return both.repartitionById(width, F.col("bucket")).mapInArrow(meet, schema)
