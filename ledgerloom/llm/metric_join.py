"""Embedding near-duplicates by an exact metric range join.

Equal vectors are joined first. Pivots drawn from the rest split space into cells, each vector
belonging to its nearest pivot. By the triangle inequality a vector can only have a partner in
another cell if it is no further from that cell's pivot than the cell's radius plus the range, no
more than twice the range further than from its own pivot, and no further than the range from the
plane halfway between the two pivots; there it goes as a visitor, to one of the two cells of each
pair. Cells join independently: members with members and with visitors. Members are cut into chunks
and visitors into blocks, and each chunk meets each block in a group of its own, so no task holds
more than twice CROWD vectors. A group returns link counts and a forest, not its pairs.

How much the inequality prunes is up to the data: vectors in clusters narrower than the range go to
one cell or few; vectors spread evenly over many dimensions are all about equally far from every
pivot, no bound on distances to pivots can part them, and the join then compares half of all pairs
of cells.

Cases: see ``vectors.usable``; rows that take no part link with nothing, are their own component and
are kept; vectors only meet others of their dimension; a null vec_id gets null component; rows that
repeat a vec_id repeat its result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, read
from .simhash_dedup import forest
from .vectors import as_binary, cosine, matrix, unit, usable

THRESHOLD = 0.9
PIVOTS = 0.08  # times the root of the number of distinct vectors, and eight at least
CROWD = 65536  # members of a chunk and visitors of a block at most, as a mean
BLOCK = 2048
SAFE = 1e-6  # over rounding errors of distances; the exact cosine decides


def links(spark: SparkSession, scratch: Scratch, distinct: DataFrame, threshold: float) -> DataFrame:
    """Rows (src, dst, n): edges of a forest with n null, and parts of link counts of src with dst null."""
    n = distinct.count()
    count = max(8, math.ceil(PIVOTS * math.sqrt(n)))
    drawn = distinct.orderBy(F.xxhash64("node"), "node").limit(count).collect()
    pivots: dict[int, np.ndarray] = {}
    for row in drawn:
        pivots.setdefault(len(row["vector"]), []).append(row["vector"])
    pivots = {d: unit(np.array(p)) for d, p in pivots.items()}
    reach = math.sqrt(2 - 2 * threshold) + SAFE
    crowd = max(64, min(CROWD, math.ceil(1.5 * n / count)))

    def away(vectors: np.ndarray) -> np.ndarray:
        p = pivots.get(vectors.shape[1])
        if p is None:  # a dimension no pivot has is one cell
            return np.zeros((len(vectors), 1))
        return np.sqrt(np.maximum(2 - 2 * unit(vectors) @ p.T, 0))

    def by_dimension(batch):
        cells = batch.column(1).to_pylist()
        size = np.array([len(c) for c in cells])
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            yield d, rows, np.array([cells[i] for i in rows.tolist()], np.float64)

    def nearby(far: np.ndarray, own: np.ndarray, d: int) -> np.ndarray:
        """Cells that each vector may have partners in besides its own; one of two cells visits the other."""
        cells, least = far.shape[1], far.min(axis=1)[:, None]
        near = far <= least + 2 * reach
        if d in pivots:
            between = away(pivots[d])[own]
            near &= far**2 - least**2 <= 2 * between * reach + SAFE
        step = (np.arange(cells) - own[:, None]) % cells
        return near & (step > 0) & ((2 * step < cells) | ((2 * step == cells) & (2 * own[:, None] < cells)))

    def measure(batches):
        for batch in batches:
            for d, _, x in by_dimension(batch):
                far = away(x)
                own, cells = far.argmin(axis=1), far.shape[1]
                radius = np.full(cells, -np.inf)
                np.maximum.at(radius, own, far.min(axis=1))
                counts = np.bincount(own, minlength=cells), nearby(far, own, d).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(cells, d, np.int32)), pa.array(np.arange(cells, dtype=np.int32)), pa.array(radius), *(pa.array(c.astype(np.int64)) for c in counts)], ["dimension", "cell", "r", "n", "v"])

    radius, chunks, blocks = {}, {}, {}
    found = distinct.select("node", "vector").mapInArrow(measure, "dimension int, cell int, r double, n long, v long").groupBy("dimension", "cell").agg(F.max("r").alias("r"), F.sum("n").alias("n"), F.sum("v").alias("v"))
    for row in found.collect():
        at = row["dimension"], row["cell"]
        radius[at], chunks[at], blocks[at] = row["r"], max(1, -(-row["n"] // crowd)), max(1, -(-row["v"] // crowd))
    schema = "dimension int, cell int, chunk int, part int, node long, copies long, vector binary, member boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def deal(batches):
        for batch in batches:
            for d, rows, x in by_dimension(batch):
                far = away(x)
                own, cells = far.argmin(axis=1), far.shape[1]
                a, b, r = (np.array([t.get((d, c), z) for c in range(cells)]) for t, z in ((chunks, 1), (blocks, 1), (radius, -np.inf)))
                near = nearby(far, own, d) & (far <= r + reach)
                near[np.arange(len(rows)), own] = True
                who, cell = np.nonzero(near)
                home = cell == own[who]
                times = np.where(home, a[cell] + b[cell], a[cell])
                who, cell, home = np.repeat(who, times), np.repeat(cell, times), np.repeat(home, times)
                turn = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                mixed = batch.column(0).take(pa.array(rows)).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                mine = (mixed >> np.uint64(33)).astype(np.int64)[who] % a[cell]
                block = (mixed >> np.uint64(13)).astype(np.int64)[who] % b[cell]
                # at home: with its own chunk, as a visitor of the chunks before, as a member against those after and all visitors
                member = home & (turn >= mine)
                chunk = np.where(member, mine, turn)
                part = np.where(home, np.where(turn == mine, -1, np.where(turn < mine, mine, turn)), a[cell] + block)
                pick = pa.array(rows[who])
                packed = as_binary(batch.column(1).take(pa.array(rows))).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), d, np.int32)), *(pa.array(c.astype(np.int32)) for c in (cell, chunk, part)), batch.column(0).take(pick), batch.column(2).take(pick), packed, pa.array(member)], names)

    def join(key, table):
        member = table.column("member").to_numpy()
        node, copies, x = table.column("node").to_numpy(), table.column("copies").to_numpy(), matrix(table.column("vector"))
        u = unit(x).astype(np.float32)
        inside, visiting = np.flatnonzero(member), np.flatnonzero(~member)
        count = np.zeros(len(node), np.int64)
        src, dst = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for asked, twice in (((inside, True),) if key[3].as_py() < 0 else ((visiting, False),)):
            for at in range(0, len(asked), BLOCK):
                q = asked[at : at + BLOCK]
                held = inside[at:] if twice else inside  # members with those after them
                a, b = np.nonzero(u[q] @ u[held].T >= threshold - 1e-5)
                if twice:
                    later = b > a
                    a, b = a[later], b[later]
                a, b = q[a], held[b]
                for part in range(0, len(a), 1 << 16):
                    i, j = a[part : part + (1 << 16)], b[part : part + (1 << 16)]
                    linked = cosine(x[i], x[j]) >= threshold
                    i, j = i[linked], j[linked]
                    count += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
                    s, t = forest(node[i], node[j])
                    src.append(s)
                    dst.append(t)
        s, t = forest(np.concatenate(src), np.concatenate(dst))
        some = np.flatnonzero(count)
        return pa.table(
            {
                "src": np.concatenate([s, node[some]]),
                "dst": pa.concat_arrays([pa.array(t, pa.int64()), pa.nulls(len(some), pa.int64())]),
                "n": pa.concat_arrays([pa.nulls(len(s), pa.int64()), pa.array(count[some], pa.int64())]),
            }
        )

    dealt = distinct.select("node", "vector", "copies").mapInArrow(deal, schema)
    return scratch.write(dealt.groupBy("dimension", "cell", "chunk", "part").applyInArrow(join, "src long, dst long, n long"))


def near_duplicates(spark: SparkSession, table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark, "metric")
    rows = scratch.write(usable(table))
    distinct = scratch.write(rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    found = links(spark, scratch, distinct, threshold)
    groups = components(scratch, found.where("dst is not null").select("src", "dst"))
    counts = found.where("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    named = distinct.join(counts, "node", "left").join(groups, F.col("node") == F.col("id"), "left")
    named = named.select("vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = rows.join(named, "vector").select("vec_id", "n_links", "component_id")
    out = table.select(F.col("vec_id").cast("long")).join(named, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op7_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read(spark, sf_dir, "embeddings"))
