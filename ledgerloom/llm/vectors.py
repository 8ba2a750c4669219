"""Vectors of the embeddings table as the nearest-neighbour operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one per vec_id.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite components, take no
    part; of rows that repeat a vec_id the smallest vector counts.
    """
    v = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null and vector is not null")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(sound & F.exists("vector", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of binary doubles as a matrix."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def as_binary(vectors: pa.Array) -> pa.Array:
    return pa.array([np.asarray(v, np.float64).tobytes() for v in vectors.to_pylist()], pa.binary())


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, scaled first so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision, summed in the same order for equal vectors."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
