"""Pieces shared by the operators: shared-folder tables, hashing helpers, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or the checkpoint folder the session was given.

    Without either there is none: a folder of this machine would lose rows on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            import tempfile

            path = "file://" + tempfile.mkdtemp(prefix="checkpoint-")  # one process, so its disk is everyone's
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor costs a re-read, never a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, group: int | None = None) -> DataFrame:
        """``group``: bytes of a row group, of which a reader holds one; for rows that are large."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.options(compression="zstd", **{"parquet.block.size": group} if group else {}).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for t in tables:
            path = hadoop.Path(t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def is_held_out(column: str, modulus: int, remainder: int):
    """crc32 of the id as text, modulo: the fold that no label is learnt from. A null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of ``edges(src, dst)``, both longs: returns (id, component).

    Alternating large-star and small-star steps; each is a grouping with map-side minimum and one
    equi-join that AQE may split, so a node with very many links stays spread. Every round is
    written to the shared folder. Nodes without an edge are not returned.
    """
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = scratch.write(now)

    def measure(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = measure(now)
    for _ in range(rounds if seen[0] else 0):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = scratch.write(small.where("u <> v").distinct())
        scratch.drop(now)
        now, before, seen = new, seen, measure(new)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError("components: not settled")
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
