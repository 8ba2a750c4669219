"""The write side: tables in a shared folder that change by whole commits.

A table is kept in partitions by one expression. A commit writes the partitions it touches, of one or several tables, to
new folders and then publishes a small manifest that says which folder holds which partition; readers follow the newest
manifest. So a commit that fails half-way changes nothing, one that is repeated under its name does nothing, two
writers at once cannot both win, and untouched partitions are neither read nor written.

The driver holds names of partitions, and of the last REMEMBERED commits, only. A partition without rows leaves the manifest; folders no manifest of the
newest ``keep`` names are left for ``vacuum``. Null partition values are partitions like others.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import ledger

NONE = "__HIVE_DEFAULT_PARTITION__"
REMEMBERED = 10_000  # names of commits that a repeat is known by


class Conflict(RuntimeError):
    """Another commit was published first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, partitions: dict[str, Column]):
        """``partitions``: the expression each table is split by, of few distinct values."""
        self.spark, self.root, self.partitions = spark, root.rstrip("/"), partitions
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def commits(self) -> list[str]:
        """Names of the manifest files, oldest first."""
        return [x for x in self._names("commits") if re.fullmatch(r"\d{12}\.json", x)]

    def _load(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.root}/commits/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict:
        names = self.commits()
        return self._load(names[-1]) if names else {"number": 0, "names": [], "tables": {}}

    def read(self, table: str, schema: dict[str, str], values: list | None = None, manifest: dict | None = None) -> DataFrame:
        """The table as of a manifest, or of the newest; only the partitions of ``values`` if these are given."""
        held = (manifest or self.manifest())["tables"].get(table, {})
        wanted = None if values is None else {_name(v) for v in values}
        paths = [f"{self.root}/{table}/{folder}/_part={name}" for name, folder in sorted(held.items()) if wanted is None or name in wanted]
        ddl = ", ".join(f"{column} {kind}" for column, kind in schema.items())
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def touched(self, table: str, rows: DataFrame) -> list:
        """Partition values of the rows."""
        return [r.p for r in rows.select(self.partitions[table].cast("string").alias("p")).distinct().collect()]

    def commit(self, name: str, changes: dict[str, tuple[DataFrame, list]], base: dict) -> None:
        """Publishes new contents (rows, touched partition values) of tables read as of ``base``."""
        folder, tables = uuid.uuid4().hex, {t: dict(parts) for t, parts in base["tables"].items()}
        for table, (rows, values) in changes.items():
            rows.withColumn("_part", self.partitions[table].cast("string")).write.partitionBy("_part").parquet(f"{self.root}/{table}/{folder}")
            kept = tables.setdefault(table, {})
            for v in values:
                kept.pop(_name(v), None)
            written = [x.removeprefix("_part=") for x in self._names(f"{table}/{folder}") if x.startswith("_part=")]
            if not set(written) <= {_name(v) for v in values}:
                raise ValueError(f"{table}: rows outside the touched partitions")
            kept |= dict.fromkeys(written, folder)
        self._publish({"number": base["number"] + 1, "names": [*base["names"], name][-REMEMBERED:], "tables": tables})

    def _publish(self, manifest: dict) -> None:
        """Moves the manifest to its number; whoever comes second finds that taken. Nothing is left to mend if this ends half-way."""
        draft, final = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.root}/commits/{manifest['number']:012d}.json")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        self.fs.mkdirs(final.getParent())
        no_options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(draft, final, no_options)
        except Exception as e:
            self.fs.delete(draft, False)
            raise Conflict(f"commit {manifest['number']} is taken") from e

    def applied(self, name: str) -> bool:
        """Whether a commit of this name is among those remembered."""
        return name in self.manifest()["names"]

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the newest ``keep`` manifests names, and returns how many; only without writers at work."""
        live: set[tuple[str, str]] = set()
        for name in self.commits()[-keep:]:
            live |= {(t, folder) for t, parts in self._load(name)["tables"].items() for folder in parts.values()}
        gone = [(t, x) for t in self.partitions for x in self._names(t) if (t, x) not in live]
        for t, x in gone:
            self.fs.delete(self._path(f"{self.root}/{t}/{x}"), True)
        return len(gone)


def _name(value) -> str:
    return NONE if value is None else str(value)


#: The tables of approvals.
UPLOADS = {"upload_id": "long", "user_id": "long", "status": "string", "stated": "decimal(25,2)", "calculated": "decimal(25,2)"}
LEDGER = {"carrier_id": "long", "client_name": "string", "month": "int", "year": "int", "user_id": "long", "environment_id": "string", "invoice_total": "decimal(25,2)", "commission_earned": "decimal(30,4)", "upload_ids": "array<long>", "statement_date": "timestamp_ntz", "statement_count": "int"}
BUCKETS = 16


def approvals(spark: SparkSession, root: str) -> Store:
    """Uploads by a hash of their id, the ledger by year."""
    return Store(spark, root, {"uploads": F.pmod(F.xxhash64("upload_id"), F.lit(BUCKETS)), "ledger": F.col("year")})


def typed(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in schema.items()])


def approve(store: Store, name: str, statements: DataFrame, entries: DataFrame) -> bool:
    """Approves ``statements(upload_id, user_id, stated)`` with their ``entries``: totals held against the stated ones, a status for each,
    entries merged into the ledger, both tables in one commit. Repeated under the same name it changes nothing and returns False."""
    if store.applied(name):
        return False
    base = store.manifest()
    own = entries.join(statements.select("upload_id"), "upload_id", "left_semi")
    sums = own.groupBy("upload_id").agg(F.sum("invoice").alias("calculated"))
    status = S.reconcile(F.col("calculated").cast("double"), F.col("stated").cast("double"))
    found = statements.join(sums, "upload_id", "left").withColumn("calculated", F.coalesce("calculated", F.lit(0))).withColumn("status", status)
    fresh = typed(found, UPLOADS)
    buckets = store.touched("uploads", fresh)
    uploads = store.read("uploads", UPLOADS, buckets, base).join(fresh.select("upload_id"), "upload_id", "left_anti").unionByName(fresh)
    built = typed(ledger.build(own), LEDGER)
    years = store.touched("ledger", built)
    merged = typed(ledger.merge(store.read("ledger", LEDGER, years, base), built), LEDGER)
    store.commit(name, {"uploads": (uploads, buckets), "ledger": (merged, years)}, base)
    return True


def forget_users(store: Store, name: str, users: DataFrame) -> bool:
    """Deletes what hangs on ``users(user_id)``: their uploads, and the ledger rows these made, in one commit; only partitions that hold some are written."""
    if store.applied(name):
        return False
    base, changes = store.manifest(), {}
    for table, schema in (("uploads", UPLOADS), ("ledger", LEDGER)):
        held = store.read(table, schema, None, base)
        values = store.touched(table, held.join(users, "user_id", "left_semi"))
        changes[table] = (store.read(table, schema, values, base).join(users, "user_id", "left_anti"), values)
    store.commit(name, changes, base)
    return True
