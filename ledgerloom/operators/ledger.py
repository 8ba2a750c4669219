"""The monthly ledger: building, merging, retracting, re-keying. Snapshots in, snapshots out.

Amounts are decimals. Nullable key parts compare null-safe, so an unknown user or environment meets
itself, as the lookups of the domain do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.binding import MONTHS

KEY = ["carrier_id", "client_name", "month", "year", "user_id", "environment_id"]


def build(entries: DataFrame) -> DataFrame:
    """Entries to ledger rows: one per key, with sums, the set of uploads and the first statement date."""
    return entries.groupBy(*KEY).agg(
        F.sum("invoice").alias("invoice_total"), F.sum("commission").alias("commission_earned"),
        F.sort_array(F.collect_set("upload_id")).alias("upload_ids"), F.min("statement_date").alias("statement_date"),
    ).withColumn("statement_count", F.size("upload_ids"))


def month_columns(value: str = "commission_earned") -> list[Column]:
    """The twelve conditional sums of a month pivot; months without rows are zero."""
    return [F.coalesce(F.sum(F.when(F.col("month") == i, F.col(value))), F.lit(0)).alias(f"{m}_commission") for i, m in enumerate(MONTHS, 1)]


def merge(ledger: DataFrame, incoming: DataFrame, mode: str = "reference") -> DataFrame:
    """Merge built rows into the ledger.

    Where an upload of the incoming row is already in the ledger row, its amounts replace those held
    and count and uploads stay; otherwise they are added, the count grows by one and the uploads are
    united; unmatched rows are inserted. ``mode="additive"`` adds only what new uploads bring, which
    the caller must have separated per upload.
    """
    old, new = ledger.alias("o"), incoming.alias("n")
    on = None
    for k in KEY:
        on = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) if on is None else on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    # the right side is marked, as all of its key may be null
    out = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), on, "full_outer")
    both = F.col("o._o").isNotNull() & F.col("n._n").isNotNull()
    again = both & F.arrays_overlap("o.upload_ids", "n.upload_ids") & F.lit(mode == "reference")

    def pick(name: str) -> Column:
        o, n = F.col(f"o.{name}"), F.col(f"n.{name}")
        return F.when(again, n).when(both, o + n).otherwise(F.coalesce(o, n)).alias(name)

    count = F.when(again, F.col("o.statement_count")).when(both, F.col("o.statement_count") + 1).otherwise(F.coalesce(F.col("o.statement_count"), F.lit(1)))
    ids = F.when(again, F.col("o.upload_ids")).when(both, F.sort_array(F.array_union("o.upload_ids", "n.upload_ids"))).otherwise(F.coalesce("o.upload_ids", "n.upload_ids"))
    keys = [F.when(F.col("o._o").isNotNull(), F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in KEY]
    return out.select(*keys, pick("invoice_total"), pick("commission_earned"), ids.alias("upload_ids"), F.coalesce("o.statement_date", "n.statement_date").alias("statement_date"), count.alias("statement_count"))


def retract(ledger: DataFrame, contribution: DataFrame, upload_id) -> DataFrame:
    """Take one upload back: rows without other uploads go, others lose its contribution, never below zero."""
    c = contribution.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("invoice_total").alias("_inv"), F.col("commission_earned").alias("_com"))
    on = None
    for k in KEY:
        on = F.col(k).eqNullSafe(F.col(f"_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    held = F.array_contains("upload_ids", F.lit(upload_id))
    out = ledger.join(c, on, "left")
    less = lambda a, b: F.when(held, F.greatest(F.lit(0), F.col(a) - F.coalesce(F.col(b), F.lit(0)))).otherwise(F.col(a)).alias(a)
    out = out.select(*KEY, less("invoice_total", "_inv"), less("commission_earned", "_com"), F.array_remove("upload_ids", F.lit(upload_id)).alias("upload_ids"), "statement_date", F.when(held, F.col("statement_count") - 1).otherwise(F.col("statement_count")).alias("statement_count"))
    return out.where(F.size("upload_ids") > 0)


def rekey_carrier(ledger: DataFrame, source, target) -> DataFrame:
    """Merge one carrier into another: its rows take the target's key and meet the rows already there."""
    moved = ledger.withColumn("carrier_id", F.when(F.col("carrier_id") == source, F.lit(target)).otherwise(F.col("carrier_id")))
    return moved.groupBy(*KEY).agg(
        F.sum("invoice_total").alias("invoice_total"), F.sum("commission_earned").alias("commission_earned"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("upload_ids")))).alias("upload_ids"), F.min("statement_date").alias("statement_date"),
        F.sum("statement_count").alias("statement_count"),
    )


def duplicate_keys(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(*KEY).count().where("count > 1")


def upsert(target: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """Insert or overwrite by key; of several changes to a key the last by ``order`` counts."""
    last = changes.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return target.join(last, key, "left_anti").unionByName(last.select(target.columns))


def add_rows(entries: DataFrame) -> DataFrame:
    """The row-by-row path as one grouping: amounts add, an invoice of zero changes nothing, every row counts."""
    return entries.groupBy(*KEY).agg(
        F.sum("invoice").alias("invoice_total"), F.sum("commission").alias("commission_earned"), F.count("*").alias("statement_count"),
        F.sort_array(F.collect_set("upload_id")).alias("upload_ids"), F.min("statement_date").alias("statement_date"),
    )
