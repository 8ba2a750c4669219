"""The statement domain as views of the TPC-H-like tables.

carrier = supplier, client = customer of the order, user = customer, company of a user = nation,
upload = order, ledger rows = line items (environment = return flag), activity = events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ROWS = 1 << 18  # of a table, for each task that sorts or groups them
STATUS = {"F": "Approved", "O": "needs_review"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks(rows: DataFrame) -> int:
    """How many tasks hold the rows of a stored table at ROWS each; the count reads no column."""
    return -(-rows.count() // ROWS)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by key to ``n`` tasks, so that what a task sorts and groups does not grow with the table; up to the
    session's number of partitions they are left as they are, to be broadcast or dealt as Spark finds best."""
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, each order's in one task."""
    lines = read(spark, sf_dir, "lineitem")
    return dealt(lines, tasks(lines), "l_orderkey")


def money(name: str):
    """A price column as an exact amount; the base columns have two decimals, products are taken afterwards."""
    return F.col(name).cast("decimal(15,2)")


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("carrier_id"), F.col("s_name").alias("carrier_name"), F.col("s_nationkey").alias("nation"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), F.col("c_nationkey").alias("company_id"), F.col("c_mktsegment").alias("role"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Approved").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("other")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("uploaded_at"), money("o_totalprice").alias("stated_total"))


def entries(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    """One row per statement line: who paid what to whom, in which month, from which upload. ``by``: the key that many rows are to be
    dealt by; without it lines are only moved to their orders, which meet their clients before."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate", "l_returnflag", money("l_extendedprice").alias("invoice"), money("l_discount").alias("rate"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    clients = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("client_name"))
    n, owned = tasks(lines), orders.join(clients, F.col("o_custkey") == F.col("c_custkey"))
    out = dealt(lines, n, "l_orderkey").join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.select(
        F.col("l_suppkey").alias("carrier_id"), "client_name", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        F.col("o_custkey").alias("user_id"), F.col("l_returnflag").alias("environment_id"), F.col("l_orderkey").alias("upload_id"),
        F.col("l_shipdate").alias("statement_date"), "invoice", (F.col("invoice") * F.col("rate")).cast("decimal(20,4)").alias("commission"),
    )
    return dealt(out, n, *by) if by else out


ENTRIES_SQL = """entries AS (
  SELECT l_suppkey AS carrier_id, c_name AS client_name, year(l_shipdate) AS year, month(l_shipdate) AS month, o_custkey AS user_id,
         l_returnflag AS environment_id, l_orderkey AS upload_id, l_shipdate AS statement_date,
         CAST(l_extendedprice AS DECIMAL(15,2)) AS invoice,
         CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2)) AS DECIMAL(20,4)) AS commission
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

UPLOADS_SQL = """uploads AS (
  SELECT o_orderkey AS upload_id, o_custkey AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'needs_review' ELSE 'other' END AS status,
         o_orderdate AS uploaded_at, CAST(o_totalprice AS DECIMAL(15,2)) AS stated_total FROM orders)"""
