"""What a task holds must not grow with the tables: rows are dealt by number, and alike rows are worked out once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom import plans
from ledgerloom.functions import composites
from ledgerloom.operators import formats, ledger
from ledgerloom.sources import binding


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_entries_dealt(spark, sf, monkeypatch):
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    plain, whole = digest(binding.entries(spark, sf)), binding.read(spark, sf, "lineitem").count()
    monkeypatch.setattr(binding, "ROWS", 500)
    n = -(-whole // 500)
    assert n > 4  # the session's partitions
    for by in (None, ledger.KEY):
        found = binding.entries(spark, sf, by)
        assert f"], {n}" in plan_of(found) and digest(found) == plain
    assert binding.order_lines(spark, sf).rdd.getNumPartitions() == n


@pytest.mark.parametrize("name", ["nearest_formats", "top_performing_carriers", "environment_stats", "duplicate_ledger_keys", "ledger_month_pivot"])
def test_same_rows_dealt(spark, sf, monkeypatch, name):
    rows = lambda: sorted(map(str, plans.QUERIES[name](spark, sf).collect()))
    plain = rows()
    monkeypatch.setattr(binding, "ROWS", 500)
    assert "RepartitionByExpression" in plan_of(plans.QUERIES[name](spark, sf)) and rows() == plain


def test_pivot_moves_one_sum(spark, sf):
    plan = plan_of(plans.QUERIES["ledger_month_pivot"](spark, sf))
    assert plan.count("Aggregate") == 2  # months before columns


def test_formats_by_kind_of_table(spark):
    """Tables take the best format of their kind; candidates are never joined to single tables. A missing has_header is one of the kinds."""
    schema = "company_id long, upload_id long, table_idx long, header array<string>, n_columns int, n_rows int, has_header boolean"
    t = spark.createDataFrame([(1, u, i, ["Client", "Paid"], 2, 9, None if u % 2 else True) for u in range(30) for i in range(2)], schema)
    f = spark.createDataFrame([(1, 7, 3, ["Client", "Paid"], 2, 9, True), (1, 8, 4, ["Client", "Paid"], 2, 9, True)], "company_id long, format_id long, last_used long, header array<string>, n_columns int, n_rows int, has_header boolean")
    found = formats.best_formats(t, f)
    top = plan_of(found).split("Join Inner", 2)
    assert "<=>" in top[1]
    got = {(r.upload_id, r.table_idx): (r.format_id, round(r.score, 9)) for r in found.collect()}
    assert got == {(u, i): (8, round(0.84 - 0.1 / 3, 9) if u % 2 else 0.84) for u in range(30) for i in range(2)}


def test_fixed_reference_read_once(spark):
    df = spark.range(3).select(composites.column_fit(F.col("id").cast("string"), F.lit("L221")).alias("x"))
    assert "lambda" not in plan_of(df)
