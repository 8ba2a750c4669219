"""Commits: approved, failed half-way, repeated, taken back to three levels, and written by two at once."""

import decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import store

STATEMENTS = "upload_id long, user_id long, stated decimal(15,2), status string"
ENTRIES = "carrier_id long, client_name string, year int, month int, user_id long, environment_id string, upload_id long, statement_date timestamp_ntz, invoice decimal(15,2), commission decimal(20,4)"


def money(x):
    return decimal.Decimal(str(x))


def statements(spark, *rows):
    return spark.createDataFrame([(u, user, money(total), "x") for u, user, total in rows], STATEMENTS)


def entries(spark, *rows):
    return spark.createDataFrame([(c, name, y, m, user, env, u, None, money(inv), money(com)) for c, name, y, m, user, env, u, inv, com in rows], ENTRIES)


def state(held):
    ledger = sorted((tuple(r) for r in held.read("ledger", store.LEDGER).select("carrier_id", "client_name", "year", "month", "user_id", "environment_id", F.col("invoice_total").cast("double"), F.col("commission_earned").cast("double"), F.col("upload_ids").cast("string"), "statement_count").collect()), key=str)
    return ledger, sorted((r.upload_id, r.status) for r in held.read("uploads", store.UPLOADS).collect())


@pytest.fixture
def held(spark, tmp_path):
    return store.approvals(spark, f"file://{tmp_path}/store")


def some(spark):
    s = statements(spark, (1, 10, 100), (2, 10, 50), (3, 20, 7))
    e = entries(spark, (1, "a", 2024, 1, 10, "x", 1, 60, 6), (1, "a", 2024, 1, 10, "x", 1, 40, 4), (1, "a", 2024, 1, 10, "x", 2, 30, 3), (2, "b", 2023, 5, 10, None, 2, 21, 1), (2, None, None, None, 20, None, 3, 1, 1))
    return s, e


def test_approve_fail_repeat(spark, held, monkeypatch):
    s, e = some(spark)
    assert state(held) == ([], [])
    assert store.approve(held, "one", s.where("upload_id <> 2"), e)
    first = state(held)
    assert first == ([(1, "a", 2024, 1, 10, "x", 100.0, 10.0, "[1]", 1), (2, None, None, None, 20, None, 1.0, 1.0, "[3]", 1)], [(1, "Approved"), (3, "needs_review")])
    publish = store.Store._publish

    def fails(self, manifest):
        raise OSError("lost")

    monkeypatch.setattr(store.Store, "_publish", fails)
    with pytest.raises(OSError):
        store.approve(held, "two", s.where("upload_id = 2"), e)
    assert state(held) == first and not held.applied("two")
    monkeypatch.setattr(store.Store, "_publish", publish)
    assert store.approve(held, "two", s.where("upload_id = 2"), e)
    both = state(held)
    assert both[0][0] == (1, "a", 2024, 1, 10, "x", 130.0, 13.0, "[1, 2]", 2) and (2, "needs_review") not in first[1] and (2, "Approved") in both[1]
    assert not store.approve(held, "two", s.where("upload_id = 2"), e) and state(held) == both
    assert store.approve(held, "again", s.where("upload_id = 3"), e)  # another name, the same upload: it replaces
    assert state(held) == both


def test_untouched_partitions_stay(spark, held):
    s, e = some(spark)
    store.approve(held, "one", s, e)
    before = held.manifest()["tables"]["ledger"]
    assert set(before) == {"2024", "2023", store.NONE}
    store.approve(held, "two", statements(spark, (4, 10, 5)), entries(spark, (9, "z", 2023, 1, 10, "x", 4, 5, 1)))
    after = held.manifest()["tables"]["ledger"]
    assert after["2024"] == before["2024"] and after[store.NONE] == before[store.NONE] and after["2023"] != before["2023"]
    now = state(held)
    assert held.vacuum() == 0  # both folders of the ledger are in use
    store.approve(held, "three", s, e)
    assert held.vacuum() >= 2 and state(held) == now
    assert held.read("ledger", store.LEDGER, [None]).count() == 1 and held.read("ledger", store.LEDGER, [1900]).count() == 0


def test_cascade_and_conflict(spark, held):
    s, e = some(spark)
    store.approve(held, "one", s, e)
    base = held.manifest()
    company = spark.createDataFrame([(10, 7), (20, 8)], "user_id long, company_id int").where("company_id = 7").select("user_id")
    assert store.forget_users(held, "company-7", company)
    assert state(held) == ([(2, None, None, None, 20, None, 1.0, 1.0, "[3]", 1)], [(3, "needs_review")])
    assert set(held.manifest()["tables"]["ledger"]) == {store.NONE}  # emptied partitions are gone
    assert not store.forget_users(held, "company-7", company)
    rows = held.read("ledger", store.LEDGER, None, base)
    with pytest.raises(store.Conflict):  # begun before the deletion was published
        held.commit("late", {"ledger": (rows, held.touched("ledger", rows))}, base)
    with pytest.raises(ValueError):
        held.commit("odd", {"ledger": (rows.withColumn("year", F.lit(1999)), [2024])}, held.manifest())
    assert state(held)[1] == [(3, "needs_review")]
    empty = statements(spark, (1, 1, 1)).where("upload_id < 0")
    assert store.approve(held, "nothing", empty, e) and state(held)[1] == [(3, "needs_review")]
