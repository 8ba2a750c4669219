"""Approvals that are written: two batches, one of them repeated, and a company deleted with all that hangs on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..sources.binding import ENTRIES_SQL, UPLOADS_SQL, entries, uploads, users
from ..streaming.keyed import new_folder
from .catalogue import query

WRITTEN_SQL = f"""{ENTRIES_SQL}, {UPLOADS_SQL}, s AS (SELECT * FROM uploads WHERE status <> 'other' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)),
 e AS (SELECT e.* FROM entries AS e JOIN s ON s.upload_id = e.upload_id)"""


def written(spark, sf):
    """The store after both batches, the repeat and the deletion of company 3."""
    held = store.approvals(spark, new_folder(spark, "approvals"))
    pending, lines = uploads(spark, sf).where("status <> 'other'").select("upload_id", "user_id", F.col("stated_total").alias("stated")), entries(spark, sf)
    for name, rest in (("even", 0), ("odd", 1), ("even", 0)):
        store.approve(held, name, pending.where(F.col("upload_id") % 2 == rest), lines)
    store.forget_users(held, "company-3", users(spark, sf).where("company_id = 3").select("user_id"))
    return held


@query(f"""WITH {WRITTEN_SQL}, k AS (SELECT carrier_id, client_name, month, year, user_id, environment_id, sum(invoice) AS i, sum(commission) AS c, count(DISTINCT upload_id % 2) AS n, string_agg(DISTINCT upload_id, ',' ORDER BY upload_id) AS u FROM e GROUP BY ALL)
 SELECT carrier_id, client_name, month::INTEGER AS month, year::INTEGER AS year, environment_id, CAST(i AS DOUBLE) AS invoice_total, CAST(c AS DOUBLE) AS commission_earned, n::INTEGER AS statement_count, u AS uploads FROM k""")
def committed_ledger(spark, sf):
    """The ledger as the commits left it."""
    t = written(spark, sf).read("ledger", store.LEDGER)
    ids = F.array_join(F.transform("upload_ids", lambda x: x.cast("string")), ",")
    return t.select("carrier_id", "client_name", "month", "year", "environment_id", F.col("invoice_total").cast("double"), F.col("commission_earned").cast("double"), "statement_count", ids.alias("uploads"))


@query(f"""WITH {WRITTEN_SQL}, c AS (SELECT s.upload_id, s.user_id, CAST(any_value(stated_total) AS DOUBLE) AS stated, CAST(coalesce(sum(invoice), 0) AS DOUBLE) AS calculated FROM s LEFT JOIN e ON e.upload_id = s.upload_id GROUP BY 1, 2)
 SELECT upload_id, user_id, stated, calculated, CASE WHEN calculated < 0.01 THEN 'needs_review' WHEN stated = 0 THEN 'Approved' WHEN abs(calculated - stated) / abs(stated) * 100 < 5 THEN 'Approved' ELSE 'needs_review' END AS status FROM c""")
def committed_uploads(spark, sf):
    """The uploads as the commits left them, with the status their totals gave them."""
    t = written(spark, sf).read("uploads", store.UPLOADS)
    return t.select("upload_id", "user_id", F.col("stated").cast("double"), F.col("calculated").cast("double"), "status")
