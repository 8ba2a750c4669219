"""Dashboard and report reads: filters, joins, aggregations, sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger
from ..sources.binding import ENTRIES_SQL, MONTHS, UPLOADS_SQL, carriers, entries, read, uploads, users
from .catalogue import query

VISIBLE = ["Approved", "needs_review"]
dbl = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")
MONTH_SQL = ", ".join(f"CAST(coalesce(sum(CASE WHEN month = {i} THEN commission END), 0) AS DOUBLE) AS {m}_commission" for i, m in enumerate(MONTHS, 1))


@query(f"""WITH {ENTRIES_SQL} SELECT client_name, CAST(sum(invoice) AS DOUBLE) AS invoice_total, CAST(sum(commission) AS DOUBLE) AS commission_earned,
  {MONTH_SQL}, count(DISTINCT carrier_id) AS carrier_count, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS carrier_names,
  count(DISTINCT upload_id) AS statement_count FROM entries JOIN supplier ON carrier_id = s_suppkey GROUP BY client_name""")
def companies_aggregated(spark, sf):
    """Commission by client across carriers, largest first."""
    e = entries(spark, sf).groupBy("client_name", "carrier_id", "month").agg(F.sum("invoice").alias("invoice"), F.sum("commission").alias("commission"), F.collect_set("upload_id").alias("uploads"))
    months = [dbl(F.coalesce(F.sum(F.when(F.col("month") == i, F.col("commission"))), F.lit(0))).alias(f"{m}_commission") for i, m in enumerate(MONTHS, 1)]
    names = carriers(spark, sf).select("carrier_id", "carrier_name")
    out = e.join(names, "carrier_id").groupBy("client_name").agg(
        dbl(F.sum("invoice")).alias("invoice_total"), dbl(F.sum("commission")).alias("commission_earned"), *months,
        F.size(F.collect_set("carrier_id")).cast("long").alias("carrier_count"), F.array_join(F.sort_array(F.collect_set("carrier_name")), ",").alias("carrier_names"),
        F.size(F.array_distinct(F.flatten(F.collect_list("uploads")))).cast("long").alias("statement_count"),
    )
    return out.orderBy(F.desc("commission_earned"), "client_name")


@query(f"""WITH {UPLOADS_SQL} SELECT count(*) AS total, count(*) FILTER (status IN ('Approved','needs_review')) AS visible, count(*) FILTER (status = 'Approved') AS approved,
  count(*) FILTER (status = 'needs_review') AS pending, count(*) FILTER (status NOT IN ('Approved','needs_review')) AS hidden, count(DISTINCT user_id) AS active_users, CAST(sum(stated_total) AS DOUBLE) AS stated FROM uploads""")
def dashboard_stats(spark, sf):
    s = F.col("status")
    return uploads(spark, sf).agg(
        F.count("*").alias("total"), F.count_if(s.isin(VISIBLE)).alias("visible"), F.count_if(s == "Approved").alias("approved"), F.count_if(s == "needs_review").alias("pending"),
        F.count_if(~s.isin(VISIBLE)).alias("hidden"), F.countDistinct("user_id").alias("active_users"), dbl(F.sum("stated_total")).alias("stated"),
    )


def carrier_uploads(spark, sf) -> DataFrame:
    """(carrier_id, upload_id, status): an upload belongs to each carrier its lines name."""
    lines = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("carrier_id"), F.col("l_orderkey").alias("upload_id")).distinct()
    return lines.join(uploads(spark, sf).select("upload_id", "user_id", "status"), "upload_id")


CARRIER_UPLOADS_SQL = UPLOADS_SQL + """, carrier_uploads AS (SELECT DISTINCT l_suppkey AS carrier_id, upload_id, user_id, status FROM lineitem JOIN uploads ON l_orderkey = upload_id)"""


@query(f"""WITH {CARRIER_UPLOADS_SQL} SELECT s_suppkey AS carrier_id, s_name AS carrier_name, count(upload_id) AS statement_count
  FROM supplier LEFT JOIN carrier_uploads ON carrier_id = s_suppkey AND status IN ('Approved','needs_review') GROUP BY 1, 2""")
def carriers_with_counts(spark, sf):
    """Every carrier with its visible uploads; the status test belongs to the join, so carriers without any stay."""
    seen = carrier_uploads(spark, sf).where(F.col("status").isin(VISIBLE)).groupBy("carrier_id").agg(F.count("*").alias("n"))
    return carriers(spark, sf).join(seen, "carrier_id", "left").select("carrier_id", "carrier_name", F.coalesce("n", F.lit(0)).alias("statement_count"))


@query(f"""WITH {ENTRIES_SQL} SELECT carrier_id, client_name, month, year, user_id, environment_id, CAST(sum(invoice) AS DOUBLE) AS invoice_total,
  CAST(sum(commission) AS DOUBLE) AS commission_earned, count(DISTINCT upload_id) AS statement_count, CAST(min(statement_date) AS DATE) AS first_date FROM entries GROUP BY ALL""")
def ledger_build(spark, sf):
    out = ledger.build(entries(spark, sf, ledger.KEY))
    return out.select("carrier_id", "client_name", "month", "year", "user_id", "environment_id", dbl("invoice_total").alias("invoice_total"), dbl("commission_earned").alias("commission_earned"), F.col("statement_count").cast("long"), F.to_date("statement_date").alias("first_date"))


@query(f"""WITH {ENTRIES_SQL} SELECT carrier_id, year, {MONTH_SQL} FROM entries GROUP BY carrier_id, year""")
def ledger_month_pivot(spark, sf):
    months = entries(spark, sf).groupBy("carrier_id", "year", "month").agg(F.sum("commission").alias("commission_earned"))  # one sum a row, not twelve, is moved
    rows = months.groupBy("carrier_id", "year").agg(*ledger.month_columns())
    return rows.select("carrier_id", "year", *[dbl(f"{m}_commission").alias(f"{m}_commission") for m in MONTHS])


@query(f"""WITH {ENTRIES_SQL} SELECT s_name AS carrier_name, CAST(sum(commission) AS DOUBLE) AS total, count(*) AS n FROM entries JOIN supplier ON carrier_id = s_suppkey GROUP BY s_name ORDER BY total DESC, s_name""")
def carrier_totals_desc(spark, sf):
    rows = entries(spark, sf).groupBy("carrier_id").agg(F.sum("commission").alias("c"), F.count("*").alias("n")).join(carriers(spark, sf), "carrier_id")
    return rows.groupBy("carrier_name").agg(dbl(F.sum("c")).alias("total"), F.sum("n").alias("n")).orderBy(F.desc("total"), "carrier_name")


@query(f"""WITH {CARRIER_UPLOADS_SQL} SELECT s_suppkey AS carrier_id, (SELECT count(*) FROM carrier_uploads c WHERE c.carrier_id = s_suppkey AND status = 'Approved') AS approved,
  (SELECT count(*) FROM carrier_uploads c WHERE c.carrier_id = s_suppkey) AS all_uploads FROM supplier""")
def carrier_counts_batched(spark, sf):
    """Counts per carrier in one grouping instead of one query per carrier."""
    n = carrier_uploads(spark, sf).groupBy("carrier_id").agg(F.count_if(F.col("status") == "Approved").alias("a"), F.count("*").alias("b"))
    return carriers(spark, sf).join(n, "carrier_id", "left").select("carrier_id", F.coalesce("a", F.lit(0)).alias("approved"), F.coalesce("b", F.lit(0)).alias("all_uploads"))


@query(f"""WITH {ENTRIES_SQL}, {UPLOADS_SQL}, t AS (SELECT upload_id, sum(commission) AS c FROM entries GROUP BY 1)
  SELECT u.upload_id, status, CAST(nullif(c, 0) AS DOUBLE) AS actual_total FROM uploads u LEFT JOIN t ON t.upload_id = u.upload_id""")
def statement_actual_totals(spark, sf):
    """Calculated total of each upload; absent and zero totals are both null, as the domain reads them."""
    one = entries(spark, sf).groupBy("upload_id").agg(F.sum("commission").alias("c"))
    return uploads(spark, sf).join(one, "upload_id", "left").select("upload_id", "status", dbl(F.when(F.col("c") != 0, F.col("c"))).alias("actual_total"))


@query("SELECT DISTINCT year(l_shipdate) AS year FROM lineitem WHERE l_shipdate IS NOT NULL ORDER BY year DESC")
def available_years(spark, sf):
    return read(spark, sf, "lineitem").where("l_shipdate is not null").select(F.year("l_shipdate").alias("year")).distinct().orderBy(F.desc("year"))


@query(f"""WITH {ENTRIES_SQL} SELECT CAST(sum(invoice) AS DOUBLE) AS invoice, CAST(sum(commission) AS DOUBLE) AS commission, count(DISTINCT lower(trim(client_name))) AS clients,
  count(DISTINCT carrier_id) AS carriers, count(*) AS n, CAST(sum(commission) AS DOUBLE) / CAST(sum(invoice) AS DOUBLE) * 100 AS rate FROM entries""")
def commission_summary(spark, sf):
    one = entries(spark, sf).agg(dbl(F.sum("invoice")).alias("invoice"), dbl(F.sum("commission")).alias("commission"), F.countDistinct(F.lower(F.trim("client_name"))).alias("clients"), F.countDistinct("carrier_id").alias("carriers"), F.count("*").alias("n"))
    return one.withColumn("rate", F.col("commission") / F.col("invoice") * 100)


@query(f"""WITH {UPLOADS_SQL} SELECT c_custkey AS user_id, c_name AS user_name, count(upload_id) AS n, coalesce(sum(CASE WHEN status = 'Approved' THEN 1 ELSE 0 END), 0)::BIGINT AS approved,
  coalesce(sum(CASE WHEN status = 'needs_review' THEN 1 ELSE 0 END), 0)::BIGINT AS pending, max(uploaded_at) AS last_upload, 100.0::DOUBLE * coalesce(sum(CASE WHEN status = 'Approved' THEN 1 ELSE 0 END), 0)::DOUBLE / greatest(count(upload_id), 1) AS approval_share
  FROM customer LEFT JOIN uploads ON user_id = c_custkey GROUP BY 1, 2""")
def user_upload_stats(spark, sf):
    u = uploads(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Approved").alias("approved"), F.count_if(F.col("status") == "needs_review").alias("pending"), F.max("uploaded_at").alias("last_upload"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = users(spark, sf).join(u, "user_id", "left")
    return out.select("user_id", "user_name", zero("n").alias("n"), zero("approved").alias("approved"), zero("pending").alias("pending"), "last_upload", (F.lit(100.0) * zero("approved").cast("double") / F.greatest(zero("n"), F.lit(1))).alias("approval_share"))


@query("""WITH span AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
  SELECT day, count(event_id) AS n, count(DISTINCT user_id) AS users FROM days LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY day""")
def activity_by_day(spark, sf):
    """Events per calendar day, days without any included."""
    per = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    days = per.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def top_contributors(spark, sf):
    return read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query(f"WITH {UPLOADS_SQL} SELECT status, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS share FROM uploads GROUP BY status")
def status_distribution(spark, sf):
    n = uploads(spark, sf).groupBy("status").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("SELECT s_suppkey AS carrier_id, s_name AS carrier_name FROM supplier WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900)")
def carriers_without_users(spark, sf):
    rich = read(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    return carriers(spark, sf).join(rich, "nation", "left_anti").select("carrier_id", "carrier_name")


@query(f"WITH {UPLOADS_SQL} SELECT upload_id, user_id FROM uploads WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 7))")
def company_users_semi(spark, sf):
    """Uploads of everyone in a user's company: the tenancy scope ``all_data``."""
    return scope(uploads(spark, sf), users(spark, sf), 7, "all_data").select("upload_id", "user_id")


def scope(rows: DataFrame, people: DataFrame, me, mode: str, admin: bool = False) -> DataFrame:
    """Rows a user may see: their own, or all of their company's; without a company only their own."""
    if admin:
        return rows
    if mode == "my_data":
        return rows.where(F.col("user_id") == me)
    mine = people.where((F.col("user_id") == me) & F.col("company_id").isNotNull()).select("company_id")
    near = people.join(mine, "company_id", "left_semi").select("user_id").unionByName(people.sparkSession.createDataFrame([(me,)], "user_id long")).distinct()
    return rows.join(near, "user_id", "left_semi")


@query(f"WITH {UPLOADS_SQL} SELECT upload_id, status FROM uploads WHERE user_id = 7")
def scope_own(spark, sf):
    return scope(uploads(spark, sf), users(spark, sf), 7, "my_data").select("upload_id", "status")


@query("SELECT sha256(text) AS file_hash, count(*) AS copies, min(doc_id) AS original FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_files(spark, sf):
    return read(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("original")).where("copies > 1")


@query(f"WITH {UPLOADS_SQL} SELECT user_id, upload_id, status FROM uploads QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC, upload_id) = 1")
def latest_upload_per_user(spark, sf):
    best = F.max_by(F.struct("upload_id", "status"), F.struct("uploaded_at", -F.col("upload_id"))).alias("u")
    return uploads(spark, sf).groupBy("user_id").agg(best).select("user_id", "u.upload_id", "u.status")


@query(f"WITH {ENTRIES_SQL} SELECT carrier_id, client_name, month, year, user_id, environment_id, count(*) AS n FROM entries GROUP BY ALL HAVING count(*) > 1")
def duplicate_ledger_keys(spark, sf):
    return ledger.duplicate_keys(entries(spark, sf, ledger.KEY)).select(*ledger.KEY, F.col("count").alias("n"))


@query(f"""WITH {CARRIER_UPLOADS_SQL}, s AS (SELECT s_suppkey AS id, (SELECT count(*) FROM carrier_uploads WHERE carrier_id = s_suppkey AND status = 'Approved') AS a,
  (SELECT count(*) FROM orders WHERE o_custkey = s_suppkey) AS b FROM supplier) SELECT id, CASE WHEN a > 0 AND b > 0 THEN 'mixed' WHEN a > 0 THEN 'carrier' WHEN b > 0 THEN 'broker' ELSE 'unknown' END AS role FROM s""")
def role_classification(spark, sf):
    a = carrier_uploads(spark, sf).where("status = 'Approved'").groupBy(F.col("carrier_id").alias("id")).agg(F.count("*").alias("a"))
    b = uploads(spark, sf).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("b"))
    out = carriers(spark, sf).select(F.col("carrier_id").alias("id")).join(a, "id", "left").join(b, "id", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return out.select("id", F.when(has("a") & has("b"), "mixed").when(has("a"), "carrier").when(has("b"), "broker").otherwise("unknown").alias("role"))


@query("""WITH h AS (SELECT sha256(text) AS k, count(*) AS n FROM documents GROUP BY 1) SELECT sum(n)::BIGINT AS uploads, sum(n - 1)::BIGINT AS duplicates, 100.0::DOUBLE * sum(n - 1)::DOUBLE / greatest(1, sum(n)::BIGINT) AS rate FROM h""")
def duplicate_rate(spark, sf):
    h = read(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.count("*").alias("n"))
    one = h.agg(F.sum("n").alias("uploads"), F.sum(F.col("n") - 1).alias("duplicates"))
    return one.withColumn("rate", F.lit(100.0) * F.col("duplicates").cast("double") / F.greatest(F.lit(1), F.col("uploads")))


@query(f"""WITH {ENTRIES_SQL}, g AS (SELECT carrier_id, CAST(sum(invoice) AS DOUBLE) AS inv, CAST(sum(commission) AS DOUBLE) AS com, count(DISTINCT upload_id) AS n FROM entries GROUP BY 1)
  SELECT s_name AS carrier_name, inv, com, n, com / n AS per_statement, CASE WHEN inv > 0 THEN com / inv * 100 ELSE 0 END AS rate FROM g JOIN supplier ON carrier_id = s_suppkey ORDER BY com DESC, carrier_name LIMIT 5""")
def top_performing_carriers(spark, sf):
    g = entries(spark, sf).groupBy("carrier_id").agg(dbl(F.sum("invoice")).alias("inv"), dbl(F.sum("commission")).alias("com"), F.countDistinct("upload_id").alias("n"))
    g = g.join(carriers(spark, sf), "carrier_id").orderBy(F.desc("com"), "carrier_name").limit(5)
    return g.select("carrier_name", "inv", "com", "n", (F.col("com") / F.col("n")).alias("per_statement"), F.when(F.col("inv") > 0, F.col("com") / F.col("inv") * 100).otherwise(0.0).alias("rate"))


@query(f"WITH {ENTRIES_SQL} SELECT year, month, CAST(sum(commission) AS DOUBLE) AS total, count(*) AS n FROM entries WHERE commission > 0 GROUP BY 1, 2")
def monthly_totals(spark, sf):
    """From the month columns back to rows: only positive months count."""
    wide = entries(spark, sf).groupBy("year").agg(*[F.sum(F.when((F.col("month") == i) & (F.col("commission") > 0), F.col("commission"))).alias(f"v{i}") for i in range(1, 13)], *[F.count_if((F.col("month") == i) & (F.col("commission") > 0)).alias(f"n{i}") for i in range(1, 13)])
    long = wide.select("year", F.explode(F.array(*[F.struct(F.lit(i).alias("month"), F.col(f"v{i}").alias("v"), F.col(f"n{i}").alias("n")) for i in range(1, 13)])).alias("x"))
    return long.where("x.v > 0").select("year", "x.month", dbl("x.v").alias("total"), "x.n")


@query("SELECT coalesce(p_type, 'Other') AS plan, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS premium, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 100")
def plan_distribution(spark, sf):
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.coalesce("p_type", F.lit("Other")).alias("plan")).agg(dbl(F.sum(F.col("l_extendedprice").cast("decimal(15,2)"))).alias("premium"), F.count("*").alias("n")).where("n >= 100")


@query(f"WITH {ENTRIES_SQL}, g AS (SELECT carrier_id, CAST(sum(commission) AS DOUBLE) AS com, sum(commission) AS x FROM entries GROUP BY 1) SELECT carrier_id, com / CAST(sum(x) OVER () AS DOUBLE) * 100 AS share FROM g")
def percent_of_total(spark, sf):
    g = entries(spark, sf).groupBy("carrier_id").agg(F.sum("commission").alias("x"))
    total = F.broadcast(g.agg(dbl(F.sum("x")).alias("t")).withColumn("one", F.lit(1)))  # one row
    return g.withColumn("one", F.lit(1)).join(total, "one").select("carrier_id", (dbl("x") / F.col("t") * 100).alias("share"))


@query(f"""WITH {ENTRIES_SQL}, c AS (SELECT carrier_id, client_name, sum(commission) AS com, sum(invoice) AS inv FROM entries GROUP BY 1, 2)
  SELECT carrier_id, CAST(sum(com) AS DOUBLE) / count(*) AS per_client, CAST(sum(com) AS DOUBLE) / CAST(sum(inv) AS DOUBLE) AS rate, arg_max(client_name, (com, client_name)) AS top_client FROM c GROUP BY 1""")
def carrier_enrichment(spark, sf):
    c = entries(spark, sf).groupBy("carrier_id", "client_name").agg(F.sum("commission").alias("com"), F.sum("invoice").alias("inv"))
    return c.groupBy("carrier_id").agg((dbl(F.sum("com")) / F.count("*")).alias("per_client"), (dbl(F.sum("com")) / dbl(F.sum("inv"))).alias("rate"), F.max_by("client_name", F.struct("com", "client_name")).alias("top_client"))


@query(f"""WITH {ENTRIES_SQL}, g AS (SELECT client_name, carrier_id, sum(commission) AS c FROM entries GROUP BY 1, 2) SELECT CASE WHEN c > 5000 THEN 'high' WHEN c >= 1000 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n, CAST(sum(c) AS DOUBLE) AS total FROM g GROUP BY 1""")
def commission_tiers(spark, sf):
    g = entries(spark, sf).groupBy("client_name", "carrier_id").agg(F.sum("commission").alias("c"))
    tier = F.when(F.col("c") > 5000, "high").when(F.col("c") >= 1000, "medium").otherwise("low")
    return g.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), dbl(F.sum("c")).alias("total"))


@query(f"""WITH {ENTRIES_SQL}, m AS (SELECT carrier_id, month, CAST(sum(commission) AS DOUBLE) AS v, sum(commission) AS x FROM entries GROUP BY 1, 2), s AS (SELECT carrier_id, max(v) AS hi, min(v) AS lo, CAST(sum(x) AS DOUBLE) / count(*) AS mean,
  arg_max(month, (v, -month)) AS peak, arg_min(month, (v, month)) AS low FROM m WHERE v > 0 GROUP BY 1) SELECT *, (hi - lo) / mean * 100 AS variance, CASE WHEN (hi - lo) / mean * 100 > 50 THEN 'high' WHEN (hi - lo) / mean * 100 > 25 THEN 'medium' ELSE 'low' END AS class FROM s""")
def seasonality(spark, sf):
    m = entries(spark, sf).groupBy("carrier_id", "month").agg(F.sum("commission").alias("x")).withColumn("v", dbl("x")).where("v > 0")
    s = m.groupBy("carrier_id").agg(F.max("v").alias("hi"), F.min("v").alias("lo"), (dbl(F.sum("x")) / F.count("*")).alias("mean"), F.max_by("month", F.struct("v", -F.col("month"))).alias("peak"), F.min_by("month", F.struct("v", "month")).alias("low"))
    s = s.withColumn("variance", (F.col("hi") - F.col("lo")) / F.col("mean") * 100)
    return s.withColumn("class", F.when(F.col("variance") > 50, "high").when(F.col("variance") > 25, "medium").otherwise("low"))


@query(f"""WITH {ENTRIES_SQL}, g AS (SELECT carrier_id, sum(commission) AS x, row_number() OVER (ORDER BY sum(commission) DESC, carrier_id) AS r FROM entries GROUP BY 1)
  SELECT CAST(sum(CASE WHEN r = 1 THEN x END) AS DOUBLE) / CAST(sum(x) AS DOUBLE) * 100 AS top1, CAST(sum(CASE WHEN r <= 3 THEN x END) AS DOUBLE) / CAST(sum(x) AS DOUBLE) * 100 AS top3, 100 - CAST(sum(CASE WHEN r <= 3 THEN x END) AS DOUBLE) / CAST(sum(x) AS DOUBLE) * 100 AS score,
  CASE WHEN CAST(sum(CASE WHEN r = 1 THEN x END) AS DOUBLE) / CAST(sum(x) AS DOUBLE) * 100 > 50 THEN 'high' WHEN CAST(sum(CASE WHEN r = 1 THEN x END) AS DOUBLE) / CAST(sum(x) AS DOUBLE) * 100 > 30 THEN 'medium' ELSE 'low' END AS risk FROM g""")
def diversification(spark, sf):
    """Share of the largest carrier and of the three largest; the ranks come from a top-3, not from a global sort."""
    g = entries(spark, sf).groupBy("carrier_id").agg(F.sum("commission").alias("x"))
    best = g.orderBy(F.desc("x"), "carrier_id").limit(3).agg(F.sort_array(F.collect_list("x"), asc=False).alias("b"))
    total = g.agg(dbl(F.sum("x")).alias("t"))
    three = F.aggregate("b", F.lit(0).cast("decimal(30,4)"), lambda s, x: (s + x).cast("decimal(30,4)"))
    both = best.withColumn("k", F.lit(1)).join(total.withColumn("k", F.lit(1)), "k")
    top1, top3 = dbl(F.col("b")[0]) / F.col("t") * 100, dbl(three) / F.col("t") * 100
    return both.select(top1.alias("top1"), top3.alias("top3"), (100 - top3).alias("score"), F.when(top1 > 50, "high").when(top1 > 30, "medium").otherwise("low").alias("risk"))


@query("SELECT event_type, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi, count(*) AS n FROM events GROUP BY 1")
def value_stats(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS median, v[CAST(floor(len(v) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.99) AS BIGINT) + 1] AS p99 FROM s""")
def index_percentiles(spark, sf):
    """Percentiles by index into the sorted values, not interpolated; distinct values with their counts are ranked, not rows."""
    e = read(spark, sf, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("k"))
    w = Window.partitionBy("event_type")
    r = e.withColumn("after", F.sum("k").over(w.orderBy("value"))).withColumn("n", F.sum("k").over(w))
    at = lambda p: F.min(F.when(F.col("after") > F.floor(F.col("n") * p), F.col("value")))
    return r.groupBy("event_type").agg(at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query(f"""WITH {ENTRIES_SQL}, m AS (SELECT year, month, CAST(sum(commission) AS DOUBLE) AS v FROM entries GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY year ORDER BY month) AS p FROM m)
  SELECT year, month, CASE WHEN p IS NULL OR p = 0 OR count(*) FILTER (v > 0) OVER (PARTITION BY year) < 3 THEN 0.0 ELSE round(greatest(-100.0, least(100.0, (v - p) / p * 100)), 1) END AS growth FROM l""")
def month_growth(spark, sf):
    m = entries(spark, sf).groupBy("year", "month").agg(dbl(F.sum("commission")).alias("v"))
    p = F.lag("v").over(Window.partitionBy("year").orderBy("month"))
    return m.select("year", "month", F.when(p.isNull() | (p == 0) | (F.count_if(F.col("v") > 0).over(Window.partitionBy("year")) < 3), 0.0).otherwise(F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), (F.col("v") - p) / p * 100)), 1)).alias("growth"))


@query(f"""WITH {ENTRIES_SQL}, m AS (SELECT carrier_id, year, month, sum(commission) AS v FROM entries GROUP BY 1, 2, 3), w AS (SELECT *, sum(v) OVER a AS recent, sum(v) OVER b AS before FROM m
  WINDOW a AS (PARTITION BY carrier_id ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY carrier_id ORDER BY year, month ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING))
  SELECT carrier_id, year, month, CASE WHEN before IS NULL THEN 'stable' WHEN recent > before * 1.05 THEN 'up' WHEN recent < before * 0.95 THEN 'down' ELSE 'stable' END AS trend FROM w""")
def carrier_trend(spark, sf):
    m = entries(spark, sf).groupBy("carrier_id", "year", "month").agg(F.sum("commission").alias("v"))
    w = Window.partitionBy("carrier_id").orderBy("year", "month")
    recent, before = F.sum("v").over(w.rowsBetween(-2, 0)), F.sum("v").over(w.rowsBetween(-5, -3))
    return m.select("carrier_id", "year", "month", F.when(before.isNull(), "stable").when(recent > before * F.lit("1.05").cast("decimal(3,2)"), "up").when(recent < before * F.lit("0.95").cast("decimal(3,2)"), "down").otherwise("stable").alias("trend"))


@query(f"""WITH {ENTRIES_SQL}, m AS (SELECT carrier_id, year, month, sum(commission) AS v, row_number() OVER (PARTITION BY carrier_id ORDER BY year DESC, month DESC) AS r FROM entries GROUP BY 1, 2, 3 HAVING sum(commission) > 0),
  c AS (SELECT carrier_id, count(*) AS n, CAST(sum(CASE WHEN r <= 3 THEN v END) AS DOUBLE) / 3 AS f, round(stddev_pop(CAST(v AS DOUBLE)) / avg(CAST(v AS DOUBLE)) * 100, 6) AS cv FROM m GROUP BY 1)
  SELECT carrier_id, CASE WHEN n < 3 THEN 0.0 ELSE f END AS forecast, CASE WHEN n < 3 THEN 'low' WHEN cv < 20 THEN 'high' WHEN cv < 40 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def forecast_next_month(spark, sf):
    """Mean of the last three positive months, zero with fewer, and how far the variation of all of them bears it."""
    m = entries(spark, sf).groupBy("carrier_id", "year", "month").agg(F.sum("commission").alias("v")).where("v > 0")
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("carrier_id").orderBy(F.desc("year"), F.desc("month"))))
    c = m.groupBy("carrier_id").agg(F.count("*").alias("n"), (dbl(F.sum(F.when(F.col("r") <= 3, F.col("v")))) / 3).alias("f"), F.round(F.stddev_pop(dbl("v")) / F.avg(dbl("v")) * 100, 6).alias("cv"))
    few = F.col("n") < 3
    return c.select("carrier_id", F.when(few, 0.0).otherwise(F.col("f")).alias("forecast"), F.when(few, "low").when(F.col("cv") < 20, "high").when(F.col("cv") < 40, "medium").otherwise("low").alias("confidence"))


@query(f"""WITH {ENTRIES_SQL}, a AS (SELECT carrier_id, CAST(sum(commission) AS DOUBLE) AS v FROM entries WHERE year = 1995 GROUP BY 1), b AS (SELECT carrier_id, CAST(sum(commission) AS DOUBLE) AS v FROM entries WHERE year = 1996 AND month <= 6 GROUP BY 1)
  SELECT coalesce(a.carrier_id, b.carrier_id) AS carrier_id, coalesce(a.v, 0) AS previous, coalesce(b.v, 0) AS current, CASE WHEN coalesce(a.v, 0) = 0 THEN CASE WHEN coalesce(b.v, 0) > 0 THEN 100.0 ELSE 0.0 END ELSE (coalesce(b.v, 0) - a.v) / a.v * 100 END AS growth
  FROM a FULL JOIN b ON a.carrier_id = b.carrier_id""")
def year_over_year(spark, sf):
    e = entries(spark, sf)
    one = lambda rows, name: rows.groupBy("carrier_id").agg(dbl(F.sum("commission")).alias(name))
    both = one(e.where("year = 1995"), "p").join(one(e.where("year = 1996 and month <= 6"), "c"), "carrier_id", "full_outer")
    p, c = F.coalesce("p", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    return both.select("carrier_id", p.alias("previous"), c.alias("current"), S.growth(c, p).alias("growth"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events")
def forward_fill(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, sf, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("last_signup"))


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), '|') AS around FROM conversations")
def context_window(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 2)
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), "|").alias("around"))


@query("SELECT event_id, event_type IS DISTINCT FROM lag(event_type) OVER w AS differs_before, event_type IS DISTINCT FROM lead(event_type) OVER w AS differs_after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbour_difference(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.col("event_type")
    return read(spark, sf, "events").select("event_id", (~t.eqNullSafe(F.lag(t).over(w))).alias("differs_before"), (~t.eqNullSafe(F.lead(t).over(w))).alias("differs_after"))


@query("SELECT event_id, event_type, CASE WHEN n = 1 THEN event_type ELSE event_type || '_' || n END AS header FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)")
def unique_headers(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    e = read(spark, sf, "events").select("event_id", "event_type", n.alias("n"))
    return e.select("event_id", "event_type", F.when(F.col("n") == 1, F.col("event_type")).otherwise(F.concat("event_type", F.lit("_"), F.col("n").cast("string"))).alias("header"))


@query("SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer ORDER BY segment ASC NULLS LAST, id LIMIT 50 OFFSET 25")
def page_slice(spark, sf):
    """One page of a list sorted with missing values last."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("nullif(c_mktsegment, 'BUILDING')").alias("segment"))
    return c.orderBy(F.asc_nulls_last("segment"), "id").offset(25).limit(50)


@query("SELECT o_orderkey AS id, o_orderpriority AS p FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, id LIMIT 6")
def priority_top(spark, sf):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return read(spark, sf, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(6).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal > 5000), b AS (SELECT DISTINCT s_nationkey AS n FROM supplier)
  SELECT (SELECT count(*) FROM (SELECT n FROM a INTERSECT SELECT n FROM b)) AS common, (SELECT count(*) FROM (SELECT n FROM a UNION SELECT n FROM b)) AS together, (SELECT count(*) FROM (SELECT n FROM b EXCEPT SELECT n FROM a)) AS only_b""")
def set_operations(spark, sf):
    a = read(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n")).withColumn("a", F.lit(1))
    b = read(spark, sf, "supplier").select(F.col("s_nationkey").alias("n")).withColumn("b", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy("n").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("common"), F.count("*").alias("together"), F.count_if(F.col("a").isNull() & (F.col("b") == 1)).alias("only_b"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') AND lang IN ('en', 'de') AND n_chars BETWEEN 100 AND 5000")
def generic_filter(spark, sf):
    return where_all(read(spark, sf, "documents"), {"text": "license", "lang": ["en", "de"], "source": ""}).where(F.col("n_chars").between(100, 5000)).select("doc_id", "lang")


def where_all(rows: DataFrame, wanted: dict) -> DataFrame:
    """Lists mean membership, strings a case-insensitive part, other values equality; empty ones are ignored; paths may be dotted."""
    for path, value in wanted.items():
        if value in (None, "", []):
            continue
        c = F.col(path)
        rows = rows.where(c.isin(value) if isinstance(value, list) else F.lower(c.cast("string")).contains(value.lower()) if isinstance(value, str) else c == value)
    return rows


@query("SELECT o_orderkey AS upload_id FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' - INTERVAL 30 DAY AND o_orderdate < TIMESTAMP '1998-07-01'")
def last_thirty_days(spark, sf):
    return read(spark, sf, "orders").where("o_orderdate >= timestamp_ntz '1998-07-01' - interval 30 days and o_orderdate < timestamp_ntz '1998-07-01'").select(F.col("o_orderkey").alias("upload_id"))


@query(f"""WITH {ENTRIES_SQL}, b AS (SELECT carrier_id, client_name, list(DISTINCT upload_id) AS ids, sum(commission) AS c FROM entries GROUP BY 1, 2) SELECT carrier_id, client_name, CAST(c AS DOUBLE) AS c FROM b WHERE list_contains(ids, 7)""")
def array_membership(spark, sf):
    """Ledger rows that hold an upload, by its id in the array."""
    e = entries(spark, sf)
    keys = e.where("upload_id = 7").select("carrier_id", "client_name").distinct()
    b = e.join(keys, ["carrier_id", "client_name"], "left_semi").groupBy("carrier_id", "client_name").agg(F.collect_set("upload_id").alias("ids"), F.sum("commission").alias("c"))
    return b.where(F.array_contains("ids", F.lit(7).cast("long"))).select("carrier_id", "client_name", dbl("c").alias("c"))


@query("SELECT s_suppkey AS src, n_nationkey AS dst, 'carrier-nation' AS relationship FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_custkey, c_nationkey, 'client-nation' FROM customer UNION ALL SELECT n_nationkey, n_regionkey, 'nation-region' FROM nation")
def relationship_edges(spark, sf):
    edge = lambda t, a, b, name: read(spark, sf, t).select(F.col(a).cast("long").alias("src"), F.col(b).cast("int").alias("dst"), F.lit(name).alias("relationship"))
    return edge("supplier", "s_suppkey", "s_nationkey", "carrier-nation").unionByName(edge("customer", "c_custkey", "c_nationkey", "client-nation")).unionByName(edge("nation", "n_nationkey", "n_regionkey", "nation-region"))


@query("SELECT count(*) AS n, count(text) AS filled, 100.0::DOUBLE * count(text) / count(*) AS completeness, count(*) - count(DISTINCT text) AS duplicates, min(length(text)) AS shortest, max(length(text)) AS longest FROM documents")
def quality_metrics(spark, sf):
    one = read(spark, sf, "documents").agg(F.count("*").alias("n"), F.count("text").alias("filled"), F.countDistinct("text").alias("d"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))
    return one.select("n", "filled", (F.lit(100.0) * F.col("filled") / F.col("n")).alias("completeness"), (F.col("n") - F.col("d")).alias("duplicates"), "shortest", "longest")
