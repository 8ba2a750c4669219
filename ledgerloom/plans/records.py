"""Records of the domain: projections, joins over them, ledger changes, run metrics, limits in time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledger
from ..sources.binding import ENTRIES_SQL, MONTHS, UPLOADS_SQL, entries, read, uploads
from .catalogue import query

dbl = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


@query(f"""WITH {ENTRIES_SQL} SELECT client_name, concat_ws('/', {", ".join(f"CAST(CAST(coalesce(sum(CASE WHEN month = {m} THEN commission END), 0) AS DECIMAL(30,4)) AS VARCHAR)" for m in range(1, 13))}) AS breakdown FROM entries GROUP BY 1""")
def month_breakdown(spark, sf):
    """The twelve month columns as one nested value, read back by path."""
    wide = entries(spark, sf).groupBy("client_name").agg(*ledger.month_columns("commission"))
    nested = wide.select("client_name", F.struct(*[F.col(f"{m}_commission").alias(m) for m in MONTHS]).alias("b"))
    return nested.select("client_name", F.concat_ws("/", *[F.col(f"b.{m}").cast("decimal(30,4)").cast("string") for m in MONTHS]).alias("breakdown"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey % 100 END AS carrier_key, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || '@x' ELSE trim(o_orderstatus || ' ' || o_orderpriority) END AS shown, o_custkey || '_' || o_orderkey % 100 AS both, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS at FROM orders")
def record_fields(spark, sf):
    """Effective key, display name, composite id and ISO time of a record, each with its fallback."""
    k, gone = F.col("o_orderkey"), F.lit(None)
    own = F.when(k % 3 == 0, gone).otherwise(k % 100)
    first, last = F.when(k % 4 == 0, gone).otherwise(F.col("o_orderstatus")), F.when(k % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    name = F.trim(F.concat_ws(" ", first, last))
    return read(spark, sf, "orders").select(
        k.alias("id"), F.coalesce(own, F.col("o_custkey")).alias("carrier_key"), F.coalesce(F.nullif(name, F.lit("")), F.concat("o_orderpriority", F.lit("@x"))).alias("shown"),
        F.concat_ws("_", F.col("o_custkey").cast("string"), (k % 100).cast("string")).alias("both"), F.date_format(F.when(k % 5 != 0, F.col("o_orderdate")), "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
    )


@query("SELECT o_orderkey AS id FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 10 END = 4 OR (CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 10 END IS NULL AND o_orderkey % 10 = 4)")
def legacy_carrier_match(spark, sf):
    """Own carrier, or the company where a record has none, as one equality."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 10).alias("carrier"), (F.col("o_orderkey") % 10).alias("company"))
    return o.where(F.coalesce("carrier", "company") == 4).select("id")


@query(f"""WITH {UPLOADS_SQL} SELECT s_suppkey AS carrier_id, count(u.upload_id) AS n FROM supplier LEFT JOIN uploads u ON (CASE WHEN u.upload_id % 2 = 0 THEN u.upload_id % 90 + 1 END = s_suppkey OR (u.upload_id % 2 <> 0 AND u.user_id % 90 + 1 = s_suppkey)) AND status = 'Approved' WHERE u.user_id % 3 = 0 OR u.upload_id IS NULL GROUP BY 1""")
def carriers_of_user(spark, sf):
    """Carriers with one user's approved uploads; carriers with only others' uploads disappear, those without any stay."""
    u = uploads(spark, sf).where("status = 'Approved'")
    u = u.select("upload_id", "user_id", F.coalesce(F.when(F.col("upload_id") % 2 == 0, F.col("upload_id") % 90 + 1), F.col("user_id") % 90 + 1).alias("carrier_id"))
    seen = u.groupBy("carrier_id").agg(F.count("*").alias("all"), F.count_if(F.col("user_id") % 3 == 0).alias("n"))
    c = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("carrier_id")).join(seen, "carrier_id", "left")
    return c.where("all is null or n > 0").select("carrier_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {UPLOADS_SQL}, d AS (SELECT upload_id AS original, upload_id + 1 AS again FROM uploads WHERE upload_id % 5 = 0) SELECT d.original, d.again, c_name AS uploader, u.status FROM d JOIN uploads u ON u.upload_id = d.original JOIN customer ON c_custkey = u.user_id""")
def duplicate_uploads(spark, sf):
    """Pairs of duplicates with the original's uploader."""
    u = uploads(spark, sf)
    d = u.where("upload_id % 5 = 0").select(F.col("upload_id").alias("original"), (F.col("upload_id") + 1).alias("again"))
    who = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("uploader"))
    return d.join(u.withColumnRenamed("upload_id", "original"), "original").join(who, "user_id").select("original", "again", "uploader", "status")


@query(f"""WITH {UPLOADS_SQL} SELECT e.event_id, u.upload_id, u.status FROM events e JOIN uploads u ON e.event_id = u.upload_id ORDER BY e.ts DESC, e.event_id LIMIT 20""")
def newest_contributions(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts")
    return e.join(uploads(spark, sf), F.col("event_id") == F.col("upload_id")).orderBy(F.desc("ts"), "event_id").select("event_id", "upload_id", "status").limit(20)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0 AND o_custkey % 2 = 0 AND o_orderpriority IS NOT NULL ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def rows_without_hash(spark, sf):
    """The next batch of uploads that have a name but no hash yet, newest first."""
    o = read(spark, sf, "orders").withColumn("hash", F.when(F.col("o_orderkey") % 7 != 0, F.md5(F.col("o_orderkey").cast("string").cast("binary"))))
    return o.where("hash is null and o_custkey % 2 = 0 and o_orderpriority is not null").orderBy(F.desc("o_orderdate"), "o_orderkey").select(F.col("o_orderkey").alias("id")).limit(10)


@query("SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def pending_uploads(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.row_number().over(w).cast("long").alias("place"))


@query("SELECT s_suppkey AS id, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AS in_use FROM supplier")
def in_use(spark, sf):
    """Whether any row refers to a record, before it is deleted."""
    held = read(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("id")).distinct().withColumn("in_use", F.lit(True))
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).join(held, "id", "left").select("id", F.coalesce("in_use", F.lit(False)).alias("in_use"))


@query(f"""WITH {ENTRIES_SQL}, g AS (SELECT client_name, carrier_id, list(DISTINCT upload_id) AS ids FROM entries GROUP BY 1, 2) SELECT client_name, count(DISTINCT x) AS uploads FROM (SELECT client_name, unnest(ids) AS x FROM g) GROUP BY 1""")
def distinct_uploads(spark, sf):
    """Distinct elements of an array column per client."""
    g = entries(spark, sf).groupBy("client_name", "carrier_id").agg(F.collect_set("upload_id").alias("ids"))
    return g.select("client_name", F.explode("ids").alias("x")).groupBy("client_name").agg(F.countDistinct("x").alias("uploads"))


@query(f"""WITH {ENTRIES_SQL} SELECT environment_id, count(DISTINCT upload_id) AS uploads, count(*) AS records, CAST(sum(commission) AS DOUBLE) AS commission, CAST(sum(invoice) AS DOUBLE) AS invoice FROM entries GROUP BY 1""")
def environment_stats(spark, sf):
    return entries(spark, sf).groupBy("environment_id").agg(F.countDistinct("upload_id").alias("uploads"), F.count("*").alias("records"), dbl(F.sum("commission")).alias("commission"), dbl(F.sum("invoice")).alias("invoice"))


@query(f"""WITH {ENTRIES_SQL} SELECT environment_id, count(*) AS kept FROM entries WHERE environment_id <> 'A' GROUP BY 1""")
def environment_reset(spark, sf):
    """An environment emptied."""
    return entries(spark, sf).where("environment_id <> 'A'").groupBy("environment_id").agg(F.count("*").alias("kept"))


@query(f"""WITH {ENTRIES_SQL}, m AS (SELECT * FROM entries WHERE user_id = 1) SELECT s_suppkey AS carrier_id, count(client_name) AS n, CASE WHEN count(client_name) = 0 THEN 0.0 ELSE CAST(sum(commission) AS DOUBLE) END AS commission, count(DISTINCT nullif(client_name, '')) AS clients FROM supplier LEFT JOIN m ON carrier_id = s_suppkey GROUP BY 1""")
def carrier_stats_of_user(spark, sf):
    """One user's totals per carrier, zero where there are none."""
    m = entries(spark, sf).where("user_id = 1").groupBy("carrier_id").agg(F.count("*").alias("n"), dbl(F.sum("commission")).alias("commission"), F.countDistinct(F.nullif("client_name", F.lit(""))).alias("clients"))
    c = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("carrier_id")).join(m, "carrier_id", "left")
    return c.select("carrier_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("commission", F.lit(0.0)).alias("commission"), F.coalesce("clients", F.lit(0)).alias("clients"))


@query("""WITH r AS (SELECT user_id, event_type <> 'error' AS ok, value, CASE WHEN event_type = 'error' THEN 'kind' || event_id % 3 || ': text' END AS err FROM events)
  SELECT user_id, count(*) AS runs, count(*) FILTER (ok) AS good, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 6) AS success_rate, round(avg(CASE WHEN ok THEN value END), 6) AS mean_value, count(DISTINCT split_part(err, ':', 1)) AS error_kinds FROM r GROUP BY 1""")
def run_metrics(spark, sf):
    """Success rate, means over successes and kinds of errors by the text before the colon."""
    ok = F.col("event_type") != "error"
    err = F.when(~ok, F.concat(F.lit("kind"), (F.col("event_id") % 3).cast("string"), F.lit(": text")))
    e = read(spark, sf, "events").select("user_id", "value", ok.alias("ok"), F.split(err, ":")[0].alias("kind"))
    return e.groupBy("user_id").agg(F.count("*").alias("runs"), F.count_if("ok").alias("good"), F.round(F.lit(100.0) * F.count_if("ok") / F.count("*"), 6).alias("success_rate"), F.round(F.avg(F.when(F.col("ok"), F.col("value"))), 6).alias("mean_value"), F.countDistinct("kind").alias("error_kinds"))


@query(f"""WITH {ENTRIES_SQL}, y AS (SELECT carrier_id, CAST(sum(CASE WHEN year = 1996 THEN commission END) AS DOUBLE) AS p, CAST(sum(CASE WHEN year = 1997 THEN commission END) AS DOUBLE) AS c FROM entries GROUP BY 1),
  g AS (SELECT carrier_id, CASE WHEN coalesce(p, 0) = 0 THEN 0 ELSE (coalesce(c, 0) - p) / p * 100 END AS growth FROM y) SELECT carrier_id, CASE WHEN growth > 20 THEN 'strong_growth' ELSE 'decline' END AS insight FROM g WHERE growth > 20 OR growth < -10""")
def growth_insights(spark, sf):
    """Insights from thresholds: growth over twenty per cent, decline under minus ten."""
    year = lambda y: F.coalesce(dbl(F.sum(F.when(F.col("year") == y, F.col("commission")))), F.lit(0.0))
    y = entries(spark, sf).groupBy("carrier_id").agg(year(1996).alias("p"), year(1997).alias("c"))
    g = F.when(F.col("p") == 0, 0.0).otherwise((F.col("c") - F.col("p")) / F.col("p") * 100)
    return y.select("carrier_id", F.explode(F.filter(F.array(F.when(g > 20, "strong_growth"), F.when(g < -10, "decline")), lambda x: x.isNotNull())).alias("insight"))


@query("""WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS chunk, l_quantity AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS name FROM lineitem) SELECT doc, count(*) AS pieces, sum(n) AS total, arg_min(CASE WHEN name <> '' THEN name END, (chunk, name)) FILTER (name <> '') AS name FROM c GROUP BY 1""")
def folded_chunks(spark, sf):
    """Chunk results folded: lists appended, numbers added, the first scalar that is not empty kept."""
    c = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk"), "l_quantity", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("name"))
    return c.groupBy("doc").agg(F.size(F.flatten(F.collect_list(F.array("l_quantity")))).cast("long").alias("pieces"), F.sum("l_quantity").alias("total"), F.min_by(F.when(F.col("name") != "", F.col("name")), F.when(F.col("name") != "", F.struct("chunk", "name"))).alias("name"))


@query("""WITH c AS (SELECT s_suppkey, s_nationkey, s_acctbal, trim(lower(regexp_replace(s_name, '#0*', ' '))) AS core FROM supplier), g AS (SELECT core, s_nationkey, sum(CAST(s_acctbal AS DECIMAL(15,2))) AS v FROM c GROUP BY 1, 2)
  SELECT core, CAST(sum(v) AS DOUBLE) AS total, count(*) AS parts, string_agg(s_nationkey || ':' || v, ',' ORDER BY s_nationkey) AS nested FROM g GROUP BY 1""")
def company_rollup(spark, sf):
    """Companies by the name they are matched by, with sums per carrier nested."""
    c = read(spark, sf, "supplier").select("s_nationkey", F.col("s_acctbal").cast("decimal(15,2)").alias("v"), S.match_name(F.concat(F.regexp_replace("s_name", "#0*", " "), F.when(F.col("s_suppkey") % 2 == 0, " LLC").otherwise(", Inc."))).alias("core"))
    g = c.groupBy("core", "s_nationkey").agg(F.sum("v").alias("v"))
    parts = F.sort_array(F.collect_list(F.struct("s_nationkey", "v")))
    text = F.array_join(F.transform(F.col("p"), lambda x: F.concat(x["s_nationkey"].cast("string"), F.lit(":"), x["v"].cast("decimal(15,2)").cast("string"))), ",")
    return g.groupBy("core").agg(dbl(F.sum("v")).alias("total"), F.count("*").alias("parts"), parts.alias("p")).select("core", "total", "parts", text.alias("nested"))


@query("SELECT l_orderkey AS upload_id, list_sort(list(l_quantity))[count(*) // 2 + 1] AS middle FROM lineitem GROUP BY 1")
def upper_medians(spark, sf):
    """The upper of the two middle values where their number is even."""
    g = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("upload_id")).agg(F.sort_array(F.collect_list("l_quantity")).alias("v"))
    return g.select("upload_id", F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("middle"))


@query(f"""WITH {ENTRIES_SQL}, m AS (SELECT carrier_id, year, month, CAST(sum(commission) AS DOUBLE) AS v FROM entries GROUP BY 1, 2, 3), l AS (SELECT carrier_id, list(v ORDER BY year, month) AS v FROM m GROUP BY 1), c AS (SELECT carrier_id, len(v) AS n, ((list_sum(v[-3:]) / 3) - (list_sum(v[1:3]) / 3)) / (list_sum(v[1:3]) / 3) * 100 AS change FROM l)
  SELECT carrier_id, CASE WHEN n < 2 THEN 'stable' WHEN round(change, 6) > 5 THEN 'up' WHEN round(change, 6) < -5 THEN 'down' ELSE 'stable' END AS trend FROM c""")
def first_last_trend(spark, sf):
    """The last three months against the first three, each divided by three whatever their number."""
    m = entries(spark, sf).groupBy("carrier_id", "year", "month").agg(dbl(F.sum("commission")).alias("v"))
    v = F.transform(F.sort_array(F.collect_list(F.struct("year", "month", "v"))), lambda x: x["v"])
    third = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / 3
    l = m.groupBy("carrier_id").agg(v.alias("v"))  # noqa: E741
    new, old = third(F.slice("v", F.greatest(F.lit(1), F.size("v") - 2), F.lit(3))), third(F.slice("v", 1, 3))
    change = F.round((new - old) / old * 100, 6)
    return l.select("carrier_id", F.when(F.size("v") < 2, "stable").when(change > 5, "up").when(change < -5, "down").otherwise("stable").alias("trend"))


@query("""WITH b AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY CASE source WHEN 'web' THEN 0 ELSE 1 END, n_chars DESC, doc_id) AS r FROM documents) SELECT lang, doc_id FROM b WHERE r = 1""")
def best_candidates(spark, sf):
    """The best candidate of a group, by kind, then weight."""
    w = Window.partitionBy("lang").orderBy(F.when(F.col("source") == "web", 0).otherwise(1), F.desc("n_chars"), "doc_id")
    return read(spark, sf, "documents").withColumn("r", F.row_number().over(w)).where("r = 1").select("lang", "doc_id")


@query("""WITH p AS (SELECT l_orderkey AS doc, row_number() OVER w AS page, l_returnflag AS header, CASE WHEN lag(l_returnflag) OVER w IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END AS fresh FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY page) AS grp FROM p) SELECT doc, grp::BIGINT AS table_no, min(page) AS first_page, count(*) AS pages FROM g GROUP BY 1, 2""")
def page_groups(spark, sf):
    """Consecutive page tables with one header become one table."""
    w = Window.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    p = read(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc").select("doc", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("header"))
    p = p.withColumn("page", F.row_number().over(w)).withColumn("fresh", (~F.lag("header").over(w).eqNullSafe(F.col("header"))).cast("int"))
    p = p.withColumn("table_no", F.sum("fresh").over(Window.partitionBy("doc").orderBy("page")))
    return p.groupBy("doc", "table_no").agg(F.min("page").cast("long").alias("first_page"), F.count("*").alias("pages"))


@query(f"""WITH {ENTRIES_SQL} SELECT year, CAST(sum(CASE WHEN month BETWEEN 6 AND 8 THEN commission ELSE 0 END) AS DOUBLE) AS last_three, CAST(sum(CASE WHEN month BETWEEN 3 AND 8 THEN commission ELSE 0 END) AS DOUBLE) AS last_six FROM entries GROUP BY 1""")
def recent_months(spark, sf):
    """The last three and six months up to a given month, without wrapping into the year before."""
    upto, m = 8, F.col("month")
    span = lambda k: dbl(F.sum(F.when(m.between(max(1, upto - k + 1), upto), F.col("commission")).otherwise(0)))
    return entries(spark, sf).groupBy("year").agg(span(3).alias("last_three"), span(6).alias("last_six"))


@query("SELECT n_name AS name, row_number() OVER (ORDER BY lower(n_name), n_name) AS place FROM nation")
def names_in_order(spark, sf):
    """Names without regard to case, then with it; positions come from a sort of the small table."""
    n = read(spark, sf, "nation").select("n_name").orderBy(F.lower("n_name"), "n_name").agg(F.sort_array(F.collect_list(F.struct(F.lower("n_name").alias("l"), F.col("n_name").alias("n")))).alias("x"))
    return n.select(F.posexplode("x").alias("p", "x")).select(F.col("x.n").alias("name"), (F.col("p") + 1).cast("long").alias("place"))


@query("SELECT l_orderkey AS doc, l_returnflag AS a, l_linestatus AS b, min(l_linenumber) AS first_row FROM lineitem GROUP BY 1, 2, 3")
def overlapping_rows(spark, sf):
    """Rows that overlapping chunks repeat, once each, where they came first."""
    return read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.min("l_linenumber").alias("first_row"))


@query("WITH g AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source || doc_id % 7 END AS name FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM g) SELECT doc_id, name FROM r WHERE r = 1 OR name = ''")
def first_of_name(spark, sf):
    """Groups once per exact name, the first kept; nameless ones all stay."""
    g = read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat("source", (F.col("doc_id") % 7).cast("string"))).alias("name"))
    named = g.where("name <> ''").groupBy("name").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "name")
    return named.unionByName(g.where("name = ''"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 3")
def bound_sql(spark, sf):
    """SQL text with bound values over a registered view, which is probed first."""
    read(spark, sf, "nation").createOrReplaceTempView("nation_probe")
    if not spark.catalog.tableExists("nation_probe"):
        raise LookupError("nation_probe")
    found = spark.sql("select n_nationkey as id, n_name as name from nation_probe where n_regionkey = :region and n_nationkey > :least", args={"region": 2, "least": 3})
    spark.catalog.dropTempView("nation_probe")
    return found


@query("""SELECT r_regionkey AS id, '{"name":"' || r_name || '","header":["name","key"],"rows":[["' || r_name || '","' || r_regionkey || '"]]}' AS json FROM region""")
def json_export(spark, sf):
    r = read(spark, sf, "region")
    table = F.struct(F.col("r_name").alias("name"), F.array(F.lit("name"), F.lit("key")).alias("header"), F.array(F.array("r_name", F.col("r_regionkey").cast("string"))).alias("rows"))
    return r.select(F.col("r_regionkey").alias("id"), F.to_json(table).alias("json"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS tags, CASE WHEN o_orderkey % 3 = 0 THEN 'client:Company,paid:Amount' ELSE 'client:Name,paid:Amount' END AS fields, CASE WHEN o_orderkey % 3 = 0 THEN 'Company' ELSE 'Name' END AS client FROM orders")
def config_merges(spark, sf):
    """Append if absent; field lists merged with the target's own kept; the list as a map and back."""
    k = F.col("o_orderkey")
    tags = F.array_union(F.array(F.lit("a"), F.lit("b")), F.when(k % 2 == 0, F.array(F.lit("c"))).otherwise(F.array(F.lit("a"))))
    pair = lambda f, m: F.struct(F.lit(f).alias("field"), F.lit(m).alias("mapping"))
    own = F.when(k % 3 == 0, F.array(pair("client", "Company"))).otherwise(F.array(pair("client", "Name")))
    other = F.array(pair("client", "Other"), pair("paid", "Amount"))
    both = F.concat(own, F.filter(other, lambda x: ~F.exists(own, lambda y: y["field"] == x["field"])))
    as_map = F.map_from_entries(both)
    text = F.array_join(F.transform(F.array_sort(F.map_entries(as_map)), lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    return read(spark, sf, "orders").select(k.alias("id"), F.array_join(tags, ",").alias("tags"), text.alias("fields"), as_map["client"].alias("client"))


@query("SELECT user_id, CAST(CASE WHEN bool_or(event_type = 'view') THEN max(CASE WHEN event_type = 'view' THEN event_id END) END AS BIGINT) AS last_view, count(DISTINCT event_type) AS steps FROM events GROUP BY 1")
def progress_maps(spark, sf):
    """Step progress merged into one map per upload, the last entry of a step winning."""
    e = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    m = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "last"))).alias("m"))
    return m.select("user_id", F.try_element_at("m", F.lit("view")).alias("last_view"), F.size("m").cast("long").alias("steps"))


# --- ledger changes -------------------------------------------------------------------------------
ROWWISE_SQL = """r AS (SELECT carrier_id, client_name, month, year, user_id, environment_id, upload_id, invoice * (upload_id % 2) AS invoice, commission FROM entries)"""


@query(f"""WITH {ENTRIES_SQL}, {ROWWISE_SQL} SELECT carrier_id, client_name, month, year, environment_id, CAST(sum(invoice) AS DOUBLE) AS invoice_total, CAST(sum(commission) AS DOUBLE) AS commission_earned, count(*) AS statement_count, count(DISTINCT upload_id) AS uploads FROM r GROUP BY carrier_id, client_name, month, year, user_id, environment_id""")
def rowwise_upserts(spark, sf):
    """The row-by-row path: amounts always add, the count grows with every row, an invoice of zero changes nothing."""
    r = entries(spark, sf).withColumn("invoice", F.col("invoice") * (F.col("upload_id") % 2).cast("int"))
    out = ledger.add_rows(r)
    return out.select("carrier_id", "client_name", "month", "year", "environment_id", dbl("invoice_total").alias("invoice_total"), dbl("commission_earned").alias("commission_earned"), "statement_count", F.size("upload_ids").cast("long").alias("uploads"))


@query(f"""WITH {ENTRIES_SQL}, n AS (SELECT carrier_id, client_name, statement_date, arg_max(commission, (upload_id, invoice, commission)) AS c FROM entries WHERE commission > 0 AND lower(client_name) NOT IN ('total', 'summary', 'subtotal', '') GROUP BY 1, 2, 3) SELECT carrier_id, client_name, CAST(statement_date AS DATE) AS day, CAST(c AS DOUBLE) AS commission FROM n""")
def legacy_overwrites(spark, sf):
    """The legacy path: rows named like totals or without commission are skipped, and the last row of a statement date overwrites."""
    e = entries(spark, sf).where((F.col("commission") > 0) & ~F.lower("client_name").isin("total", "summary", "subtotal", ""))
    return e.groupBy("carrier_id", "client_name", "statement_date").agg(F.max_by("commission", F.struct("upload_id", "invoice", "commission")).alias("c")).select("carrier_id", "client_name", F.to_date("statement_date").alias("day"), dbl("c").alias("commission"))


@query(f"""WITH {ENTRIES_SQL} SELECT carrier_id, client_name, month, year, environment_id, CAST(sum(commission) AS DOUBLE) AS commission_earned, count(DISTINCT upload_id) AS statement_count FROM entries WHERE upload_id % 11 <> 0 GROUP BY carrier_id, client_name, month, year, user_id, environment_id""")
def ledger_recomputed(spark, sf):
    """The ledger built again from the uploads that remain."""
    kept = uploads(spark, sf).where("upload_id % 11 <> 0").select("upload_id")
    out = ledger.build(entries(spark, sf).join(kept, "upload_id", "left_semi"))
    return out.select("carrier_id", "client_name", "month", "year", "environment_id", dbl("commission_earned").alias("commission_earned"), F.col("statement_count").cast("long").alias("statement_count"))


@query(f"""WITH {ENTRIES_SQL} SELECT upload_id, client_name, CAST(sum(commission) AS DOUBLE) AS commission, CAST(sum(invoice) AS DOUBLE) AS invoice FROM entries WHERE lower(client_name) = 'customer#000000001' GROUP BY 1, 2""")
def client_contributions(spark, sf):
    """What each upload brought to one client."""
    e = entries(spark, sf).where(F.lower("client_name") == F.lower(F.lit("Customer#000000001")))
    return e.groupBy("upload_id", "client_name").agg(dbl(F.sum("commission")).alias("commission"), dbl(F.sum("invoice")).alias("invoice"))


@query(f"""WITH {ENTRIES_SQL}, b AS (SELECT carrier_id, CASE WHEN client_name IN ('Customer#000000001', 'Customer#000000002') THEN 'Merged' ELSE client_name END AS client_name, month, year, environment_id, upload_id, commission FROM entries) SELECT client_name, carrier_id, month, year, environment_id, CAST(sum(commission) AS DOUBLE) AS commission, count(DISTINCT upload_id) AS uploads FROM b WHERE client_name = 'Merged' GROUP BY 1, 2, 3, 4, 5""")
def clients_merged(spark, sf):
    """Two clients' records merged under one name: sums, united uploads, sources gone."""
    b = ledger.build(entries(spark, sf).where(F.col("client_name").isin("Customer#000000001", "Customer#000000002")))
    m = b.withColumn("client_name", F.lit("Merged")).groupBy("client_name", "carrier_id", "month", "year", "environment_id")
    return m.agg(dbl(F.sum("commission_earned")).alias("commission"), F.size(F.array_distinct(F.flatten(F.collect_list("upload_ids")))).cast("long").alias("uploads"))


@query("SELECT s_suppkey AS id, 'Supplier#' || lpad((s_suppkey % 3 * 40 + 1)::VARCHAR, 9, '0') AS new_name, EXISTS (SELECT 1 FROM supplier o WHERE lower(o.s_name) = lower('Supplier#' || lpad((s.s_suppkey % 3 * 40 + 1)::VARCHAR, 9, '0')) AND o.s_suppkey <> s.s_suppkey) AS taken FROM supplier s")
def rename_checks(spark, sf):
    """Whether a new name is taken by another record, which then asks for a merge."""
    new = F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") % 3 * 40 + 1).cast("string"), 9, "0"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("held"), new.alias("new_name"))
    held = s.groupBy("held").agg(F.min("id").alias("a"), F.max("id").alias("b")).withColumnRenamed("held", "low")
    out = s.join(held, F.lower("new_name") == F.col("low"), "left")
    return out.select("id", "new_name", F.coalesce((F.col("a") != F.col("id")) | (F.col("b") != F.col("id")), F.lit(False)).alias("taken"))


@query("""WITH f AS (SELECT user_id AS company, 'f' || event_id % 4 AS sig, ts, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS mapping FROM events) SELECT company, sig, count(*) AS usage, arg_max(mapping, (ts, event_id)) FILTER (mapping IS NOT NULL) AS mapping, max(ts) AS last_used FROM f GROUP BY 1, 2""")
def learned_formats(spark, sf):
    """Learned formats upserted: usage grows, the newest values that are not null win."""
    f = read(spark, sf, "events").select(F.col("user_id").alias("company"), F.concat(F.lit("f"), (F.col("event_id") % 4).cast("string")).alias("sig"), "ts", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("mapping"))
    newest = F.max_by("mapping", F.when(F.col("mapping").isNotNull(), F.struct("ts", "event_id")))
    return f.groupBy("company", "sig").agg(F.count("*").alias("usage"), newest.alias("mapping"), F.max("ts").alias("last_used"))


@query(f"""WITH {ENTRIES_SQL}, {UPLOADS_SQL} SELECT 'uploads' AS kind, count(*) AS kept FROM uploads WHERE user_id % 5 <> 0 UNION ALL SELECT 'entries', count(*) FROM entries WHERE user_id % 5 <> 0 UNION ALL SELECT 'users', count(*) FROM customer WHERE c_custkey % 5 <> 0""")
def cascaded_delete(spark, sf):
    """Users deleted with what hangs on them, by anti joins."""
    gone = read(spark, sf, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("user_id"))
    one = lambda kind, df: df.join(gone, "user_id", "left_anti").agg(F.count("*").alias("kept")).select(F.lit(kind).alias("kind"), "kept")
    users = read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return one("uploads", uploads(spark, sf)).unionByName(one("entries", entries(spark, sf))).unionByName(one("users", users))


@query("WITH d AS (SELECT o_orderkey AS id, md5((o_orderkey % 50)::VARCHAR) AS hash, o_orderdate AS day FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY day DESC, id DESC) AS r, first_value(id) OVER (PARTITION BY hash ORDER BY day, id) AS original FROM d) SELECT id, original, CASE WHEN r = 1 THEN 'kept' ELSE 'replaced' END AS action FROM r")
def duplicates_replaced(spark, sf):
    """Files of one hash: the newest replaces the others; each is recorded with the original."""
    d = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.md5((F.col("o_orderkey") % 50).cast("string").cast("binary")).alias("hash"), F.col("o_orderdate").alias("at"))
    g = d.groupBy("hash").agg(F.max(F.struct("at", "id")).alias("new"), F.min(F.struct("at", "id")).alias("old"))
    return d.join(g, "hash").select("id", F.col("old.id").alias("original"), F.when(F.col("new.id") == F.col("id"), "kept").otherwise("replaced").alias("action"))


@query(f"""WITH t AS (SELECT l_orderkey AS upload_id, sum(CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_extendedprice AS DECIMAL(15,2)) ELSE 0 END) AS calc FROM lineitem GROUP BY 1), j AS (SELECT upload_id, CAST(calc AS DOUBLE) AS calc, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS stated FROM t JOIN orders ON o_orderkey = upload_id WHERE o_orderstatus <> 'P')
  SELECT upload_id, calc AS calculated, stated, CASE WHEN calc < 0.01 THEN 'needs_review' WHEN stated = 0 THEN 'Approved' WHEN abs(calc - stated) / abs(stated) * 100 < 5 THEN 'Approved' ELSE 'needs_review' END AS status FROM j""")
def approved_statements(spark, sf):
    """Approval: pending uploads held back, cells parsed, summary rows left out of the total, the total held against the stated one."""
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("upload_id"), "l_linenumber", F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(15,2)"), 2)).alias("cell"))
    value = S.amount_ledger(F.col("cell")).cast("decimal(15,2)")
    t = lines.groupBy("upload_id").agg(F.sum(F.when(F.col("l_linenumber") % 4 != 0, value).otherwise(0)).alias("c"))
    u = read(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("upload_id"), dbl(F.col("o_totalprice").cast("decimal(15,2)")).alias("stated"))
    return t.join(u, "upload_id").select("upload_id", dbl("c").alias("calculated"), "stated", S.reconcile(dbl("c"), F.col("stated")).alias("status"))


# --- limits in time -------------------------------------------------------------------------------
@query("""WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), s AS (SELECT user_id, i, ts AS start, 1 AS n FROM e WHERE i = 1
  UNION ALL SELECT s.user_id, e.i, CASE WHEN e.ts - s.start >= INTERVAL 1 DAY THEN e.ts ELSE s.start END, CASE WHEN e.ts - s.start >= INTERVAL 1 DAY THEN 1 ELSE s.n + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) SELECT user_id, count(*) FILTER (n > 3) AS rejected, max(n)::BIGINT AS most FROM s GROUP BY 1""")
def fixed_window_limit(spark, sf):
    """A counter that lives for a day from its first hit: hits over three are rejected; a fold over a user's times."""
    e = read(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("hits"))
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("rejected"), F.lit(0).cast("long").alias("most"))

    def step(s, x):
        fresh = s["start"].isNull() | (x["ts"] - s["start"] >= F.expr("interval 1 day"))
        n = F.when(fresh, 1).otherwise(s["n"] + 1).cast("long")
        return F.struct(F.when(fresh, x["ts"]).otherwise(s["start"]).alias("start"), n.alias("n"), (s["rejected"] + (n > 3).cast("long")).alias("rejected"), F.greatest(s["most"], n).alias("most"))

    return e.select("user_id", F.aggregate("hits", start, step).alias("s")).select("user_id", "s.rejected", "s.most")


@query("""SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 6) AS tokens, count(*) OVER w > 2 * 0.9::DOUBLE OR round(sum(value) OVER w, 6) > 100 * 0.9::DOUBLE AS waits FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)""")
def request_budget(spark, sf):
    """Requests and tokens of the last hour against nine tenths of both limits."""
    e = read(spark, sf, "events").where("value is not null").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-3_600_000_000, 0)
    n, t = F.count("*").over(w), F.round(F.sum("value").over(w), 6)
    return e.select("event_id", n.alias("requests"), t.alias("tokens"), ((n > 2 * 0.9) | (t > 100 * 0.9)).alias("waits"))


@query("""WITH g AS (SELECT user_id, min(ts) AS a, max(ts) AS b, max(gap) AS gap FROM (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY 1)
  SELECT user_id, coalesce(gap > INTERVAL 2 DAY, false) AS stuck, b - a > INTERVAL 25 DAY AS timed_out FROM g""")
def liveness_limits(spark, sf):
    """Stuck after too long without a beat, timed out after too long in all."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("gap", F.col("ts") - F.lag("ts").over(w))
    g = e.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("gap").alias("gap"))
    return g.select("user_id", F.coalesce(F.col("gap") > F.expr("interval 2 days"), F.lit(False)).alias("stuck"), (F.col("b") - F.col("a") > F.expr("interval 25 days")).alias("timed_out"))


@query("SELECT event_id, ts + INTERVAL 900 SECOND > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-15' AS live, ts < TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR AS expired FROM events")
def expiries(spark, sf):
    """Snapshots still alive for their 900 seconds, and sessions to be cleaned, at a given time."""
    now = F.expr("timestamp_ntz '2024-01-15'")
    return read(spark, sf, "events").select("event_id", ((F.col("ts") + F.expr("interval 900 seconds") > now) & (F.col("ts") <= now)).alias("live"), (F.col("ts") < now - F.expr("interval 1 hour")).alias("expired"))
