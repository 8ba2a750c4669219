"""Tables as wholes: choosing, checking, repairing and editing them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import tables
from ..sources.binding import order_lines, read
from .catalogue import query
from .cells import picked

# Fixed values of the domain.
TABLE_HEADER_WORDS = ["commission", "paid_amount", "client", "company", "premium", "rate"]
RECORD_FIELDS = ["client_name", "commission_earned", "invoice_total", "plan_type", "effective_date"]

SHAPES_SQL = """shapes AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, CAST(l_quantity AS BIGINT) AS n, CASE l_suppkey % 5 WHEN 0 THEN 'Commission_Detail' WHEN 1 THEN 'commission_table' WHEN 2 THEN 'data' WHEN 3 THEN 'Hold summary' ELSE '' END AS kind,
  CASE l_partkey % 3 WHEN 0 THEN ['Client', 'Paid_Amount', 'Notes'] WHEN 1 THEN ['Rate'] ELSE ['x', 'y'] END AS header FROM lineitem)"""


def shapes(spark, sf):
    """Each order as a document of tables: one per line, with a type, a number of rows and a header."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    kind = picked(F.col("l_suppkey"), [F.lit(x) for x in ("Commission_Detail", "commission_table", "data", "Hold summary", "")])
    header = picked(F.col("l_partkey"), [lit("Client", "Paid_Amount", "Notes"), lit("Rate"), lit("x", "y")])
    return order_lines(spark, sf).select(F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).cast("long").alias("i"), F.col("l_quantity").cast("long").alias("n"), kind.alias("kind"), header.alias("header"))


@query(f"""WITH {SHAPES_SQL}, s AS (SELECT doc, i, n, CASE WHEN contains(lower(kind), 'commission') AND contains(lower(kind), 'detail') THEN 100 WHEN contains(lower(kind), 'commission') THEN 90 WHEN contains(lower(kind), 'data') THEN 70 WHEN regexp_matches(lower(kind), 'hold|summary|total') THEN 10 ELSE 50 END + least(n, 50)
  + 5 * len(list_filter(header, lambda h: regexp_matches(lower(h), 'commission|paid_amount|client|company|premium|rate'))) AS score FROM shapes) SELECT doc, arg_max(i, (score, -i)) AS main, max(score) AS score, arg_max(i, (n, -i)) AS largest FROM s GROUP BY 1""")
def main_tables(spark, sf):
    """The table to map: by type, rows up to fifty and telling headers, the first of equals; and the one with most rows."""
    k = F.lower("kind")
    kind = F.when(k.contains("commission") & k.contains("detail"), 100).when(k.contains("commission"), 90).when(k.contains("data"), 70).when(k.rlike("hold|summary|total"), 10).otherwise(50)
    hits = F.size(F.filter("header", lambda h: F.lower(h).rlike("|".join(TABLE_HEADER_WORDS))))
    s = shapes(spark, sf).withColumn("score", (kind + F.least("n", F.lit(50)) + 5 * hits).cast("long"))
    return s.groupBy("doc").agg(F.max_by("i", F.struct("score", -F.col("i"))).alias("main"), F.max("score").alias("score"), F.max_by("i", F.struct("n", -F.col("i"))).alias("largest"))


@query(f"""WITH {SHAPES_SQL} SELECT doc, i FROM shapes WHERE lower(kind) NOT IN ('hold summary', 'totals') AND NOT n % 10 = i AND i <> 1""")
def kept_tables(spark, sf):
    """Tables dropped by type, where all their rows are summaries, or by a learned position."""
    s = shapes(spark, sf).withColumn("summaries", F.col("n") - F.when(F.col("n") % 10 == F.col("i"), 0).otherwise(1))
    whole = F.col("n") == F.col("summaries")
    return s.where(~F.lower("kind").isin("hold summary", "totals") & ~whole & ~F.array_contains(F.array(F.lit(1).cast("long")), F.col("i"))).select("doc", "i")


@query(f"""WITH {SHAPES_SQL}, f AS (SELECT unnest(['client_name', 'commission_earned', 'invoice_total', 'plan_type', 'effective_date']) AS field, unnest([0, 1, 2, 3, 4]) AS k), h AS (SELECT DISTINCT unnest(header) || CASE WHEN i % 2 = 0 THEN ' name' ELSE ' total' END AS h FROM shapes),
  s AS (SELECT h, field, k, 1 - CAST(levenshtein(lower(h), field) AS DOUBLE) / greatest(length(h), length(field)) AS r FROM h, f) SELECT h AS header, CASE WHEN max(r) > 0.4 THEN arg_max(field, (r, -k)) END AS field, CASE WHEN max(r) > 0.4 THEN max(r) < 0.7 END AS review FROM s GROUP BY 1""")
def header_fields(spark, sf):
    """The record field nearest to each header by edits, none under 0.4, to be reviewed under 0.7; the fields are a short fixed list."""
    h = F.concat(F.col("x"), F.when(F.col("i") % 2 == 0, " name").otherwise(" total"))
    names = shapes(spark, sf).select("i", F.explode("header").alias("x")).select(h.alias("header")).distinct()
    score = lambda f: 1 - F.levenshtein(F.lower("header"), F.lit(f)) / F.greatest(F.length("header"), F.lit(len(f)))
    best = F.array_max(F.array(*[F.struct(score(f).alias("r"), F.lit(-k).alias("k"), F.lit(f).alias("f")) for k, f in enumerate(RECORD_FIELDS)]))
    names = names.withColumn("b", best)
    good = F.col("b.r") > 0.4
    return names.select("header", F.when(good, F.col("b.f")).alias("field"), F.when(good, F.col("b.r") < 0.7).alias("review"))


@query("""WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS r, l_partkey AS c, min(l_returnflag) AS v FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT doc, r, c, CASE WHEN c % 5 = 0 THEN 'X' ELSE v END AS v FROM t WHERE c % 7 <> 0),
  m AS (SELECT t.doc, count(*) AS truth, count(p.v) AS found, count(*) FILTER (p.v = t.v) AS same FROM t LEFT JOIN p ON t.doc = p.doc AND t.r = p.r AND t.c = p.c GROUP BY 1) SELECT doc, CASE WHEN found = 0 THEN 0.0 ELSE same::DOUBLE / found END AS precision_, same::DOUBLE / truth AS recall FROM m""")
def cell_accuracy(spark, sf):
    """Predicted against true cells by row and column."""
    t = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("r"), F.col("l_partkey").alias("c")).agg(F.min("l_returnflag").alias("v"))
    p = t.where("c % 7 <> 0").select("doc", "r", "c", F.when(F.col("c") % 5 == 0, "X").otherwise(F.col("v")).alias("w"))
    m = t.join(p, ["doc", "r", "c"], "left").groupBy("doc").agg(F.count("*").alias("truth"), F.count("w").alias("found"), F.count_if(F.col("w") == F.col("v")).alias("same"))
    return m.select("doc", F.when(F.col("found") == 0, 0.0).otherwise(F.col("same") / F.col("found")).alias("precision_"), (F.col("same") / F.col("truth")).alias("recall"))


@query(f"""WITH {SHAPES_SQL} SELECT doc, i, list_filter(['client', 'paid_amount', 'rate'], lambda x: NOT list_contains(list_transform(header, lambda h: trim(lower(h))), x)) AS missing FROM shapes""")
def missing_columns(spark, sf):
    """Required columns that a header lacks."""
    need = F.array(F.lit("client"), F.lit("paid_amount"), F.lit("rate"))
    return shapes(spark, sf).select("doc", "i", F.array_except(need, F.transform("header", lambda h: F.trim(F.lower(h)))).alias("missing"))


@query(f"""WITH {SHAPES_SQL}, r AS (SELECT doc, i, list_transform(list_concat(header, ['', 'Client']), lambda h, k: CASE WHEN trim(h) = '' THEN 'Column_' || k ELSE h END) AS h FROM shapes), u AS (SELECT doc, i, list_transform(h, lambda x, k: CASE WHEN len(list_filter(h[1:k - 1], lambda y: y = x)) > 0 THEN x || '_' || (len(list_filter(h[1:k - 1], lambda y: y = x)) + 1) ELSE x END) AS h FROM r)
  SELECT doc, i, array_to_string(h, '|') AS header, len(h) AS width FROM u""")
def repaired_headers(spark, sf):
    """Blank headers named by position, repeated ones numbered."""
    h = F.transform(F.concat("header", F.array(F.lit(""), F.lit("Client"))), lambda x, k: F.when(F.trim(x) == "", F.concat(F.lit("Column_"), (k + 1).cast("string"))).otherwise(x))
    s = shapes(spark, sf).withColumn("h", h)

    def numbered(x, k):
        before = F.size(F.filter(F.slice("h", F.lit(1), k), lambda y: y == x))
        return F.when(before > 0, F.concat(x, F.lit("_"), (before + 1).cast("string"))).otherwise(x)

    return s.select("doc", "i", F.array_join(F.transform("h", numbered), "|").alias("header"), F.size("h").cast("long").alias("width"))


@query(f"""WITH {SHAPES_SQL}, k AS (SELECT doc, i, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS now, n % 3 = 0 AS summary FROM shapes WHERE n % 4 <> 0) SELECT doc, count(*) AS rows_left, coalesce(string_agg(now, ',' ORDER BY now) FILTER (summary), '') AS summaries FROM k GROUP BY 1""")
def rows_deleted(spark, sf):
    """Rows deleted from a table, and the marks of the summary rows moved to their new places."""
    s = shapes(spark, sf).where("n % 4 <> 0").withColumn("now", F.row_number().over(Window.partitionBy("doc").orderBy("i")) - 1)
    marks = F.sort_array(F.collect_list(F.when(F.col("n") % 3 == 0, F.col("now"))))
    return s.groupBy("doc").agg(F.count("*").alias("rows_left"), F.array_join(F.transform(marks, lambda x: x.cast("string")), ",").alias("summaries"))


def typed_rows(spark, sf):
    x = F.col("p_retailprice").cast("decimal(15,2)").cast("string")
    row = picked(F.col("p_partkey"), [F.array(F.lit("01/02/2024"), F.concat(F.lit("$"), x), F.lit("5%")), F.array(F.lit("01/03/2024"), x, F.lit("6%")), F.array(F.lit(""), F.lit("n/a"), F.lit("7%")), F.array(F.lit("1/2/24"), F.concat(F.lit("$"), x), F.lit("text"))])
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand"), row.alias("row"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS same, p_partkey % 4 = 0 AS fits FROM part")
def row_formats(spark, sf):
    """Rows held against the types of a reference row: date, currency, percentage."""
    kinds = F.array(F.lit("date"), F.lit("currency"), F.lit("percentage"))
    same = F.size(F.filter(F.zip_with("row", kinds, lambda c, k: S.value_type(c) == k), lambda x: x))
    return typed_rows(spark, sf).select("id", same.cast("long").alias("same"), (same == F.size("row")).alias("fits"))


@query("""WITH c AS (SELECT p_brand, unnest([0, 1, 2]) AS col, unnest(CASE p_partkey % 4 WHEN 0 THEN ['date', 'currency', 'percentage'] WHEN 1 THEN ['date', 'number', 'percentage'] WHEN 2 THEN ['empty', 'text', 'percentage'] ELSE ['date', 'currency', 'text'] END) AS kind FROM part),
  v AS (SELECT p_brand, col, kind, count(*) AS n, CASE kind WHEN 'date' THEN 0 WHEN 'currency' THEN 1 WHEN 'percentage' THEN 2 WHEN 'number' THEN 3 ELSE 4 END AS rank FROM c WHERE kind <> 'empty' GROUP BY 1, 2, 3) SELECT p_brand AS brand, col, arg_max(kind, (n, -rank)) AS kind FROM v GROUP BY 1, 2""")
def column_votes(spark, sf):
    """The type of a column by the vote of its values; ties go to the more special type."""
    c = typed_rows(spark, sf).select("p_brand", F.posexplode("row").alias("col", "x")).select("p_brand", "col", S.value_type(F.col("x")).alias("kind")).where("kind <> 'empty'")
    rank = F.array_position(F.array(*[F.lit(k) for k in ("date", "currency", "percentage", "number", "text")]), F.col("kind"))
    v = c.groupBy("p_brand", "col", "kind").agg(F.count("*").alias("n"))
    return v.groupBy(F.col("p_brand").alias("brand"), "col").agg(F.max_by("kind", F.struct(F.col("n"), (-rank).alias("r"))).alias("kind"))


@query("""WITH r AS (SELECT p_partkey AS id, p_brand, [p_brand, p_type, p_size::VARCHAR, p_name] AS c FROM part), m AS (SELECT p_brand, arg_min(c, id) AS mark FROM r GROUP BY 1)
  SELECT id, len(list_filter(range(1, 5), lambda k: c[k] = mark[k]))::DOUBLE / 4 >= 0.7 AS alike FROM r JOIN m USING (p_brand)""")
def similar_rows(spark, sf):
    """Rows with at least seven tenths of the cells of a marked row."""
    r = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.array("p_brand", "p_type", F.col("p_size").cast("string"), "p_name").alias("c"))
    m = r.groupBy("p_brand").agg(F.min_by("c", "id").alias("mark"))
    same = F.size(F.filter(F.zip_with("c", "mark", lambda a, b: a == b), lambda x: x)) / 4
    return r.join(m, "p_brand").select("id", (same >= 0.7).alias("alike"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 2 THEN DATE '2000-01-31' ELSE CAST(o_orderdate AS DATE) END AS day FROM orders")
def dates_or_clock(spark, sf):
    """A statement's date: ISO, else a written date, else the clock given."""
    d = F.col("o_orderdate")
    s = picked(F.col("o_orderkey"), [F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(d, "MMMM d, yyyy"), F.lit("soon")])
    day = F.coalesce(s.try_cast("timestamp_ntz").cast("date"), S.statement_date(s), F.lit("2000-01-31").cast("date"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"))


# Fixed values of the domain: how far each way of finding a total is trusted.
TOTAL_METHODS = {"document_metadata": 88, "grand_total_table": 95, "two_pass_authoritative_total": 90, "summary_row_scan": 85, "table_footer": 80, "table_scan": 75, "business_intelligence": 70, "gpt_summary_regex": 55, "calculated_sum": 40, "calculated": 40}
TAKES_SQL = """CASE WHEN {c} IS NULL THEN false WHEN a IS NULL THEN true WHEN m = 'document_metadata' THEN false WHEN abs({c} - a) / greatest(abs(a), 1) * 100 > 200 THEN false WHEN {p} < p THEN false WHEN {p} = p THEN abs({c} - a) > greatest(5.0, abs(a) * 0.05::DOUBLE) AND {c} > a ELSE abs({c} - a) > greatest(5.0, abs(a) * 0.05::DOUBLE) END"""
STEP_SQL = "SELECT doc, k, v, CASE WHEN {t} THEN {c} ELSE a END AS a, CASE WHEN {t} THEN '{m}' ELSE m END AS m, CASE WHEN {t} THEN {p} ELSE p END AS p FROM {f}"


def step_sql(source: str, method: str, amount: str) -> str:
    p = TOTAL_METHODS[method]
    return STEP_SQL.format(t=TAKES_SQL.format(c=amount, p=p), c=amount, m=method, p=p, f=source)


@query(f"""WITH s0 AS (SELECT o_orderkey AS doc, o_orderkey % 6 AS k, o_totalprice AS v, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * 0.9::DOUBLE END AS a, 'calculated' AS m, 40 AS p FROM orders), s1 AS ({step_sql("s0", "table_scan", "v * (1 + k)")}), s2 AS ({step_sql("s1", "document_metadata", "CASE WHEN k = 2 THEN v END")}),
  s3 AS ({step_sql("s2", "grand_total_table", "v * 1.2::DOUBLE")}), s4 AS ({step_sql("s3", "summary_row_scan", "v * 3")}) SELECT doc, m AS method, round(a, 2) AS total FROM s4""")
def total_candidates(spark, sf):
    """One total of several, as they arrive: better methods replace worse ones if they differ, wild differences never, the document's own total stays."""
    k, v = F.col("o_orderkey") % 6, F.col("o_totalprice")
    one = lambda m, x: F.struct(F.lit(m).alias("m"), F.lit(TOTAL_METHODS[m]).alias("p"), x.alias("a"))
    start = one("calculated", F.when(F.col("o_orderkey") % 7 != 0, v * 0.9))
    candidates = F.array(one("table_scan", v * (1 + k)), one("document_metadata", F.when(k == 2, v)), one("grand_total_table", v * 1.2), one("summary_row_scan", v * 3))

    def step(held, c):
        off, some = F.abs(c["a"] - held["a"]), F.greatest(F.lit(5.0), F.abs(held["a"]) * 0.05)
        better = F.when(c["p"] == held["p"], (off > some) & (c["a"] > held["a"])).otherwise((c["p"] > held["p"]) & (off > some))
        wild = off / F.greatest(F.abs(held["a"]), F.lit(1.0)) * 100 > 200
        takes = F.when(c["a"].isNull(), False).when(held["a"].isNull(), True).when(held["m"] == "document_metadata", False).when(wild, False).otherwise(better)
        return F.when(takes, c).otherwise(held)

    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.aggregate(candidates, start, step).alias("t"))
    return o.select("doc", F.col("t.m").alias("method"), F.round("t.a", 2).alias("total"))


@query("""WITH t AS (SELECT doc_id, text, lower(coalesce(text, '')) AS l FROM documents) SELECT doc_id, CASE WHEN len(s) = 0 THEN 'Standard' ELSE array_to_string(s, ',') END AS structures FROM (SELECT doc_id, list_filter([CASE WHEN contains(l, 'pepm') OR contains(l, 'per employee per month') THEN 'PEPM' END, CASE WHEN contains(l, '%') OR contains(l, 'percent') THEN 'Percentage-based' END,
  CASE WHEN contains(l, 'premium equivalent') THEN 'Premium Equivalent' END, CASE WHEN contains(l, 'flat') OR contains(l, 'lump sum') THEN 'Flat rates' END, CASE WHEN contains(l, 'tier') THEN 'Tiered' END], lambda x: x IS NOT NULL) AS s FROM t)""")
def commission_structures(spark, sf):
    """Commission structures that a text names, or the standard one."""
    t = F.lower(F.coalesce("text", F.lit("")))
    has = lambda name, *words: F.when(F.lit(False) if not words else t.rlike("|".join(words)), name)
    s = F.filter(F.array(has("PEPM", "pepm", "per employee per month"), has("Percentage-based", "%", "percent"), has("Premium Equivalent", "premium equivalent"), has("Flat rates", "flat", "lump sum"), has("Tiered", "tier")), lambda x: x.isNotNull())
    return read(spark, sf, "documents").select("doc_id", F.when(F.size(s) == 0, "Standard").otherwise(F.array_join(s, ",")).alias("structures"))


@query(r"""WITH r AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS marked, [CASE p_partkey % 4 WHEN 0 THEN 'L' || p_partkey WHEN 1 THEN 'Total' WHEN 2 THEN '-' ELSE p_brand END, CASE p_partkey % 5 WHEN 0 THEN 'Total for all' ELSE p_name END, p_type, p_size::VARCHAR, CASE WHEN p_size % 2 = 0 THEN 'x' ELSE 'N/A' END, 'y'] AS c FROM part)
  SELECT id, marked AND NOT (regexp_full_match(c[1], '[A-Za-z0-9][A-Za-z0-9\-]*') AND NOT regexp_matches(lower(c[1]), 'total|summary|grand') AND NOT contains(c[2], 'Total for') AND len(list_filter(c, lambda x: x NOT IN ('', '-', 'N/A', 'n/a'))) >= 6) AS summary FROM r""")
def unmarked_rows(spark, sf):
    """Rows marked as summaries by mistake: with a valid group number and name and six filled cells they are data."""
    k = F.col("p_partkey")
    number = picked(k, [F.concat(F.lit("L"), k.cast("string")), F.lit("Total"), F.lit("-"), F.col("p_brand")])
    name = F.when(k % 5 == 0, "Total for all").otherwise(F.col("p_name"))
    r = read(spark, sf, "part").select(k.alias("id"), (k % 3 == 0).alias("marked"), F.array(number, name, "p_type", F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "x").otherwise("N/A"), F.lit("y")).alias("c"))
    blank = ["", "-", "N/A", "n/a"]
    number, name = F.trim(F.col("c")[0]), F.trim(F.col("c")[1])
    sound = ~number.isin(blank) & ~F.lower(number).rlike("total|summary|grand") & number.rlike(r"^(?i)[A-Z0-9][A-Z0-9\-]*$")
    named = ~name.isin(blank) & ~name.rlike("Total for|Writing Agent|Producer Name|Grand Total|Sub-total")
    data = sound & named & (F.size(F.filter("c", lambda x: ~F.trim(x).isin(blank))) >= 6)
    return r.select("id", (F.col("marked") & ~data).alias("summary"))


@query(f"""WITH {SHAPES_SQL}, t AS (SELECT doc, i, list_transform(header, lambda h: CASE WHEN i % 2 = 0 THEN ' ' || upper(h) ELSE h END) AS h FROM shapes), k AS (SELECT doc, i, array_to_string(list_transform(h, lambda x: lower(trim(x))), '|') AS k FROM t)
  SELECT doc, i, row_number() OVER (PARTITION BY doc, k ORDER BY i) - 1 AS row_no, min(i) OVER (PARTITION BY doc, k) AS first_table FROM k""")
def stitched_tables(spark, sf):
    """Tables of a document with the same header, but for case and blanks, become one."""
    h = F.transform("header", lambda x: F.when(F.col("i") % 2 == 0, F.concat(F.lit(" "), F.upper(x))).otherwise(x))
    t = shapes(spark, sf).select(F.col("doc").alias("upload_id"), F.col("i").alias("table_idx"), F.lit(0).alias("row_idx"), h.alias("header"))
    return tables.stitch(t).select(F.col("upload_id").alias("doc"), F.col("table_idx").alias("i"), F.col("row_no").cast("long").alias("row_no"), "first_table")


@query(f"""WITH {SHAPES_SQL}, f AS (SELECT unnest([1, 2, 3]) AS format_id, unnest([['client', 'paid_amount'], ['rate', 'x'], ['x', 'y', 'z']]) AS f), h AS (SELECT DISTINCT doc, i, list_transform(header, lambda x: lower(x)) AS h FROM shapes),
  s AS (SELECT doc, i, format_id, len(list_intersect(h, f))::DOUBLE / greatest(len(h), len(f)) AS score FROM h, f), b AS (SELECT doc, i, max(score) AS score, arg_max(format_id, (score, -format_id)) AS format_id FROM s WHERE score > 0.5 GROUP BY 1, 2) SELECT doc, i, format_id, score FROM b""")
def nearest_formats(spark, sf):
    """The learned format nearest to each header by common names, over a half at least."""
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    formats = spark.range(1).select(F.explode(F.array(F.struct(F.lit(1).alias("format_id"), lit("client", "paid_amount").alias("header")), F.struct(F.lit(2).alias("format_id"), lit("rate", "x").alias("header")), F.struct(F.lit(3).alias("format_id"), lit("x", "y", "z").alias("header")))).alias("f")).select("f.*")
    rows = shapes(spark, sf).select(F.col("doc").alias("upload_id"), F.col("i").alias("table_idx"), "header")
    return tables.header_match(rows, formats).select(F.col("upload_id").alias("doc"), F.col("table_idx").alias("i"), "format_id", "score")
