"""Summary rows by what a company's earlier tables teach, and by fixed tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learned_rows as learned
from ..sources.binding import read
from .catalogue import query
from .cells import picked

MARKED_TABLES_SQL = """lines AS (SELECT o_custkey % 7 AS company, l_orderkey AS doc, list(['Acme ' || l_partkey % 20, '$' || CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)] ORDER BY l_linenumber, l_partkey, l_suppkey) AS body FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
 shaped AS (SELECT company, doc, CASE WHEN company % 2 = 0 THEN ['Client', 'Amount', 'Qty'] ELSE ['Group', 'Paid', 'Units'] END AS header,
  list_append(body, CASE company % 4 WHEN 0 THEN ['Total for Acme ' || doc % 3, '$' || len(body), ''] WHEN 1 THEN ['Carried FORWARD', '', ''] WHEN 2 THEN ['', 'SUMMARY page', '3'] ELSE ['Net Payable', '01/02/2024', doc::VARCHAR] END) AS rows FROM lines),
 tables_ AS (SELECT *, len(rows) - 1 AS s, md5('3|' || len(rows) || '|3.00|' || array_to_string(header, '|')) AS sig FROM shaped),
 used AS (SELECT company, sig, count(*) AS usage, least(100, 80 + 5 * (count(*) - 1)) AS confidence, arg_max(header, doc) AS header, arg_max(rows, doc) AS rows, arg_max(s, doc) AS s FROM tables_ WHERE doc % 2 = 0 GROUP BY 1, 2),
 facts AS (SELECT company, sig, usage, confidence, header[k] AS name, rows[s + 1][k] AS cell, k, s, rows, list_sort(list_filter(list_distinct(regexp_extract_all(rows[s + 1][k], '\\b[A-Za-z]+\\b')), lambda w: NOT list_contains(flatten(list_transform(rows[1:s], lambda r: regexp_extract_all(r[k], '\\b[A-Za-z]+\\b'))), w)))[1:10] AS keywords FROM used, (SELECT unnest([1, 2, 3]) AS k))"""

FIXED_TEST_SQL = """(regexp_matches(x, '(?i)^Total for Group:?\\s*[A-Za-z\\s]+$|^Total\\s+for\\s+Group:?\\s*[A-Za-z\\s]+$|^Group\\s+Total:?\\s*[A-Za-z\\s]+$|^Total:?\\s*[A-Za-z\\s]*$|^Subtotal:?\\s*[A-Za-z\\s]*$|^Grand Total:?\\s*[A-Za-z\\s]*$|^Summary:?\\s*[A-Za-z\\s]*$|^[A-Za-z\\s]+\\s+Total$|^Total\\s+[A-Za-z\\s]+$|^(Total|Subtotal|Summary|Group|Grand)\\s+|^.*\\s+(Total|Subtotal|Summary)$|^.*\\s+\\d+\\s+.*\\s+\\$\\d+\\.?\\d*$')
  OR regexp_matches(lower(c), 'total|subtotal|summary|grand|group|sum|count|amount|balance|net|final|overall|combined|aggregate') OR contains(lower(x), 'total for group'))"""


def marked_tables(spark, sf):
    """Each order as a table of its lines with a summary row at the end, worded by company; the marks are its position."""
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    row = F.array(F.concat(F.lit("Acme "), (F.col("l_partkey") % 20).cast("string")), F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(15,2)").cast("string")), F.col("l_quantity").cast("long").cast("string"))
    body = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row")))), lambda x: x["row"])
    t = lines.groupBy((F.col("o_custkey") % 7).alias("company_id"), F.col("l_orderkey").alias("upload_id")).agg(body.alias("body"))
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    doc, n = F.col("upload_id"), F.size("body").cast("string")
    last = picked(F.col("company_id"), [F.array(F.concat(F.lit("Total for Acme "), (doc % 3).cast("string")), F.concat(F.lit("$"), n), F.lit("")), lit("Carried FORWARD", "", ""), lit("", "SUMMARY page", "3"), F.array(F.lit("Net Payable"), F.lit("01/02/2024"), doc.cast("string"))])
    header = F.when(F.col("company_id") % 2 == 0, lit("Client", "Amount", "Qty")).otherwise(lit("Group", "Paid", "Units"))
    return t.select("company_id", "upload_id", F.lit(0).alias("table_idx"), header.alias("header"), F.array_append("body", last).alias("rows"), F.array(F.size("body")).alias("summaries"))


@query(f"""WITH {MARKED_TABLES_SQL} SELECT company, sig AS signature, usage, confidence::INTEGER AS confidence, name, array_to_string(keywords, ',') AS keywords, CASE WHEN regexp_matches(cell, '^\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}') THEN 'date' WHEN regexp_matches(cell, '^\\$?\\d+(,\\d{{3}})*(\\.\\d{{2}})?$') THEN 'currency' WHEN regexp_matches(replace(cell, ',', ''), '^\\d+(\\.\\d+)?$') THEN 'numeric' ELSE 'string' END AS data_type,
  length(cell)::DOUBLE AS avg_length, (trim(cell) = '')::INT::DOUBLE AS empty_ratio, contains(lower(cell), 'total') AS total, round(s::DOUBLE / len(rows), 9) AS avg_position, round(length(array_to_string(rows[s + 1], ' ')) / greatest(list_avg(list_transform(rows[1:s], lambda r: length(array_to_string(r, ' ')))), 1), 9) AS length_ratio FROM facts""")
def summary_patterns(spark, sf):
    """Patterns learnt from the tables of even orders: keywords, types and shape of each column's summary cells, with use and confidence."""
    p = learned.learn(marked_tables(spark, sf).where("upload_id % 2 = 0"))
    c = p.select(F.col("company_id").alias("company"), "signature", "usage", "confidence", F.explode("columns").alias("c"), "row")
    return c.select("company", "signature", "usage", "confidence", "c.name", F.array_join("c.keywords", ",").alias("keywords"), "c.data_type", "c.avg_length", "c.empty_ratio", "c.total", F.round("row.avg_position", 9).alias("avg_position"), F.round("row.length_ratio", 9).alias("length_ratio"))


@query(f"""WITH {MARKED_TABLES_SQL}, words AS (SELECT company, sig, name, unnest(list_concat(list_transform(keywords, lambda w: lower(w)), list_filter(['total', 'summary', 'subtotal'], lambda w: contains(lower(cell), w)))) AS word FROM facts),
 whole AS (SELECT company, sig, unnest(list_filter(['total', 'summary', 'subtotal'], lambda w: contains(lower(array_to_string(rows[s + 1], ' ')), w))) AS word FROM used WHERE s > 0),
 r AS (SELECT company, doc, sig, header, unnest(rows) AS row_, unnest(range(len(rows))) AS i FROM tables_ WHERE doc % 2 = 1),
 cells AS (SELECT company, doc, sig, i, lower(row_[k]) AS cell, header[k] AS name FROM r, (SELECT unnest([1, 2, 3]) AS k)),
 found AS (SELECT doc, i FROM cells JOIN words USING (company, name) WHERE cells.sig <> words.sig AND contains(cell, word) UNION SELECT doc, i FROM r JOIN whole USING (company) WHERE r.sig <> whole.sig AND contains(lower(array_to_string(row_, ' ')), word)
  UNION SELECT doc, min(i) FROM r JOIN used ON used.company = r.company AND used.sig = r.sig AND used.rows[used.s + 1] = row_ GROUP BY 1),
 fixed AS (SELECT doc, i FROM (SELECT doc, i, trim(array_to_string(row_, ' ')) AS x, row_[1] AS c FROM r) WHERE {FIXED_TEST_SQL})
 SELECT DISTINCT r.doc, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM found WHERE found.doc = r.doc), '') AS learned, coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM fixed WHERE fixed.doc = r.doc), '') AS fixed FROM r""")
def pattern_summaries(spark, sf):
    """Summary rows of odd orders' tables, found by the patterns of even ones and by the fixed tests."""
    t = marked_tables(spark, sf)
    out = learned.apply(t.where("upload_id % 2 = 1"), learned.learn(t.where("upload_id % 2 = 0")))
    fixed = F.filter(F.transform("rows", lambda r, i: F.when(learned.looks_like_summary(r), i)), lambda i: i.isNotNull())
    said = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return out.select(F.col("upload_id").alias("doc"), said(F.col("learned")).alias("learned"), said(fixed).alias("fixed"))
