"""Statement queries: parsing, cleaning, reconciling, ledger changes, name matching, event checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fuzzy, ledger, tables
from ..sources import text
from ..sources.binding import ENTRIES_SQL, entries, read
from ..streaming import events as stream
from .catalogue import query

dbl = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")

RAW_SQL = r"""raw AS (SELECT p_partkey AS id, CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS VARCHAR) AS x FROM part), cells AS (SELECT id, CASE id % 9 WHEN 0 THEN '$' || x WHEN 1 THEN '(' || x || ')' WHEN 2 THEN '($' || x || ')' WHEN 3 THEN '-' || x
  WHEN 4 THEN '-$' || x WHEN 5 THEN ' ' || x || ' ' WHEN 6 THEN 'n/a' WHEN 7 THEN '' ELSE x || '%' END AS c FROM raw)"""


def raw_cells(spark, sf):
    """Prices written the ways statements write them."""
    x = F.col("p_retailprice").cast("decimal(15,2)").cast("string")
    k = F.col("p_partkey") % 9
    forms = [F.concat(F.lit("$"), x), F.concat(F.lit("("), x, F.lit(")")), F.concat(F.lit("($"), x, F.lit(")")), F.concat(F.lit("-"), x), F.concat(F.lit("-$"), x), F.concat(F.lit(" "), x, F.lit(" ")), F.lit("n/a"), F.lit("")]
    c = F.concat(x, F.lit("%"))
    for i, form in enumerate(forms):
        c = F.when(k == i, form).otherwise(c)
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), c.alias("c"))


NUM_SQL = r"CASE WHEN regexp_full_match({t}, '[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?') THEN TRY_CAST({t} AS DOUBLE) END"


@query(f"""WITH {RAW_SQL}, t AS (SELECT id, c, regexp_replace(c, '[$,\\s]', '', 'g') AS t FROM cells), u AS (SELECT id, t, regexp_replace(t, '[()]', '', 'g') AS i FROM t)
  SELECT id, coalesce(CASE WHEN t LIKE '(%)' THEN -abs({NUM_SQL.format(t='i')}) ELSE {NUM_SQL.format(t='i')} END, 0.0) AS amount FROM u""")
def amounts_ledger(spark, sf):
    return raw_cells(spark, sf).select("id", S.amount_ledger(F.col("c")).alias("amount"))


@query(f"""WITH {RAW_SQL}, t AS (SELECT id, trim(c) AS c, regexp_replace(c, '[^0-9.]', '', 'g') AS i FROM cells)
  SELECT id, coalesce(CASE WHEN c LIKE '(%' OR c LIKE '-%' OR c LIKE '$-%' THEN -({NUM_SQL.format(t='i')}) ELSE {NUM_SQL.format(t='i')} END, 0.0) AS amount FROM t""")
def amounts_legacy(spark, sf):
    return raw_cells(spark, sf).select("id", S.amount_legacy(F.col("c")).alias("amount"))


@query(f"""WITH {RAW_SQL}, t AS (SELECT id, regexp_replace(c, '[$€£¥,\\s]', '', 'g') AS t FROM cells), u AS (SELECT id, t, regexp_replace(t, '^\\(|\\)$', '', 'g') AS i FROM t)
  SELECT id, CASE WHEN t LIKE '(_%)' THEN -abs({NUM_SQL.format(t='i')}) ELSE {NUM_SQL.format(t='i')} END AS amount FROM u""")
def amounts_strict(spark, sf):
    return raw_cells(spark, sf).select("id", S.amount_strict(F.col("c")).alias("amount"))


@query(f"""WITH {RAW_SQL}, t AS (SELECT id, regexp_replace(c, '[^0-9.\\-]', '', 'g') AS i FROM cells) SELECT id, coalesce({NUM_SQL.format(t='i')}, 0.0) AS amount FROM t""")
def amounts_client(spark, sf):
    return raw_cells(spark, sf).select("id", S.amount_client(F.col("c")).alias("amount"))


BRACKET_FORMS = ["({x})", "($ {x} )", "(\\${x}) net", "(-{x}$)", "\\(\\${x}\\)", "${x} due", " {x} ", "$({x})", "(,)", "( - 7 )", "(a)", "  ", "-{x}"]
BRACKET_LIST = "[" + ", ".join(f"'{x}'" for x in BRACKET_FORMS) + "]"
BRACKET_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '')" for p in S.BRACKETS) + ")"
_bare = "CASE WHEN regexp_full_match(replace({m}, ',', ''), '\\d+\\.?\\d*|\\.\\d+') THEN replace({m}, ',', '') ELSE {m} END"


@query(f"""WITH f AS (SELECT p_partkey AS id, replace({BRACKET_LIST}[1 + p_partkey % {len(BRACKET_FORMS)}], '{{x}}', printf('%,d', p_partkey * 37 + 1000) || '.' || p_size % 10) AS c FROM part), t AS (SELECT id, c, trim(c) AS t FROM f), m AS (SELECT *, {BRACKET_SQL} AS m, nullif(regexp_extract(t, '{S.PLAIN_AMOUNT}', 1), '') AS p FROM t)
  SELECT id, CASE WHEN t = '' THEN c WHEN m IS NOT NULL THEN '-$' || {_bare.format(m="m")} WHEN p IS NOT NULL THEN '$' || {_bare.format(m="p")} ELSE t END AS c FROM m""")
def brackets(spark, sf):
    """Amounts in brackets of many forms as signed amounts."""
    form = F.element_at(F.array(*[F.lit(x) for x in BRACKET_FORMS]), (F.col("p_partkey") % len(BRACKET_FORMS) + 1).cast("int"))
    amount = F.concat(F.format_number(F.col("p_partkey") * 37 + 1000, 0), F.lit("."), (F.col("p_size") % 10).cast("string"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), S.bracket_rewrite(F.replace(form, F.lit("{x}"), amount)).alias("c"))


@query(f"""WITH {RAW_SQL} SELECT CASE WHEN trim(c) = '' THEN 'empty' WHEN regexp_matches(trim(c), '^[(-]?\\$\\s?[0-9][0-9,]*(\\.[0-9]+)?\\)?$') THEN 'currency' WHEN regexp_matches(trim(c), '^-?[0-9]+(\\.[0-9]+)?\\s?%$') THEN 'percentage'
  WHEN regexp_matches(trim(c), '^-?[0-9][0-9,]*(\\.[0-9]+)?$') THEN 'number' ELSE 'text' END AS kind, count(*) AS n FROM cells GROUP BY 1""")
def value_types(spark, sf):
    return raw_cells(spark, sf).groupBy(S.value_type(F.col("c")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {ENTRIES_SQL}, c AS (SELECT upload_id, CAST(sum(invoice) AS DOUBLE) AS calc FROM entries GROUP BY 1) SELECT upload_id, CASE WHEN calc < 0.01 THEN 'needs_review' WHEN o_totalprice IS NULL OR o_totalprice = 0 THEN 'Approved' WHEN abs(calc - o_totalprice) / abs(o_totalprice) * 100 < 5 THEN 'Approved' ELSE 'needs_review' END AS status,
  CASE WHEN o_totalprice IS NULL AND calc > 0 THEN 'accepted_unverified' WHEN o_totalprice IS NULL THEN 'no_totals' WHEN abs(calc - o_totalprice) <= greatest(5.0, abs(o_totalprice) * 0.05::DOUBLE) THEN 'match' ELSE 'mismatch' END AS auto_status FROM c JOIN orders ON o_orderkey = upload_id""")
def reconciliation(spark, sf):
    """Calculated against stated totals, by the approval rule and by the automatic one."""
    c = entries(spark, sf).groupBy("upload_id").agg(dbl(F.sum("invoice")).alias("calc"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("upload_id"), "o_totalprice")
    return c.join(o, "upload_id").select("upload_id", S.reconcile(F.col("calc"), F.col("o_totalprice")).alias("status"), S.auto_reconcile(F.col("calc"), F.col("o_totalprice")).alias("auto_status"))


DATE_SQL = "dates AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE 'unknown' END AS s FROM orders)"


@query(f"WITH {DATE_SQL} SELECT id, CASE WHEN s = 'unknown' THEN NULL ELSE d END AS parsed FROM dates")
def statement_dates(spark, sf):
    """Written dates of several layouts read back."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    k = F.col("id") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise("unknown")
    ranged = F.concat(s, F.lit(" through "), s)
    return o.select("id", S.statement_date(S.range_start(ranged)).alias("parsed"))


@query("SELECT p_partkey AS id, regexp_replace(trim(regexp_replace(lower(p_name), '[^a-z0-9\\s.]', ' ', 'g')), '\\s+', ' ', 'g') AS header, md5(lower(p_type) || '|' || p_brand) AS signature FROM part")
def header_normal_forms(spark, sf):
    h = S.header(F.regexp_replace(F.lower(F.col("p_name")), r"[^a-z0-9\s.]", " "))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), h.alias("header"), F.md5(F.concat(F.lower("p_type"), F.lit("|"), F.col("p_brand")).cast("binary")).alias("signature"))


@query("SELECT doc_id, coalesce(len(list_filter(string_split_regex(lower(text), '\\n'), lambda l: regexp_matches(trim(l), '^total|grand total|sub-?total|summary'))), 0) AS n_summary FROM documents")
def summary_lines(spark, sf):
    """Lines of a text that look like totals."""
    hit = lambda line: F.lower(F.trim(line)).rlike(r"^total|grand total|sub-?total|summary")
    return read(spark, sf, "documents").select("doc_id", F.coalesce(F.size(F.filter(F.split("text", "\n"), hit)), F.lit(0)).cast("long").alias("n_summary"))


@query("WITH w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN upper(p_brand) WHEN 1 THEN ' ' || lower(p_brand) ELSE p_brand END AS b FROM part) SELECT lower(trim(b)) AS name, count(*) AS n, min(p_partkey) AS first_id, count(DISTINCT b) AS spellings FROM w GROUP BY 1")
def case_insensitive_groups(spark, sf):
    """Names that differ by case or outer blanks are one."""
    b, k = F.col("p_brand"), F.col("p_partkey") % 3
    w = read(spark, sf, "part").select("p_partkey", F.when(k == 0, F.upper(b)).when(k == 1, F.concat(F.lit(" "), F.lower(b))).otherwise(b).alias("b"))
    return w.groupBy(F.lower(F.trim("b")).alias("name")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_id"), F.countDistinct("b").alias("spellings"))


def _uploads_with_tables(spark, sf):
    """Each order as an extracted table: header, one row per line item, a last row with the total marked as summary."""
    money = lambda c: F.concat(F.lit("$"), F.col(c).cast("decimal(15,2)").cast("string"))
    lines = read(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.array(F.concat(F.lit("Group "), F.col("l_suppkey").cast("string")), money("l_extendedprice"), F.concat(F.lit("("), F.col("l_tax").cast("decimal(15,2)").cast("string"), F.lit(")"))).alias("cells"), F.col("l_extendedprice").cast("decimal(15,2)").alias("v")).alias("r"))
    t = lines.groupBy(F.col("l_orderkey").alias("upload_id")).agg(F.sort_array(F.collect_list("r")).alias("r"), F.sum("r.v").alias("total"))
    rows = F.concat(F.transform("r", lambda x: x["cells"]), F.array(F.array(F.lit("Grand Total"), F.concat(F.lit("$"), F.col("total").cast("decimal(15,2)").cast("string")))))
    table = F.struct(F.array(F.lit("Group \nName"), F.lit("Invoice"), F.lit("Commission")).alias("header"), rows.alias("rows"), F.array(F.size("r")).alias("summaryRows"))
    return t.select("upload_id", F.array(table).alias("tables"))


@query("SELECT l_orderkey AS upload_id, 'Group ' || l_suppkey AS client_name, 0 - CAST(CAST(l_tax AS DECIMAL(15,2)) AS DOUBLE) AS commission, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) AS invoice FROM lineitem WHERE CAST(l_tax AS DECIMAL(15,2)) <> 0 OR CAST(l_extendedprice AS DECIMAL(15,2)) <> 0")
def flatten_statements(spark, sf):
    """Extracted tables to ledger input: headers normalised, summary rows skipped, short rows padded, amounts parsed."""
    out = tables.flatten(tables.explode_tables(_uploads_with_tables(spark, sf)), "Group Name", "Commission", "Invoice")
    return out.select("upload_id", "client_name", (F.col("commission") + 0.0).alias("commission"), "invoice")


ORDERED_SQL = """ordered AS (SELECT l_orderkey AS upload_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, 'Group ' || l_suppkey AS name, CAST(l_extendedprice AS DECIMAL(15,2)) AS v FROM lineitem)"""

PROMOTED_SQL = ORDERED_SQL + """, r AS (SELECT upload_id, i, v, upload_id % 3 = 0 AND i = 0 AS marked FROM ordered), o AS (SELECT upload_id, count(*) AS n, coalesce(sum(CASE WHEN NOT marked THEN v END), 0) AS s FROM r GROUP BY 1),
  last AS (SELECT o.*, CAST(o_totalprice AS DECIMAL(15,2)) AS doc, CASE upload_id % 5 WHEN 0 THEN s WHEN 1 THEN s + 0.99 WHEN 2 THEN s + 1.00 WHEN 4 THEN CAST(o_totalprice AS DECIMAL(15,2)) END AS v FROM o JOIN orders ON o_orderkey = upload_id),
  own AS (SELECT r.upload_id, n, doc, max(CASE WHEN i = n - 1 THEN v END) AS v, bool_or(marked AND i = n - 1) AS marked, coalesce(sum(CASE WHEN NOT marked AND i < n - 1 THEN v END), 0) AS s FROM r JOIN (SELECT upload_id, n, doc FROM last WHERE v IS NULL) USING (upload_id) GROUP BY 1, 2, 3)"""


def _tables_with_last_rows(spark, sf):
    """Each order as a table of amounts whose last row is the sum of the others, nearly, just not, the stated total, or a line."""
    r = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("upload_id")).agg(F.sort_array(F.collect_list(r)).alias("r"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("upload_id"), F.col("o_totalprice").cast("decimal(15,2)").alias("doc"))
    lines = F.transform("r", lambda x, i: F.struct(x["l_extendedprice"].cast("decimal(15,2)").alias("v"), ((F.col("upload_id") % 3 == 0) & (i == 0)).alias("m")))
    total = F.aggregate(F.filter("lines", lambda x: ~x["m"]), F.lit(0).cast("decimal(15,2)"), lambda s, x: (s + x["v"]).cast("decimal(15,2)"))
    k = F.col("upload_id") % 5
    more = F.when(k == 0, F.col("s")).when(k == 1, F.col("s") + F.lit("0.99").cast("decimal(3,2)")).when(k == 2, F.col("s") + F.lit("1.00").cast("decimal(3,2)")).when(k == 4, F.col("doc"))
    t = t.join(o, "upload_id").withColumn("lines", lines).withColumn("s", total).withColumn("more", more.cast("decimal(15,2)"))
    rows = F.when(F.col("more").isNull(), F.col("lines")).otherwise(F.concat("lines", F.array(F.struct(F.col("more").alias("v"), F.lit(False).alias("m")))))
    x = t.select("upload_id", "doc", F.posexplode(rows).alias("row_idx", "x"))
    return x.select("upload_id", F.lit(0).alias("table_idx"), "row_idx", "doc", F.col("x.v").alias("v"), F.col("x.m").alias("is_summary"))


@query(f"""WITH {PROMOTED_SQL} SELECT upload_id, n AS row_idx FROM last WHERE v IS NOT NULL AND n >= 1 AND doc <> 0 AND (abs(v - s) < 1 OR abs(v - doc) < 0.01)
  UNION ALL SELECT upload_id, n - 1 FROM own WHERE n >= 2 AND NOT marked AND doc <> 0 AND (abs(v - s) < 1 OR abs(v - doc) < 0.01)""")
def promoted_totals(spark, sf):
    """Last rows found to be totals, among rows that miss by a cent or are lines like the others."""
    rows = _tables_with_last_rows(spark, sf)
    out = tables.promote_last_total(rows.withColumn("was", F.col("is_summary")), "v", "doc").where("is_summary and not was")
    return out.select("upload_id", F.col("row_idx").cast("long").alias("row_idx"))


RUNNING_SQL = "RECURSIVE " + ORDERED_SQL + """, spaced AS (SELECT upload_id, i + i // 3 AS i, name, CAST(v AS DOUBLE) AS v, i // 3 AS part, i FROM ordered),
  sums AS (SELECT upload_id, part, CAST(sum(ordered.v) AS DOUBLE) AS s, count(*) AS n FROM (SELECT *, i // 3 AS part FROM ordered) ordered GROUP BY 1, 2 HAVING count(*) = 3),
  rows_ AS (SELECT upload_id, i, lower(name) AS name, v FROM spaced UNION ALL SELECT upload_id, part * 4 + 3, CASE upload_id % 4 WHEN 0 THEN 'total for group' WHEN 1 THEN '' WHEN 2 THEN 'subtotal' ELSE 'carried' END, round(CASE upload_id % 4 WHEN 2 THEN s * 1.02::DOUBLE WHEN 3 THEN s * 1.005::DOUBLE ELSE s END, 2) FROM sums),
  scan AS (SELECT upload_id, -1::BIGINT AS i, 0.0::DOUBLE AS s, false AS hit FROM (SELECT DISTINCT upload_id FROM rows_)
    UNION ALL SELECT upload_id, i, CASE WHEN hit THEN 0.0::DOUBLE ELSE s + v END, hit FROM (SELECT scan.upload_id, r.i, scan.s, r.v,
      (scan.s <> 0 AND abs(r.v - scan.s) <= greatest(abs(scan.s) * 0.0075::DOUBLE, 0.01::DOUBLE) OR r.name LIKE '%total%' OR r.name = '')
      AND round(CASE WHEN r.name LIKE '%total%' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN r.name = 'total for group' THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN r.name = '' THEN 0.2::DOUBLE ELSE 0 END
        + CASE WHEN scan.s <> 0 AND abs(r.v - scan.s) <= greatest(abs(scan.s) * 0.0075::DOUBLE, 0.01::DOUBLE) THEN 0.45::DOUBLE ELSE 0 END, 9) >= 0.55::DOUBLE AS hit
      FROM scan JOIN rows_ r ON r.upload_id = scan.upload_id AND r.i = scan.i + 1))"""


def _tables_with_subtotals(spark, sf):
    """Each order as a table of two columns with a row after every third line: a named total, a bare one, or a sum off by two or half a per cent."""
    r = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("upload_id")).agg(F.sort_array(F.collect_list(r)).alias("r"))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("r") / F.lit(3)).cast("int") - 1), lambda p: F.slice("r", p * 3 + 1, F.lit(3)))
    k = F.col("upload_id") % 4

    def closed(part):
        s = F.aggregate(part, F.lit(0).cast("decimal(15,2)"), lambda s, x: (s + x["l_extendedprice"].cast("decimal(15,2)")).cast("decimal(15,2)")).cast("double")
        total = F.round(F.when(k == 2, s * 1.02).when(k == 3, s * 1.005).otherwise(s), 2).cast("decimal(15,2)").cast("string")
        name = F.when(k == 0, "Total for Group").when(k == 1, "").when(k == 2, "Subtotal").otherwise("Carried")
        lines = F.transform(part, lambda x: F.array(F.concat(F.lit("Group "), x["l_suppkey"].cast("string")), F.concat(F.lit("$"), x["l_extendedprice"].cast("decimal(15,2)").cast("string"))))
        return F.when(F.size(part) == 3, F.concat(lines, F.array(F.array(name, total)))).otherwise(lines)

    return t.select("upload_id", F.array(F.lit("Name"), F.lit("Amount")).alias("header"), F.flatten(F.transform(parts, closed)).alias("rows"), F.array(F.lit(1)).alias("numeric"))


@query(f"WITH {RUNNING_SQL} SELECT upload_id, i AS row_idx FROM scan WHERE hit")
def running_totals(spark, sf):
    """Rows that score as totals of the rows since the last total, by a fold over each table's own rows."""
    # explode_outer here and below: Spark would work the array out twice, once to leave out empty ones
    found = tables.running_summaries(_tables_with_subtotals(spark, sf))
    return found.select("upload_id", F.explode_outer("summaries").alias("i")).where("i is not null").select("upload_id", F.col("i").cast("long").alias("row_idx"))


REFINED_SQL = ORDERED_SQL + r""", r AS (SELECT upload_id, i, name, v::VARCHAR AS a, count(*) OVER (PARTITION BY upload_id) AS n FROM ordered),
  shaped AS (SELECT upload_id, i, n, CASE (upload_id + i) % 7 WHEN 0 THEN ['Grand Total', '', a, a] WHEN 1 THEN ['', '', a, ''] WHEN 2 THEN [name, 'plan', '', ''] WHEN 3 THEN [name, 'x', a, a] WHEN 4 THEN ['12', '', a, ''] WHEN 5 THEN ['Vendor one', '', '', ''] ELSE [name, 'total', a, 'total'] END AS c FROM r),
  f AS (SELECT *, len(list_filter(c, lambda x: x <> '')) AS k, len(list_filter(c, lambda x: regexp_full_match(x, '[0-9.]+'))) AS num, list_aggregate(list_filter(list_transform(c, lambda x: lower(x)), lambda x: x <> ''), 'string_agg', ' ') AS t,
    len(list_filter(c[1:2], lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9.]+'))) > 0 AS named, len(list_filter(c[1:2], lambda x: x <> '')) = 0 AS blank FROM shaped),
  lim AS (SELECT upload_id, greatest(2, ceil(least(avg(k), list_sort(list(k))[count(*) // 2 + 1]) * 0.4::DOUBLE)) AS lim FROM f GROUP BY 1),
  judged AS (SELECT f.*, lim, regexp_matches(t, '\btotal\s+for\b|\bgrand\s+total\b|\bsummary\b') OR (length(t) - length(replace(t, 'total', ''))) // 5 > 1 OR (k <= 3 AND contains(t, 'total'))
    OR (k <= 4 AND num <= 2 AND (contains(t, 'total') OR contains(t, 'vendor') OR contains(t, 'summary') OR contains(t, 'plan'))) OR (k <= 5 AND blank AND num >= 1) AS reads FROM f JOIN lim USING (upload_id))"""


@query(f"""WITH {REFINED_SQL} SELECT upload_id, i AS row_idx FROM judged WHERE reads OR (k <= lim AND NOT named AND num >= 2) OR (k <= 3 AND num >= 1 AND NOT named AND k = num) OR (i = 0 AND NOT (named AND k > lim * 1.5::DOUBLE))""")
def refined_summaries(spark, sf):
    """Summary rows found by density and wording; the first row of each table arrives marked."""
    r = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    t = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("upload_id")).agg(F.sort_array(F.collect_list(r)).alias("r"))

    def shape(x, i):
        a, name = x["l_extendedprice"].cast("decimal(15,2)").cast("string"), F.concat(F.lit("Group "), x["l_suppkey"].cast("string"))
        k, e = (F.col("upload_id") + i) % 7, F.lit("")
        return F.when(k == 0, F.array(F.lit("Grand Total"), e, a, a)).when(k == 1, F.array(e, e, a, e)).when(k == 2, F.array(name, F.lit("plan"), e, e)).when(k == 3, F.array(name, F.lit("x"), a, a)).when(k == 4, F.array(F.lit("12"), e, a, e)).when(k == 5, F.array(F.lit("Vendor one"), e, e, e)).otherwise(F.array(name, F.lit("total"), a, F.lit("total")))

    header = F.array(F.lit("Group Name"), F.lit("Kind"), F.lit("Paid"), F.lit("Due"))
    shaped = t.select("upload_id", header.alias("header"), F.transform("r", shape).alias("rows"), F.array(F.lit(0)).alias("summaries"))
    return tables.refined_summaries(shaped).select("upload_id", F.explode_outer("summaries").alias("i")).where("i is not null").select("upload_id", F.col("i").cast("long").alias("row_idx"))


GRAND_SQL = """t AS (SELECT l_orderkey AS upload_id, count(*) AS n, CASE l_orderkey % 6 WHEN 0 THEN ['Group Name', 'Invoice Total', 'Commission'] WHEN 1 THEN ['Total Invoice', 'Total Commission'] WHEN 2 THEN ['Paid Amount', 'Rate', 'Notes'] WHEN 3 THEN ['Commission Amount'] WHEN 4 THEN ['Company', 'Total'] ELSE ['Total Premium', 'Total Paid', 'Period', 'Due Amount', 'Commission'] END AS h,
  CASE WHEN l_orderkey % 4 = 0 THEN count(*) ELSE l_orderkey % 2 END AS marked FROM lineitem GROUP BY l_orderkey),
  c AS (SELECT *, len(list_filter(h, lambda x: regexp_matches(lower(x), 'total|commission|amount|paid|invoice|premium'))) >= len(h) * 0.8::DOUBLE AS money, len(list_filter(h, lambda x: regexp_matches(lower(x), 'group id|client|company|policy|member|subscriber|agent|producer|group name'))) = 0 AS nameless, len(list_filter(h, lambda x: contains(lower(x), 'total'))) > 0 AS total FROM t)"""


@query(f"WITH {GRAND_SQL} SELECT upload_id, nameless AND ((n = 1 AND money) OR (marked = n AND n <= 3) OR (n <= 3 AND money AND total)) AS grand_total FROM c")
def grand_total_tables(spark, sf):
    """Tables that only repeat totals, among headers with and without identifiers."""
    k = F.col("l_orderkey") % 6
    heads = [["Group Name", "Invoice Total", "Commission"], ["Total Invoice", "Total Commission"], ["Paid Amount", "Rate", "Notes"], ["Commission Amount"], ["Company", "Total"]]
    h = F.array(*[F.lit(x) for x in ("Total Premium", "Total Paid", "Period", "Due Amount", "Commission")])
    for i, head in enumerate(heads):
        h = F.when(k == i, F.array(*[F.lit(x) for x in head])).otherwise(h)
    t = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("marked", F.when(F.col("l_orderkey") % 4 == 0, F.col("n")).otherwise(F.col("l_orderkey") % 2))
    return t.select(F.col("l_orderkey").alias("upload_id"), tables.is_grand_total(h, F.col("n"), F.col("marked")).alias("grand_total"))


@query("SELECT l_orderkey AS upload_id, 3::BIGINT AS n_columns, count(*) + 1 AS filled_first, CAST(count(*) AS DOUBLE) AS filled_last FROM lineitem GROUP BY 1")
def table_profiles(spark, sf):
    p = tables.column_profile(tables.explode_tables(_uploads_with_tables(spark, sf)))
    return p.groupBy("upload_id").agg(F.count("*").alias("n_columns"), F.max(F.when(F.col("col_idx") == 0, F.col("filled"))).alias("filled_first"), dbl(F.max(F.when(F.col("col_idx") == 2, F.col("filled")))).alias("filled_last"))


MERGE_SQL = """built AS (SELECT carrier_id, client_name, month, year, user_id, environment_id, upload_id % 2 AS half, sum(invoice) AS inv, sum(commission) AS com, list(DISTINCT upload_id) AS ids FROM entries GROUP BY ALL),
  o AS (SELECT * FROM built WHERE half = 0), n AS (SELECT * FROM built WHERE half = 1)"""


@query(f"""WITH {ENTRIES_SQL}, {MERGE_SQL} SELECT coalesce(o.carrier_id, n.carrier_id) AS carrier_id, coalesce(o.client_name, n.client_name) AS client_name, coalesce(o.month, n.month) AS month, coalesce(o.year, n.year) AS year,
  coalesce(o.environment_id, n.environment_id) AS environment_id, CAST(coalesce(o.inv, 0) + coalesce(n.inv, 0) AS DOUBLE) AS invoice_total, CAST(coalesce(o.com, 0) + coalesce(n.com, 0) AS DOUBLE) AS commission_earned,
  CASE WHEN o.ids IS NULL THEN 1 WHEN n.ids IS NULL THEN len(o.ids) ELSE len(o.ids) + 1 END::BIGINT AS statement_count, (coalesce(len(o.ids), 0) + coalesce(len(n.ids), 0))::BIGINT AS uploads
  FROM o FULL JOIN n ON o.carrier_id = n.carrier_id AND o.client_name = n.client_name AND o.month = n.month AND o.year = n.year AND o.user_id = n.user_id AND o.environment_id = n.environment_id""")
def ledger_merge(spark, sf):
    """A second batch of statements merged into the ledger of the first."""
    e = entries(spark, sf)
    old, new = ledger.build(e.where("upload_id % 2 = 0")), ledger.build(e.where("upload_id % 2 = 1")).withColumn("statement_count", F.lit(1))
    out = ledger.merge(old, new)
    return out.select("carrier_id", "client_name", "month", "year", "environment_id", dbl("invoice_total").alias("invoice_total"), dbl("commission_earned").alias("commission_earned"), F.col("statement_count").cast("long").alias("statement_count"), F.size("upload_ids").cast("long").alias("uploads"))


@query(f"""WITH {ENTRIES_SQL} SELECT carrier_id, client_name, month, year, environment_id, CAST(sum(invoice) AS DOUBLE) AS invoice_total, count(DISTINCT upload_id) AS uploads FROM entries GROUP BY carrier_id, client_name, month, year, user_id, environment_id""")
def ledger_replay(spark, sf):
    """The same statements merged twice: the second time replaces, so nothing changes."""
    built = ledger.build(entries(spark, sf, ledger.KEY))
    out = ledger.merge(built, built)
    return out.select("carrier_id", "client_name", "month", "year", "environment_id", dbl("invoice_total").alias("invoice_total"), F.size("upload_ids").cast("long").alias("uploads"))


@query(f"""WITH {ENTRIES_SQL} SELECT carrier_id, client_name, month, year, environment_id, CAST(sum(invoice) AS DOUBLE) AS invoice_total, CAST(sum(commission) AS DOUBLE) AS commission_earned FROM entries WHERE upload_id <> 7 GROUP BY carrier_id, client_name, month, year, user_id, environment_id""")
def ledger_retract(spark, sf):
    """One statement taken back."""
    e = entries(spark, sf)
    out = ledger.retract(ledger.build(e), ledger.build(e.where("upload_id = 7")), 7)
    return out.select("carrier_id", "client_name", "month", "year", "environment_id", dbl("invoice_total").alias("invoice_total"), dbl("commission_earned").alias("commission_earned"))


@query(f"""WITH {ENTRIES_SQL} SELECT CASE carrier_id WHEN 2 THEN 1 ELSE carrier_id END AS carrier_id, client_name, month, year, environment_id, CAST(sum(invoice) AS DOUBLE) AS invoice_total, CAST(sum(commission) AS DOUBLE) AS commission_earned FROM entries GROUP BY 1, client_name, month, year, user_id, environment_id""")
def carrier_merge(spark, sf):
    out = ledger.rekey_carrier(ledger.build(entries(spark, sf, ledger.KEY)), 2, 1)
    return out.select("carrier_id", "client_name", "month", "year", "environment_id", dbl("invoice_total").alias("invoice_total"), dbl("commission_earned").alias("commission_earned"))


@query("""WITH l AS (SELECT user_id AS id, event_type, value, event_id, ts, ts >= TIMESTAMP '2024-01-15' AS fresh FROM events), o AS (SELECT id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM l WHERE NOT fresh AND id % 3 <> 0 GROUP BY 1),
  n AS (SELECT id, arg_max(event_type, (ts, event_id)) AS t, arg_max(value, (ts, event_id)) AS v FROM l WHERE fresh AND id % 3 <> 1 GROUP BY 1) SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.t ELSE n.t END AS last_type, CASE WHEN n.id IS NULL THEN o.v ELSE n.v END AS last_value FROM o FULL JOIN n ON o.id = n.id""")
def upsert_latest(spark, sf):
    """Rows of a second half overwrite those of the first by key, the last of several; the rest is inserted or stays."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("last_type"), F.col("value").alias("last_value"), F.struct("ts", "event_id").alias("at"), (F.col("ts") >= F.expr("timestamp_ntz '2024-01-15'")).alias("fresh"))
    old = ledger.upsert(e.limit(0), e.where("not fresh and id % 3 <> 0"), ["id"], "at")
    return ledger.upsert(old, e.where("fresh and id % 3 <> 1"), ["id"], "at").select("id", "last_type", "last_value")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - CASE o_orderstatus WHEN 'F' THEN INTERVAL 3650 DAY WHEN 'O' THEN INTERVAL 365 DAY ELSE INTERVAL 30 DAY END GROUP BY 1")
def orphan_purge(spark, sf):
    """What is left after each status' age limit; the clock is a parameter."""
    limit = F.when(F.col("o_orderstatus") == "F", F.expr("interval 3650 days")).when(F.col("o_orderstatus") == "O", F.expr("interval 365 days")).otherwise(F.expr("interval 30 days"))
    return read(spark, sf, "orders").where(F.col("o_orderdate") >= F.expr("timestamp_ntz '1998-01-01'") - limit).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON substr(lower(a.s_name), 1, 3) = substr(lower(b.s_name), 1, 3) AND a.s_suppkey < b.s_suppkey AND a.s_nationkey = b.s_nationkey WHERE 1 - CAST(levenshtein(lower(a.s_name), lower(b.s_name)) AS DOUBLE) / greatest(length(a.s_name), length(b.s_name)) >= 0.9::DOUBLE")
def similar_names(spark, sf):
    """Names alike inside blocks of nation and first letters."""
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return fuzzy.similar_pairs(s, ["nation"], 0.9).select("a", "b")


@query("""WITH g AS (SELECT c_custkey AS id, lpad((c_custkey // 4)::VARCHAR, 9, '0') AS k, c_custkey % 4 AS r FROM customer), n AS (SELECT id, k, CASE r WHEN 0 THEN 'company k' || k || ' works' WHEN 1 THEN 'companyk' || k || 'works' WHEN 2 THEN 'company k' || k || ' wor' ELSE 'company other' || k || ' trading' END AS core, r FROM g),
  f AS (SELECT k, min(CASE WHEN r < 3 THEN id END) AS l FROM n GROUP BY 1) SELECT n.id, n.core, CASE WHEN n.r = 3 THEN n.core ELSE o.core END AS leader FROM n JOIN f USING (k) LEFT JOIN n o ON o.id = f.l""")
def name_groups(spark, sf):
    """Greedy groups of client names, of which all begin alike: glued, cut-off and unlike forms of each."""
    k, r = F.lpad(F.floor(F.col("c_custkey") / 4).cast("string"), 9, "0"), F.col("c_custkey") % 4
    name = F.when(r == 0, F.concat(F.lit("Company K"), k, F.lit(" Works, Inc."))).when(r == 1, F.concat(F.lit("CompanyK"), k, F.lit("Works"))).when(r == 2, F.concat(F.lit("company k"), k, F.lit(" wor llc"))).otherwise(F.concat(F.lit("Company other"), k, F.lit(" trading")))
    return fuzzy.greedy_groups(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), name.alias("name")))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line, len(string_split(text, ' ')) AS n_words FROM conversations")
def clean_turns(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("line"), F.size(F.split("text", " ", -1)).cast("long").alias("n_words"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, sf):
    return read(spark, sf, "events").select("event_id", text.json_field(F.col("props"), "$.k").try_cast("long").alias("k"))


@query("SELECT n_nationkey AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def markdown_tables(spark, sf):
    """Pipe tables written and read back."""
    n = read(spark, sf, "nation")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "n_name", F.col("n_regionkey").cast("string")), F.lit(" |"))
    docs = n.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Intro\n| name | region |\n|---|---|\n"), row).alias("text"))
    return text.pipe_tables(docs).select("id", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("region"))


@query("""SELECT r_regionkey AS id, 'Table: ' || r_name || chr(10) || '"name","key"' || chr(10) || '"' || r_name || '","' || r_regionkey || '"' || chr(10) AS csv FROM region""")
def csv_export(spark, sf):
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.array(F.lit("name"), F.lit("key")).alias("header"), F.array(F.array("r_name", F.col("r_regionkey").cast("string"))).alias("rows"))
    return r.select("id", text.quoted_csv(F.col("name"), F.col("header"), F.col("rows")).alias("csv"))


@query("SELECT o_orderkey AS id, c_name || '_' || strftime(o_orderdate, '%Y-%m') || CASE WHEN n > 1 THEN '(' || n || ')' ELSE '' END || '.pdf' AS file_name FROM (SELECT o_orderkey, o_orderdate, c_name, row_number() OVER (PARTITION BY c_name, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey)")
def file_names(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    o = o.select(F.col("o_orderkey").alias("id"), "c_name", month.alias("m")).withColumn("n", F.row_number().over(Window.partitionBy("c_name", "m").orderBy("id")))
    return o.select("id", F.concat("c_name", F.lit("_"), "m", F.when(F.col("n") > 1, F.concat(F.lit("("), F.col("n").cast("string"), F.lit(")"))).otherwise(""), F.lit(".pdf")).alias("file_name"))


# --- events ---------------------------------------------------------------------------------------
@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) > 10 AS rejected FROM events")
def sliding_rate(spark, sf):
    return stream.sliding_rate(read(spark, sf, "events"), 3600, 10).select("event_id", "in_hour", "rejected")


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS tokens FROM events GROUP BY 1, 2")
def tumbling_budget(spark, sf):
    e = read(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("user_id", "hour").agg(F.count("*").alias("n"), dbl(F.sum(F.col("value").cast("decimal(18,4)"))).alias("tokens"))


@query("""WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l) SELECT user_id, session::BIGINT AS session, min(ts) AS first_beat, max(ts) AS last_beat, count(*) AS beats FROM s GROUP BY 1, 2""")
def liveness_sessions(spark, sf):
    return stream.sessions(read(spark, sf, "events"), 6 * 3600)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def replay_last(spark, sf):
    return stream.replay(read(spark, sf, "events"), 50).select("user_id", "event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS stage, count(*) AS progress FROM events GROUP BY 1")
def stage_progress(spark, sf):
    return stream.latest_stage(read(spark, sf, "events"))

