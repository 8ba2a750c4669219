"""Statements whose columns are found by their field configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields as X
from ..operators import tables
from ..sources.binding import read
from .catalogue import query
from .cells import picked

CONFIGS = [
    [("Group Name", "Client Name", None, None, None), ("Paid Amount", "Commission Earned", None, None, None), ("Invoice Total", "Invoice Total", None, None, None)],
    [(None, None, "Customer", "Notes", None), (None, None, "Commission Earned", "Comm", None), (None, None, "Premium Amount", "Premium Amount", None)],
    [("Company", None, None, None, "company name"), ("earned commission paid", None, None, None, "commission amount")],
    [("Rate", "Notes", None, None, None), ("Total Invoice", "x", None, None, None), ("Employer Group", "", None, None, None), ("Paid", "", None, None, "")],
]
HEADERS = [["Group Name", "Paid Amount", "Invoice Total"], ["Customer", "Commission Earned", "Premium Amount"], ["Company", "Commission Paid", "Earned Commission Paid"], ["Total Invoice", "Employer Group", "Paid"]]

_q = lambda x: "NULL" if x is None else "'" + x + "'"
_configs = "[" + ", ".join("[" + ", ".join("{'s': coalesce(nullif(%s, ''), nullif(%s, ''), nullif(%s, ''), ''), 't': lower(coalesce(nullif(%s, ''), nullif(%s, ''), nullif(%s, ''), ''))}" % tuple(map(_q, (e[0], e[2], e[3], e[1], e[3], e[4]))) for e in c) + "]" for c in CONFIGS) + "]"
_in = lambda words: "(" + ", ".join(_q(w) for w in words) + ")"


def _pick(test: str, words: list[str]) -> str:
    return f"coalesce(list_filter(c, lambda x: x.s <> '' AND ({test}))[1].s, list_filter(c, lambda x: regexp_matches(lower(x.s), '{'|'.join(words)}'))[1].s)"


MAPPED_SQL = f"""u AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, o_custkey % 3 AS v, {_configs}[1 + o_orderkey % 4] AS c FROM orders),
 m AS (SELECT id, k, v, {_pick(f"x.t IN {_in(X.CLIENT_TARGETS)} OR (contains(x.t, 'client') AND contains(x.t, 'name')) OR (contains(x.t, 'company') AND contains(x.t, 'name'))", X.CLIENT_SOURCES)} AS client,
  {_pick(f"x.t IN {_in(X.COMMISSION_TARGETS)} OR (contains(x.t, 'commission') AND (contains(x.t, 'earned') OR contains(x.t, 'amount')))", X.COMMISSION_SOURCES)} AS commission,
  {_pick(f"x.t IN {_in(X.INVOICE_TARGETS)} OR (contains(lower(x.s), 'invoice') AND (contains(lower(x.s), 'amount') OR contains(lower(x.s), 'total'))) OR (contains(x.t, 'invoice') AND contains(x.t, 'total'))", X.INVOICE_SOURCES)} AS invoice FROM u)"""


def uploads(spark, sf):
    """Each order as an upload with one of four configurations and a table of its lines, under one of three spellings of the header."""
    k, v = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    lit = lambda x: F.lit(x).cast("string")
    config = picked(k, [F.array(*[F.struct(*[lit(y).alias(n) for y, n in zip((e[0], e[1], e[2], e[3], e[4]), ("field", "mapping", "source_field", "display_name", "label"))]) for e in c]) for c in CONFIGS])
    header = picked(k, [F.array(*[F.lit(x) for x in h]) for h in HEADERS])
    header = F.when(v == 0, header).when(v == 1, F.transform(header, lambda h: F.concat(F.lit(" "), F.upper(h)))).otherwise(F.reverse(header))
    row = F.array(F.concat(F.lit("Acme MNOO867 "), (F.col("l_partkey") % 9).cast("string")), F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(15,2)").cast("string")), F.concat(F.lit("("), F.col("l_quantity").cast("long").cast("string"), F.lit(")")))
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", row.alias("row")).alias("r"))
    body = lines.groupBy("o_orderkey").agg(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["row"]).alias("rows"))
    o = read(spark, sf, "orders").join(body, "o_orderkey")
    table = F.struct(header.alias("header"), "rows", F.array(F.lit(0)).alias("summaryRows"))
    return o.select(F.col("o_orderkey").alias("upload_id"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("carrier_id"), F.lit(-1).cast("long").alias("company_id"), config.alias("config"), F.array(table).alias("tables"))


@query(f"WITH {MAPPED_SQL} SELECT id, client, commission, invoice FROM m WHERE id IN (SELECT l_orderkey FROM lineitem)")
def field_mappings(spark, sf):
    """The columns that each upload's configuration maps to client, commission and invoice."""
    m = uploads(spark, sf).select(F.col("upload_id").alias("id"), X.field_mapping(F.col("config")).alias("m"))
    return m.select("id", "m.client", "m.commission", "m.invoice")


@query(f"""WITH {MAPPED_SQL}, h AS (SELECT m.*, list_transform(CASE v WHEN 0 THEN b WHEN 1 THEN list_transform(b, lambda x: upper(x)) ELSE list_reverse(b) END, lambda x: trim(x)) AS h FROM (SELECT m.*, {HEADERS}[1 + k] AS b FROM m) AS m),
 s AS (SELECT *, list_transform([client, commission], lambda t: CASE WHEN list_contains(h, t) THEN len(h) + 1 - list_position(list_reverse(h), t) WHEN list_contains(list_transform(h, lambda x: lower(x)), lower(t)) THEN list_position(list_transform(h, lambda x: lower(x)), lower(t))
   ELSE list_position(list_transform(h, lambda x: CASE WHEN regexp_matches(lower(x), 'commission|due|earned|paid') THEN len(list_filter({['consultant', 'due', 'this', 'period', 'commission', 'earned', 'paid', 'amount']}, lambda w: contains(regexp_replace(lower(x), '[ _]', '', 'g'), w) AND contains(regexp_replace(lower(t), '[ _]', '', 'g'), w))) ELSE 0 END),
    greatest(2, list_max(list_transform(h, lambda x: CASE WHEN regexp_matches(lower(x), 'commission|due|earned|paid') THEN len(list_filter({['consultant', 'due', 'this', 'period', 'commission', 'earned', 'paid', 'amount']}, lambda w: contains(regexp_replace(lower(x), '[ _]', '', 'g'), w) AND contains(regexp_replace(lower(t), '[ _]', '', 'g'), w))) ELSE 0 END)))) END) AS pos,
  CASE WHEN list_contains(h, invoice) THEN len(h) + 1 - list_position(list_reverse(h), invoice) END AS c FROM h),
 l AS (SELECT l_orderkey AS id, ['Acme MNOO867 ' || l_partkey % 9, '$' || CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR), '(' || CAST(l_quantity AS BIGINT) || ')'] AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem),
 a AS (SELECT s.id, o_custkey, r[pos[1]] AS name, r[pos[2]] AS b, coalesce(r[c], '') AS c FROM s JOIN l USING (id) JOIN orders ON o_orderkey = s.id WHERE i > 1 AND coalesce(pos[1], 0) > 0 AND coalesce(pos[2], 0) > 0),
 n AS (SELECT id, CASE WHEN o_custkey % 5 > 0 THEN o_custkey ELSE -1 END AS carrier, CASE WHEN starts_with(name, 'Acme MNOO867 ') THEN 'Acme ' || name[14:] ELSE name END AS client_name, list_transform([b, c], lambda x: coalesce(CASE WHEN regexp_matches(x, '^\\(.*\\)$') THEN -TRY_CAST(x[2:-2] AS DOUBLE) ELSE TRY_CAST(ltrim(x, '$') AS DOUBLE) END, 0)) AS v FROM a)
 SELECT id, carrier, client_name, count(*) AS n, round(sum(v[1]), 4) AS commission, round(sum(v[2]), 4) AS invoice FROM n WHERE client_name <> '' AND (v[1] <> 0 OR v[2] <> 0) GROUP BY 1, 2, 3""")
def mapped_statements(spark, sf):
    """Ledger input of every upload through its configuration: columns resolved, names repaired and cleaned, the first row a summary."""
    r = tables.flatten_mapped(uploads(spark, sf))
    g = r.groupBy(F.col("upload_id").alias("id"), F.col("carrier_id").alias("carrier"), "client_name")
    total = lambda c: F.round(F.sum(F.col(c).cast("double")), 4).alias(c)
    return g.agg(F.count("*").alias("n"), total("commission"), total("invoice"))
