"""Dates found in whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_dates as T
from ..sources.binding import read
from .catalogue import query

#: A line that is put into each text, with {d} for a day from 01 to 31.
DATED_LINES = [
    "Statement Date: 01/{d}/2024 and paid 02-{d}-2024", "For period ending March {d}, 2024; due date 3/9/24", "Policy 2024-02-{d} code", "ref 13/{d}/2023 {d}/12/2023 12-{d}-95", "Payment Date 1/2/51, 2024-13-01 1/{d}/49",
    "billing Jan {d} 2023 or Jan. 8, 2023", "x01/{d}/20245 January{d}2024 Feb3,2023", "amount $12 04/{d}/2022", "{d} December 2023 StatementDate1/2/2024 Payment", "Effective date 06/07/2021 06/07/2021 then invoiced 11/{d}/2021",
]

_labels = ", ".join(f"{{'label': '{x}', 'date_type': '{t}'}}" for x, t in T.LABELS)
_months = "[" + ", ".join(f"'{m[:3].lower()}'" for m in T.MONTHS) + "]"
_day = "CASE WHEN {m} BETWEEN 1 AND 12 AND {y} >= 1 AND {d} >= 1 THEN {d} <= day(last_day(make_date(CASE WHEN {y} >= 1 THEN {y} ELSE 2000 END, CASE WHEN {m} BETWEEN 1 AND 12 THEN {m} ELSE 1 END, 1))) ELSE false END"

DATES_SQL = f"""t AS (SELECT doc_id, list_concat(string_split(coalesce(text, ''), chr(10))[1:doc_id % 4], [replace({DATED_LINES}[1 + doc_id % 10], '{{d}}', lpad((1 + doc_id % 31)::VARCHAR, 2, '0'))], string_split(coalesce(text, ''), chr(10))[doc_id % 4 + 1:]) AS lines FROM documents),
 l AS (SELECT doc_id, i - 1 AS line, trim(lines[i]) AS said, array_to_string(lines[greatest(i - 2, 1):i + 2], ' ') AS context FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)),
 m AS (SELECT doc_id, line, said, context, {" || ".join(f"regexp_extract_all(said, '(?i){p}')" for p in T.DATE_PATTERNS)} AS every FROM l WHERE regexp_matches(said, '\\d')),
 p AS (SELECT doc_id, line, said, context, unnest(range(len(every))) AS place, unnest(every) AS v FROM m),
 n AS (SELECT *, string_split(v, CASE WHEN contains(v, '/') THEN '/' ELSE '-' END) AS n, regexp_split_to_array(replace(v, ',', ''), '\\s+') AS w, coalesce(list_position({_months}, lower(v[1:3])), 0) AS mo, TRY_CAST(regexp_extract(v, '^[A-Za-z]+\\.?(\\d{{1,2}}),?(\\d{{4}})$', 1) AS INT) AS gd, TRY_CAST(regexp_extract(v, '^[A-Za-z]+\\.?(\\d{{1,2}}),?(\\d{{4}})$', 2) AS INT) AS gy FROM p),
 k AS (SELECT *, coalesce(TRY_CAST(n[1] AS INT), 0) AS a, coalesce(TRY_CAST(n[2] AS INT), 0) AS b, coalesce(TRY_CAST(n[3] AS INT), 0) AS c, coalesce(TRY_CAST(w[2] AS INT), 0) AS wd, coalesce(TRY_CAST(w[3] AS INT), 0) AS wy FROM n),
 o AS (SELECT *, CASE WHEN regexp_matches(v, '^{T.M}[/-]{T.D}[/-]{T.Y}\\b') THEN len(n) = 3 AND {_day.format(y="c", m="a", d="b")} WHEN regexp_matches(v, '^{T.M}[/-]{T.D}[/-]\\d{{2}}\\b') THEN len(n) = 3 AND {_day.format(y="(c + CASE WHEN c < 50 THEN 2000 ELSE 1900 END)", m="a", d="b")}
  WHEN regexp_matches(v, '^{T.Y}-{T.M}-{T.D}\\b') THEN {_day.format(y="a", m="b", d="c")} WHEN regexp_matches(v, '(?i)^({T.NAMES}|{T.SHORT})\\s+\\d{{1,2}},?\\s+{T.Y}\\b') THEN {_day.format(y="wy", m="mo", d="wd")}
  WHEN regexp_matches(v, '^{T.D}[/-]{T.M}[/-]{T.Y}\\b') THEN len(n) = 3 AND {_day.format(y="c", m="b", d="a")} WHEN regexp_matches(v, '(?i)^({T.NAMES}|{T.SHORT}\\.?)\\d{{1,2}},?\\d{{4}}') THEN coalesce({_day.format(y="gy", m="mo", d="gd")}, false) ELSE false END AS valid FROM k),
 f AS (SELECT * FROM o WHERE valid AND (regexp_matches(lower(context), '{"|".join(T.PERMISSIVE)}') OR NOT ((regexp_matches(lower(context), '{"|".join(T.IDENTIFIERS)}') AND regexp_matches(v, '\\d{{4,}}')) OR regexp_matches(context, '\\$.*\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}')))),
 g AS (SELECT *, list_filter([{_labels}], lambda x: contains(lower(said), x.label))[1] AS here, list_filter([{_labels}], lambda x: contains(lower(context), x.label))[1] AS there FROM f),
 h AS (SELECT doc_id, line, place, v, CASE WHEN here IS NOT NULL THEN here.label WHEN there IS NOT NULL THEN there.label WHEN contains(lower(context), 'commission') THEN 'commission date' ELSE 'date' END AS label,
  CASE WHEN here IS NOT NULL THEN greatest(0.8e0, 1e0 - abs(strpos(lower(said), lower(v)) - strpos(lower(said), here.label)) / 100e0) WHEN there IS NOT NULL THEN 0.6e0 WHEN contains(lower(context), 'commission') THEN 0.5e0 ELSE 0.3e0 END AS confidence,
  CASE WHEN here IS NOT NULL THEN here.date_type WHEN there IS NOT NULL THEN there.date_type ELSE 'statement_date' END AS date_type FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY confidence DESC, CASE date_type WHEN 'statement_date' THEN 1 WHEN 'payment_date' THEN 2 WHEN 'billing_date' THEN 3 WHEN 'effective_date' THEN 4 WHEN 'report_date' THEN 5 ELSE 99 END, line, place) AS k FROM h)"""


def dated_texts(spark, sf):
    """Every document with a dated line put in among its first ones."""
    line = F.element_at(F.array(*[F.lit(x) for x in DATED_LINES]), (F.col("doc_id") % 10 + 1).cast("int"))
    line = F.replace(line, F.lit("{d}"), F.lpad((F.col("doc_id") % 31 + 1).cast("string"), 2, "0"))
    lines, k = F.split(F.coalesce("text", F.lit("")), "\n"), (F.col("doc_id") % 4).cast("int")
    return read(spark, sf, "documents").select("doc_id", F.array_join(F.concat(F.slice(lines, F.lit(1), k), F.array(line), F.slice(lines, k + 1, F.size(lines))), "\n").alias("text"))


@query(f"WITH {DATES_SQL} SELECT doc_id, v AS date_value, label, round(confidence, 9) AS confidence, date_type, line FROM r WHERE k = 1")
def dates_in_texts(spark, sf):
    """Dates in whole texts with their labels: eighteen patterns, calendar and context checks, seven families of labels."""
    d = T.found_dates(dated_texts(spark, sf), "doc_id", "text")
    return d.select("doc_id", "date_value", "label", F.round("confidence", 9).alias("confidence"), "date_type", F.col("line").cast("long").alias("line"))
