"""Cells of several values, taken apart and held against the columns they may belong to."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import composites
from ..sources.binding import read
from .catalogue import query

REFERENCES = ["L221372", "01/02/2024", "$1,234.50", "25%", "17", "3.5", "ACME INC", "small red box", ""]

CELLS_SQL = f"""c AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'L' || p_partkey || ' $' || CAST(CAST(p_retailprice AS DECIMAL(15,2)) AS VARCHAR) || ' ' || p_size || '% ' || p_name WHEN 1 THEN p_brand || ' 1/' || (1 + p_size % 28) || '/2024 ' || p_name || ' of a long kind.' || ' (' || p_size || ') 1 20' || p_size
  WHEN 2 THEN 'SKU-' || p_partkey || 'B, SKU-' || p_partkey || 'B and ' || p_type WHEN 3 THEN '  ' ELSE p_size || ' ' || p_type || ' 5 1' || p_size || ' 2024-01-05 x' END AS cell FROM part),
 k1 AS (SELECT id, trim(cell) AS t, regexp_extract_all(trim(cell), '[A-Z]+[-]?[A-Z]*\\d+[A-Z\\d]*') AS f1 FROM c),
 k2 AS (SELECT id, f1, list_reduce(f1, lambda a, x: replace(a, x, ' '), t) AS t FROM k1), k3 AS (SELECT id, f1, t, regexp_extract_all(t, '[\\$£€¥]?[\\(]?[\\d,]+\\.?\\d*[\\)]?[%]?') AS f2 FROM k2),
 k4 AS (SELECT id, f1, f2, list_reduce(f2, lambda a, x: replace(a, x, ' '), t) AS t FROM k3), k5 AS (SELECT id, f1, f2, t, regexp_extract_all(t, '\\d{{1,4}}[/\\-\\.]\\d{{1,4}}[/\\-\\.]\\d{{2,4}}') AS f3 FROM k4),
 k6 AS (SELECT id, f1, f2, f3, list_reduce(f3, lambda a, x: replace(a, x, ' '), t) AS t FROM k5), k7 AS (SELECT id, f1, f2, f3, t, regexp_extract_all(t, '\\b(\\d+)\\b(?:[^/\\-.]|$)', 1) AS f4 FROM k6),
 k8 AS (SELECT id, f1, f2, f3, f4, list_filter(regexp_split_to_array(list_reduce(f4, lambda a, x: regexp_replace(a, '(?s)^(.*?)' || x, '\\1 '), t), '\\s+'), lambda p: length(p) > 1) AS p FROM k7),
 k9 AS (SELECT id, f1, f2, f3, f4, list_filter(list_reduce(p, lambda a, x: CASE WHEN length(trim(a[-1] || ' ' || x)) > 25 OR ends_with(x, '.') THEN list_concat(a[:-2], [trim(a[-1] || ' ' || x), '']) ELSE list_append(a[:-2], trim(a[-1] || ' ' || x)) END, ['']), lambda x: x <> '') AS f5 FROM k8),
 parts AS (SELECT id, list_concat(list_transform(f1, lambda v: {{'value': v, 'kind': 'alphanumeric_code'}}), list_transform(f2, lambda v: {{'value': v, 'kind': 'formatted_number'}}), list_transform(f3, lambda v: {{'value': v, 'kind': 'date_pattern'}}), list_transform(f4, lambda v: {{'value': v, 'kind': 'pure_number'}}), list_transform(f5, lambda v: {{'value': v, 'kind': 'text_phrase'}})) AS parts FROM k9)"""


def cells(spark, sf):
    """A cell of several values for each part."""
    k, size, name, kind = F.col("p_partkey"), F.col("p_size").cast("string"), F.col("p_name"), F.col("p_type")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    part, price = k.cast("string"), F.col("p_retailprice").cast("decimal(15,2)").cast("string")
    day = (F.col("p_size") % 28 + 1).cast("string")
    cell = (
        F.when(k % 5 == 0, say("L", part, " $", price, " ", size, "% ", name)).when(k % 5 == 1, say(F.col("p_brand"), " 1/", day, "/2024 ", name, " of a long kind.", " (", size, ") 1 20", size))
        .when(k % 5 == 2, say("SKU-", part, "B, SKU-", part, "B and ", kind)).when(k % 5 == 3, F.lit("  ")).otherwise(say(size, " ", kind, " 5 1", size, " 2024-01-05 x"))
    )
    parts = read(spark, sf, "part").select("p_partkey", "p_size", "p_name", "p_type", "p_brand", "p_retailprice")
    return parts.repartition("p_partkey").select(k.alias("id"), cell.alias("cell"))  # the file is small, the work on its rows is not


@query(f"WITH {CELLS_SQL} SELECT id, unnest(range(len(parts))) AS place, unnest(parts).value AS value, unnest(parts).kind AS kind FROM parts")
def cell_components(spark, sf):
    """The values inside each cell, in the order they are found."""
    c = cells(spark, sf).select("id", F.posexplode(composites.components(F.col("cell"))).alias("place", "c"))
    return c.select("id", F.col("place").cast("long").alias("place"), "c.value", "c.kind")


@query(f"""WITH {CELLS_SQL}, v AS (SELECT id, place, value FROM (SELECT id, unnest(range(len(parts))) AS place, unnest(parts).value AS value FROM parts)), r AS (SELECT unnest({REFERENCES}) AS ref, unnest(range({len(REFERENCES)})) AS k),
 p AS (SELECT *, CASE WHEN regexp_matches(ref, '^\\d+$') THEN 'pure_integer' WHEN regexp_matches(ref, '^\\d+\\.\\d+$') THEN 'decimal_number' END AS number, CASE WHEN regexp_matches(ref, '[A-Z]+\\d+') THEN 'code' WHEN regexp_matches(ref, '\\d+[/\\-]\\d+[/\\-]\\d+') THEN 'date' WHEN regexp_matches(ref, '[$£€¥]') AND regexp_matches(ref, '\\d') THEN 'currency' WHEN contains(ref, '%') AND regexp_matches(ref, '\\d') THEN 'percentage' END AS kind FROM r),
 s AS (SELECT id, place, k, CASE WHEN trim(value) = '' THEN CASE WHEN trim(ref) = '' THEN 1e0 ELSE 0e0 END WHEN trim(ref) = '' THEN 0e0 ELSE least(1e0, CASE WHEN (kind = 'code' AND regexp_matches(value, '[A-Z]+\\d+')) OR (kind = 'date' AND regexp_matches(value, '\\d+[/\\-]\\d+[/\\-]\\d+')) OR (kind = 'currency' AND (regexp_matches(value, '[$£€]') OR (contains(value, '(') AND contains(value, ')'))))
   OR (kind = 'percentage' AND contains(value, '%')) OR (number = 'pure_integer' AND regexp_matches(value, '^\\d+$')) OR (number = 'decimal_number' AND regexp_matches(value, '^\\d+\\.\\d+$')) THEN 0.8e0 ELSE 0e0 END + CASE WHEN regexp_matches(ref, '\\d') AND regexp_matches(value, '\\d') THEN 0.3e0 ELSE 0e0 END + CASE WHEN regexp_matches(ref, '[A-Za-z]') AND regexp_matches(value, '[A-Za-z]') THEN 0.3e0 ELSE 0e0 END
   + greatest(0e0, 1 - abs(length(value) - length(ref))::DOUBLE / greatest(length(value), length(ref))) * 0.2e0) END AS fit FROM v, p)
 SELECT id, place, arg_max(k, (round(fit, 9), -k)) AS column_no, max(round(fit, 9)) AS fit FROM s GROUP BY 1, 2""")
def component_columns(spark, sf):
    """The column each value of a cell fits best, by the columns' reference values; the first of equals."""
    c = cells(spark, sf).select("id", F.posexplode(composites.components(F.col("cell"))).alias("place", "c"))
    fits = F.array(*[F.struct(F.round(composites.column_fit(F.col("c.value"), F.lit(x)), 9).alias("fit"), F.lit(-k).alias("k")) for k, x in enumerate(REFERENCES)])
    best = c.select("id", F.col("place").cast("long").alias("place"), F.array_max(fits).alias("b"))
    return best.select("id", "place", (-F.col("b.k")).cast("long").alias("column_no"), F.col("b.fit").alias("fit"))
