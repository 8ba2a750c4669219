"""Tables that go on over pages: their similarity and the stitched result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import boxes as box_matching
from ..operators import formats, stitching
from ..sources.binding import order_lines
from .catalogue import query
from .cells import picked

PAGE_TABLES_SQL = """base AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_partkey % 6 AS v, 1 + l_suppkey % 3 AS m, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS price, l_suppkey::VARCHAR AS s FROM lineitem),
 raw AS (SELECT doc, i, CASE v WHEN 0 THEN ['Client', 'Paid Amount', 'Rate'] WHEN 1 THEN [' client', 'PAID AMOUNT', 'Rate '] WHEN 2 THEN ['Client Name', 'Paid Amt', 'Rate %'] WHEN 3 THEN ['Client Name', 'Paid', 'Amount', 'Rate'] WHEN 4 THEN ['Policy No', 'Effective Date', 'Premium', 'Status', 'Notes'] ELSE ['Total Commission'] END AS header,
  CASE WHEN v < 3 THEN list_resize([['Customer ' || s, '$' || price, '5%']], m, ['Customer ' || s, '$' || price, '5%']) WHEN v = 3 THEN list_resize([['Customer ' || s, '$' || price, price, '5%']], m, ['C' || s, '$' || price]) WHEN v = 4 THEN list_resize([['P' || s, '01/02/2024', '', 'active', 'n/a']], m, ['', '2024-01-02', price, '', '']) ELSE [['$' || price]] END AS rows FROM base),
 marked AS (SELECT *, len(list_filter(header, lambda h: regexp_matches(lower(h), 'group id|client|company|policy|member|subscriber|agent|producer|group name'))) = 0 AND len(rows) = 1 AND len(list_filter(header, lambda h: regexp_matches(lower(h), 'total|commission|amount|paid|invoice|premium'))) >= len(header) * 0.8e0 AS is_total FROM raw),
 wide AS (SELECT *, coalesce(max(CASE WHEN NOT is_total THEN len(header) END) OVER (PARTITION BY doc), 0) AS w, list_transform(header, lambda h: lower(trim(h))) AS h FROM marked),
 pats AS (SELECT *, array_to_string(h, ' ') AS joined, list_transform(range(coalesce(list_max(list_transform(rows[1:3], lambda r: len(r))), 0)), lambda k: list_transform(list_filter(rows[1:3], lambda r: len(r) > k), lambda r: trim(r[k + 1]))) AS cols FROM wide),
 facts AS (SELECT doc, i, is_total, header, rows, h, joined, list_distinct(string_split(joined, ' ')) AS words, len(string_split(joined, ' ')) AS n_words, list_distinct(string_split(joined, '')) AS letters, len(rows) AS n_rows, len(list_filter(rows, lambda r: abs(len(r) - w) <= 1))::DOUBLE / greatest(len(rows), 1) AS fits,
  list_transform(cols, lambda c: {'number': len(list_filter(c, lambda v: regexp_matches(trim(regexp_replace(v, '[,$%]', '', 'g')), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$'))) > 0, 'currency': len(list_filter(c, lambda v: contains(v, '$'))) > 0, 'date': len(list_filter(c, lambda v: regexp_matches(v, '\\d{1,2}/\\d{1,2}/\\d{2,4}|\\d{1,2}-\\d{1,2}-\\d{2,4}|\\d{4}-\\d{1,2}-\\d{1,2}'))) > 0,
   'letter': len(list_filter(c, lambda v: regexp_matches(v, '\\pL'))) > 0, 'length': list_sum(list_transform(c, lambda v: length(v)))::DOUBLE / len(c)}) AS patterns FROM pats)"""

#: Of pairs(doc, i, j, a, b): the five parts and the score.
SIMILARITY_SQL = """near AS (SELECT doc, i, j, a, b, CASE WHEN a.joined = '' OR b.joined = '' THEN 0e0 WHEN a.joined = b.joined THEN 1e0 ELSE len(list_filter(string_split(a.joined, ''), lambda c: contains(b.joined, c)))::DOUBLE / greatest(length(a.joined), length(b.joined)) END AS phrase,
  list_intersect(a.words, b.words) AS common, len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) AS word, len(list_intersect(a.letters, b.letters))::DOUBLE / len(list_distinct(list_concat(a.letters, b.letters))) AS letter, greatest(len(a.h), len(b.h)) AS wide, least(len(a.h), len(b.h)) AS narrow FROM pairs),
 split AS (SELECT *, (len(common) >= 3 AND wide > narrow AND len(list_filter(common, lambda x: len(list_filter(common, lambda y: x <> y AND (contains(a.joined, x || ' ' || y) OR contains(b.joined, x || ' ' || y)))) > 0)) > 0) OR (phrase >= 0.7e0 AND abs(a.n_words - b.n_words) >= 2) OR (wide > narrow AND word * 0.7e0 + letter * 0.3e0 >= 0.6e0) AS splits,
  list_transform(range(wide), lambda k: CASE WHEN coalesce(a.h[k + 1], '') = coalesce(b.h[k + 1], '') THEN 1e0 WHEN coalesce(a.h[k + 1], '') = '' OR coalesce(b.h[k + 1], '') = '' THEN 0e0 ELSE len(list_filter(string_split(a.h[k + 1], ''), lambda c: contains(b.h[k + 1], c)))::DOUBLE / greatest(length(a.h[k + 1]), length(b.h[k + 1])) END) AS each_,
  list_filter(range(least(len(a.patterns), len(b.patterns))), lambda k: (a.patterns[k + 1].number = b.patterns[k + 1].number)::INT + (a.patterns[k + 1].currency = b.patterns[k + 1].currency)::INT + (a.patterns[k + 1].date = b.patterns[k + 1].date)::INT + (a.patterns[k + 1].letter = b.patterns[k + 1].letter)::INT + (abs(a.patterns[k + 1].length - b.patterns[k + 1].length) <= 5)::INT >= 4) AS hits FROM near),
 parts AS (SELECT doc, i, j, CASE WHEN splits THEN phrase * 0.7e0 + word * 0.3e0 ELSE list_sum(each_) / wide END AS header_part, 1e0 - (wide - narrow)::DOUBLE / wide AS columns_part, (a.fits + b.fits) / 2 AS format_part, len(hits)::DOUBLE / least(len(a.patterns), len(b.patterns)) AS pattern_part,
  (2 + (abs(a.n_rows - b.n_rows)::DOUBLE / greatest(a.n_rows, b.n_rows) <= 0.5e0)::INT)::DOUBLE / 3 AS structure_part FROM split),
 scores AS (SELECT *, 0.3e0 * header_part + 0.2e0 * columns_part + 0.25e0 * format_part + 0.15e0 * pattern_part + 0.1e0 * structure_part AS score FROM parts)"""


def page_tables(spark, sf):
    """Each order as a document with a table for each line: headers in several spellings, rows of several widths, some bare totals."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    price, s, v = F.col("l_extendedprice").cast("decimal(15,2)").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_partkey") % 6
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    header = picked(F.col("l_partkey"), [lit("Client", "Paid Amount", "Rate"), lit(" client", "PAID AMOUNT", "Rate "), lit("Client Name", "Paid Amt", "Rate %"), lit("Client Name", "Paid", "Amount", "Rate"), lit("Policy No", "Effective Date", "Premium", "Status", "Notes"), lit("Total Commission")])
    cash, name = F.concat(F.lit("$"), price), F.concat(F.lit("Customer "), s)
    more = (F.col("l_suppkey") % 3).cast("int")
    rows = lambda first, other: F.concat(F.array(first), F.array_repeat(other, more))
    three, four, five = F.array(name, cash, F.lit("5%")), F.array(name, cash, price, F.lit("5%")), F.array(F.concat(F.lit("P"), s), F.lit("01/02/2024"), F.lit(""), F.lit("active"), F.lit("n/a"))
    body = F.when(v < 3, rows(three, three)).when(v == 3, rows(four, F.array(F.concat(F.lit("C"), s), cash))).when(v == 4, rows(five, F.array(F.lit(""), F.lit("2024-01-02"), price, F.lit(""), F.lit("")))).otherwise(F.array(F.array(cash)))
    return order_lines(spark, sf).select(F.col("l_orderkey").alias("upload_id"), (F.row_number().over(w) - 1).cast("long").alias("table_idx"), header.alias("header"), body.alias("rows"))


@query(f"""WITH {PAGE_TABLES_SQL}, n AS (SELECT doc, i, facts AS a, lead(facts) OVER (PARTITION BY doc ORDER BY i) AS b FROM facts), pairs AS (SELECT doc, i, i + 1 AS j, a, b FROM n WHERE b IS NOT NULL), {SIMILARITY_SQL}
 SELECT doc, i, round(header_part, 9) AS header_part, round(columns_part, 9) AS columns_part, round(format_part, 9) AS format_part, round(pattern_part, 9) AS pattern_part, round(structure_part, 9) AS structure_part, round(score, 9) AS score FROM scores""")
def table_similarities(spark, sf):
    """Each table of a document held against the next one: header, columns, row format, value patterns, structure, and their weighted sum."""
    t = stitching.with_summary(page_tables(spark, sf)).select("upload_id", "table_idx", "summary")
    t = t.withColumn("next", F.lead("summary").over(Window.partitionBy("upload_id").orderBy("table_idx"))).where("next is not null")
    t = t.select("upload_id", "table_idx", stitching.similarity_parts(F.col("summary"), F.col("next")).alias("p"))
    return t.select(F.col("upload_id").alias("doc"), F.col("table_idx").alias("i"), *(F.round(f"p.{k}", 9).alias(f"{k}_part") for k in stitching.WEIGHTS), F.round(stitching.weighted(F.col("p")), 9).alias("score"))


@query(f"""WITH RECURSIVE {PAGE_TABLES_SQL}, g AS (SELECT doc, h, min(i) AS place, arg_min(facts, i) AS f FROM facts WHERE NOT is_total GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY place) AS k FROM g),
 pairs AS (SELECT x.doc, x.place AS i, y.place AS j, x.f AS a, y.f AS b FROM k AS x JOIN k AS y ON x.doc = y.doc AND x.place < y.place), {SIMILARITY_SQL},
 near_to AS (SELECT doc, j, list(i) AS near FROM scores WHERE score >= 0.8e0 GROUP BY 1, 2), ordered AS (SELECT k.doc, k.k, k.h, k.place, coalesce(near, []) AS near FROM k LEFT JOIN near_to AS n ON n.doc = k.doc AND n.j = k.place),
 walk AS (SELECT DISTINCT doc, 0::BIGINT AS k, []::BIGINT[] AS leaders, NULL::BIGINT AS place, NULL::BIGINT AS leader FROM ordered
  UNION ALL SELECT o.doc, o.k, CASE WHEN len(list_filter(w.leaders, lambda x: list_contains(o.near, x))) = 0 THEN list_append(w.leaders, o.place) ELSE w.leaders END, o.place, coalesce(list_filter(w.leaders, lambda x: list_contains(o.near, x))[1], o.place) FROM walk AS w JOIN ordered AS o ON o.doc = w.doc AND o.k = w.k + 1),
 placed AS (SELECT f.*, coalesce(o.place, f.i) AS place, coalesce(w.leader, f.i) AS leader, max(len(f.header)) OVER (PARTITION BY f.doc, coalesce(w.leader, f.i), f.is_total) AS width FROM facts AS f LEFT JOIN ordered AS o ON NOT f.is_total AND o.doc = f.doc AND o.h = f.h LEFT JOIN walk AS w ON w.doc = o.doc AND w.place = o.place)
 SELECT doc, leader AS first_table, is_total, array_to_string(arg_min(header, (-len(header), place, i)), '|') AS header, CAST(sum(n_rows) AS BIGINT) AS n_rows, string_agg(i, ',' ORDER BY place, i) AS parts, md5(string_agg(array_to_string(list_transform(rows, lambda r: array_to_string(list_resize(r, width, ''), '|')), ';'), ';' ORDER BY place, i)) AS cells FROM placed GROUP BY doc, leader, is_total""")
def fuzzy_stitched(spark, sf):
    """Tables of a document stitched where they are alike to 0.8, in page order; grand totals stay apart."""
    s = stitching.stitched(page_tables(spark, sf))
    plain = F.transform("rows", lambda r: F.array_join(r, "|"))
    return s.select(F.col("upload_id").alias("doc"), "first_table", "is_total", F.array_join("header", "|").alias("header"), F.size("rows").cast("long").alias("n_rows"), F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"), F.md5(F.array_join(plain, ";").cast("binary")).alias("cells"))


@query()
def best_formats(spark, sf):
    """The format learnt from every tenth order that fits each other order's tables best, by header names and shape, within one of five companies."""
    t = page_tables(spark, sf).select((F.col("upload_id") % 5).alias("company_id"), "upload_id", "table_idx", "header", F.size("header").alias("n_columns"), F.size("rows").alias("n_rows"), (F.col("upload_id") % 3 > 0).alias("has_header"))
    known = t.where("upload_id % 10 < 2").groupBy("company_id", "header", "n_columns", "n_rows", "has_header").agg(F.min(F.col("upload_id") * 100 + F.col("table_idx")).alias("format_id"), F.max("upload_id").alias("last_used"))
    b = formats.best_formats(t.where("upload_id % 10 >= 2"), known)
    return b.select(F.col("upload_id").alias("doc"), F.col("table_idx").alias("i"), "format_id", F.round("score", 9).alias("score"))


BOXES_SQL = """n AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS id, l_partkey AS a, l_suppkey AS b FROM lineitem),
 truth AS (SELECT doc, id, (a % 4 * 20)::DOUBLE AS x1, (id % 3 * 12)::DOUBLE AS y1, (a % 4 * 20 + 30 + a % 7)::DOUBLE AS x2, (id % 3 * 12 + 20)::DOUBLE AS y2 FROM n),
 found AS (SELECT doc, id * 2 + k AS id, x1 + (b + k * 5) % 9 - 4 AS x1, y1 + b % 5 - 2 AS y1, x2 + (b + k * 3) % 7 - 3 AS x2, y2 + b % 4 - 2 AS y2 FROM (SELECT t.*, n.b FROM truth AS t JOIN n USING (doc, id)), (SELECT unnest([0, 1]) AS k) WHERE b % 6 > 0 OR k = 1)"""


def boxes(spark, sf):
    """Each order as a page: a box for each line, many of them over others, and one or two detections of each that are a little off."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    n = order_lines(spark, sf).select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).cast("long").alias("id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    x, y = F.col("a") % 4 * 20, F.col("id") % 3 * 12
    n = n.select("doc", "id", "b", x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 30 + F.col("a") % 7).cast("double").alias("x2"), (y + 20).cast("double").alias("y2"))
    d = n.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where("b % 6 > 0 or k = 1")
    b, k = F.col("b"), F.col("k")
    d = d.select("doc", (F.col("id") * 2 + k).alias("id"), (F.col("x1") + (b + k * 5) % 9 - 4).alias("x1"), (F.col("y1") + b % 5 - 2).alias("y1"), (F.col("x2") + (b + k * 3) % 7 - 3).alias("x2"), (F.col("y2") + b % 4 - 2).alias("y2"))
    return d, n.drop("b")


@query(f"""WITH RECURSIVE {BOXES_SQL}, o AS (SELECT f.doc, f.id AS p, t.id AS t, greatest(least(f.x2, t.x2) - greatest(f.x1, t.x1), 0) * greatest(least(f.y2, t.y2) - greatest(f.y1, t.y1), 0) AS i, (f.x2 - f.x1) * (f.y2 - f.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS s FROM found AS f JOIN truth AS t ON t.doc = f.doc),
 e AS (SELECT doc, p, t, i / (s - i) AS iou, row_number() OVER (PARTITION BY doc ORDER BY i / (s - i) DESC, p, t) AS k FROM o WHERE i / (s - i) >= 0.5e0),
 g AS (SELECT DISTINCT doc, 0::BIGINT AS k, []::BIGINT[] AS ps, []::BIGINT[] AS ts, NULL::BIGINT AS p, NULL::BIGINT AS t, 0e0 AS iou, false AS taken FROM e
  UNION ALL SELECT e.doc, e.k, CASE WHEN list_contains(g.ps, e.p) OR list_contains(g.ts, e.t) THEN g.ps ELSE list_append(g.ps, e.p) END, CASE WHEN list_contains(g.ps, e.p) OR list_contains(g.ts, e.t) THEN g.ts ELSE list_append(g.ts, e.t) END, e.p, e.t, e.iou, NOT (list_contains(g.ps, e.p) OR list_contains(g.ts, e.t)) FROM g JOIN e ON e.doc = g.doc AND e.k = g.k + 1)
 SELECT doc, p, t, round(iou, 9) AS iou FROM g WHERE taken""")
def matched_boxes(spark, sf):
    """Detected boxes of each page matched one to one with its true ones, the largest overlap first, none under a half."""
    return box_matching.matched(*boxes(spark, sf)).select("doc", "p", "t", F.round("iou", 9).alias("iou"))
