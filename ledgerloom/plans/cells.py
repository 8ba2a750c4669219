"""Cell, name and header rules applied to columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.binding import read
from .catalogue import query
from .statements import NUM_SQL, RAW_SQL, raw_cells

dbl = lambda c: F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def part(spark, sf):
    return read(spark, sf, "part").withColumn("id", F.col("p_partkey"))


def picked(key, forms):
    """One of several columns by a remainder."""
    out = forms[-1]
    for i, f in list(enumerate(forms[:-1]))[::-1]:
        out = F.when(key % len(forms) == i, f).otherwise(out)
    return out


@query("""WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 0 THEN p_name || ' VA00598' WHEN 1 THEN p_name || ' FL0719 and sons' WHEN 2 THEN 'TX9 ' || p_name WHEN 3 THEN p_name || ' PA84' WHEN 4 THEN p_name || ' NY123456' WHEN 5 THEN p_name || ' va00598' ELSE '  ' || p_name || ' ' END AS s FROM part)
  SELECT id, CASE WHEN regexp_matches(trim(s), '\\s+[A-Z]{2}\\d{5}') THEN trim(regexp_replace(trim(s), '\\s+[A-Z]{2}\\d{5}\\s*', ' ', 'g')) WHEN regexp_matches(trim(s), '\\s+[A-Z]{2}\\d{4}') THEN trim(regexp_replace(trim(s), '\\s+[A-Z]{2}\\d{4}\\s*', ' ', 'g'))
    WHEN regexp_matches(trim(s), '\\s+[A-Z]{2}\\d{3}') THEN trim(regexp_replace(trim(s), '\\s+[A-Z]{2}\\d{3}\\s*', ' ', 'g')) WHEN regexp_matches(trim(s), '\\s+[A-Z]{2}\\d{2}') THEN trim(regexp_replace(trim(s), '\\s+[A-Z]{2}\\d{2}\\s*', ' ', 'g'))
    WHEN regexp_matches(trim(s), '\\s+[A-Z]{2}\\d') THEN trim(regexp_replace(trim(s), '\\s+[A-Z]{2}\\d\\s*', ' ', 'g')) ELSE trim(s) END AS client FROM n""")
def clean_clients(spark, sf):
    """Client names without state codes; the longest family of digits that occurs goes."""
    n = F.col("p_name")
    say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    s = picked(F.col("id"), [say(n, " VA00598"), say(n, " FL0719 and sons"), say("TX9 ", n), say(n, " PA84"), say(n, " NY123456"), say(n, " va00598"), say("  ", n, " ")])
    return part(spark, sf).select("id", S.clean_client(s).alias("client"))


HEADER_SQL = """h AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ['Client', 'Commission Rate', 'Commission Earned', 'Paid Amount'] WHEN 1 THEN ['Client', 'commission amount', 'Commission Paid'] WHEN 2 THEN ['Consultant Due', 'Amount_Paid', 'Notes']
  WHEN 3 THEN ['Commissionable Premium', 'Percent', p_brand] ELSE ['Earned this period', 'Total Commission', 'Net Payment'] END AS h FROM part)"""


def headers(spark, sf):
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    forms = [lit("Client", "Commission Rate", "Commission Earned", "Paid Amount"), lit("Client", "commission amount", "Commission Paid"), lit("Consultant Due", "Amount_Paid", "Notes"), F.array(F.lit("Commissionable Premium"), F.lit("Percent"), F.col("p_brand")), lit("Earned this period", "Total Commission", "Net Payment")]
    return part(spark, sf).select("id", picked(F.col("id"), forms).alias("h"))


WEIGHT_SQL = "CASE " + " ".join(f"WHEN contains(lower(x), '{t}') THEN 0" for t in S.NOT_COMMISSION_COLUMNS) + " ".join([""] + [f"WHEN contains(lower(x), '{t}') THEN {w}" for t, w in sorted(S.COMMISSION_COLUMNS.items(), key=lambda y: -y[1])]) + " ELSE 0 END"


@query(f"""WITH {HEADER_SQL}, w AS (SELECT id, list_transform(h, lambda x: {WEIGHT_SQL}) AS w FROM h) SELECT id, CASE WHEN list_max(w) > 0 THEN list_position(w, list_max(w)) - 1 END::INTEGER AS at FROM w""")
def commission_columns(spark, sf):
    """The heaviest commission column, the leftmost of equals; rate and percentage columns are barred."""
    return headers(spark, sf).select("id", S.commission_column(F.col("h")).cast("int").alias("at"))


SIMILAR_SQL = """CASE WHEN lower(trim(x)) NOT IN ('consultant due', 'consultant paid', 'consultant', 'due', 'consultant due this period') AND regexp_matches(regexp_replace(lower(x), '[ _]', '', 'g'), 'commission|due|earned|paid') THEN {hits} ELSE 0 END"""
HIT_SQL = "CASE WHEN contains(regexp_replace(lower(x), '[ _]', '', 'g'), '{}') THEN 1 ELSE 0 END"


def similar_sql(target: str, terms: list[str]) -> str:
    score = SIMILAR_SQL.format(hits=" + ".join(HIT_SQL.format(t) for t in terms))
    return f"""coalesce(CASE WHEN list_contains(h, '{target}') THEN '{target}' END, list_filter(h, lambda x: lower(x) = lower('{target}'))[1], CASE WHEN list_max(list_transform(h, lambda x: {score})) >= 2 THEN h[list_position(list_transform(h, lambda x: {score}), list_max(list_transform(h, lambda x: {score})))] END)"""


@query(f"""WITH {HEADER_SQL} SELECT id, {similar_sql("PAID amount", ["paid", "amount"])} AS paid, {similar_sql("Commission Earned Period", ["period", "commission", "earned"])} AS earned, list_filter(h, lambda x: lower(x) = 'consultant due')[1] AS due FROM h""")
def similar_columns(spark, sf):
    """Headers that stand for a field: equal, equal but for case, or sharing two terms; some fields accept no other."""
    h = F.col("h")
    return headers(spark, sf).select("id", S.similar_column("PAID amount", h).alias("paid"), S.similar_column("Commission Earned Period", h).alias("earned"), S.similar_column("consultant due", h).alias("due"))


@query("""WITH h AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' Group  No.' WHEN 1 THEN 'Client''s Plan (Earned)' WHEN 2 THEN 'Organization: Adj ' ELSE p_name END AS h FROM part), a AS (SELECT id, lower(trim(h)) AS h FROM h),
  b AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '\\bgroup\\b', 'company', 'g'), '\\bclient\\b', 'company', 'g'), '\\borganization\\b', 'company', 'g'), '\\bplan\\b', 'policy', 'g'), '\\bearned\\b', 'commission', 'g'), '\\bpaid\\b', 'payment', 'g'), '\\bno\\b', 'number', 'g'), '\\badj\\b', 'adjustment', 'g') AS h FROM a)
  SELECT id, trim(regexp_replace(regexp_replace(h, '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS header FROM b""")
def canonical_headers(spark, sf):
    h = picked(F.col("id"), [F.lit(" Group  No."), F.lit("Client's Plan (Earned)"), F.lit("Organization: Adj "), F.col("p_name")])
    return part(spark, sf).select("id", S.header_canonical(h).alias("header"))


NAMES_SQL = r"""n AS (SELECT p_partkey AS id, p_name AS a, CASE p_partkey % 6 WHEN 0 THEN p_name || ', Inc.' WHEN 1 THEN replace(p_name, ' ', '') WHEN 2 THEN substr(p_name, 1, length(p_name) - 2) WHEN 3 THEN p_name || ' trading' WHEN 4 THEN reverse(p_name) ELSE upper(p_name) || ' LLC' END AS b FROM part),
  t AS (SELECT id, trim(regexp_replace(regexp_replace(lower(trim(a)), '[,._-]', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(trim(b)), '[,._-]', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM n),
  c AS (SELECT id, CASE WHEN regexp_matches(a, '\S( inc| llc)$') THEN trim(regexp_replace(a, ' (inc|llc)$', '')) ELSE a END AS a, CASE WHEN regexp_matches(b, '\S( inc| llc)$') THEN trim(regexp_replace(b, ' (inc|llc)$', '')) ELSE b END AS b FROM t),
  d AS (SELECT *, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM c),
  e AS (SELECT *, CASE WHEN len(wa) > len(wb) THEN wa ELSE wb END AS wl, CASE WHEN len(wa) > len(wb) THEN wb ELSE wa END AS ws FROM d)"""


@query(f"""WITH {NAMES_SQL} SELECT id, round(CASE WHEN a = b THEN 1.0 WHEN starts_with(l, s) AND length(l) - length(s) <= 3 THEN 0.98 WHEN starts_with(l, s) AND length(l) - length(s) <= 10 AND length(s) >= 10 THEN 0.95
  WHEN starts_with(l, s) AND length(l) - length(s) <= 20 AND length(s) >= 15 AND len(string_split(s, ' ')) = len(string_split(l, ' ')) - 1 THEN 0.9 WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 1.0
  WHEN len(ws) >= 2 AND len(list_filter(range(len(ws)), lambda i: starts_with(wl[i + 1], ws[i + 1]))) = len(ws) THEN 0.92
  ELSE 0.4::DOUBLE * (1 - CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b))) + 0.5::DOUBLE * len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) + 0.1::DOUBLE * CASE WHEN starts_with(l, s) AND length(l) - length(s) <= 4 THEN 0.3 WHEN contains(l, s) THEN 0.2 ELSE 0 END END, 9)::DOUBLE AS similarity FROM e""")
def name_similarities(spark, sf):
    """Similarity of names and their altered forms: suffixes, glued words, cut ends, further words, unlike names."""
    a = F.col("p_name")
    b = picked(F.col("id"), [F.concat(a, F.lit(", Inc.")), F.replace(a, F.lit(" "), F.lit("")), F.substring(a, F.lit(1), F.length(a) - 2), F.concat(a, F.lit(" trading")), F.reverse(a), F.concat(F.upper(a), F.lit(" LLC"))])
    return part(spark, sf).select("id", F.round(S.name_similarity(S.match_name(a), S.match_name(b)), 9).alias("similarity"))


@query("SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(s, '[^\\w\\s-]', '', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '_') AS file, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '_+', ' ', 'g'), '-+', ' ', 'g'), '\\.+', '.', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' & Sons__(x)' WHEN 1 THEN '_' || p_name || '...--' || p_brand ELSE p_brand || ' / ' || p_type END AS s FROM part)")
def cleaned_texts(spark, sf):
    """Names safe for files, and text without runs of filling characters."""
    s = picked(F.col("id"), [F.concat("p_name", F.lit(" & Sons__(x)")), F.concat(F.lit("_"), "p_name", F.lit("...--"), "p_brand"), F.concat("p_brand", F.lit(" / "), "p_type")])
    r = F.regexp_replace
    file = r(r(r(r(s, r"[^\w\s-]", ""), r"\s+", "_"), "_+", "_"), "^_+|_+$", "")
    return part(spark, sf).select("id", file.alias("file"), S.strip(r(r(r(r(s, "_+", " "), "-+", " "), r"\.+", "."), r"\s+", " ")).alias("text"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_brand || '.' || p_type ELSE p_brand END AS header FROM part")
def doubled_headers(spark, sf):
    """Name.Name becomes Name."""
    s = picked(F.col("id"), [F.concat("p_brand", F.lit("."), "p_brand"), F.concat("p_brand", F.lit("."), "p_type"), F.concat("p_brand", F.lit(" . "), "p_brand")])
    two = F.split(s, r"\.", -1)
    return part(spark, sf).select("id", F.when((F.size(two) == 2) & (F.trim(two[0]) == F.trim(two[1])), F.trim(two[0])).otherwise(s).alias("header"))


@query("""WITH p AS (SELECT p_partkey AS id, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part) SELECT id, CASE WHEN a = b THEN 1.0 ELSE len(list_filter(string_split(a, ''), lambda c: contains(b, c)))::DOUBLE / greatest(length(a), length(b)) END AS ab, CASE WHEN a = b THEN 1.0 ELSE len(list_filter(string_split(b, ''), lambda c: contains(a, c)))::DOUBLE / greatest(length(a), length(b)) END AS ba FROM p""")
def common_letters(spark, sf):
    """Share of letters of one text that the other has; the two directions differ."""
    a, b = F.lower(F.trim("p_name")), F.lower(F.trim("p_type"))
    one = lambda x, y: F.when(x == y, 1.0).otherwise(F.size(F.filter(F.split(x, ""), lambda c: (c != "") & y.contains(c))) / F.greatest(F.length(x), F.length(y)))
    return part(spark, sf).select("id", one(a, b).alias("ab"), one(b, a).alias("ba"))


@query("""WITH p AS (SELECT p_partkey AS id, p_brand AS a, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_brand WHEN 1 THEN lower(p_brand) WHEN 2 THEN replace(p_brand, '#', '-#-') WHEN 3 THEN p_brand || ' (new)' ELSE p_type END AS b FROM part)
  SELECT id, trim(a) = trim(b) OR lower(trim(a)) = lower(trim(b)) OR regexp_replace(trim(a), '[^\\w]', '', 'g') = regexp_replace(trim(b), '[^\\w]', '', 'g') OR (length(a) > 3 AND (contains(b, a) OR contains(a, b))) AS same FROM p""")
def equal_values(spark, sf):
    """Values equal but for blanks, case, formatting or a longer form."""
    a = F.col("p_brand")
    b = picked(F.col("id"), [F.concat(F.lit(" "), a), F.lower(a), F.replace(a, F.lit("#"), F.lit("-#-")), F.concat(a, F.lit(" (new)")), F.col("p_type")])
    bare = lambda x: F.regexp_replace(F.trim(x), r"[^\w]", "")
    return part(spark, sf).select("id", ((F.trim(a) == F.trim(b)) | (F.lower(F.trim(a)) == F.lower(F.trim(b))) | (bare(a) == bare(b)) | ((F.length(a) > 3) & (b.contains(a) | a.contains(b)))).alias("same"))


@query("""SELECT c_custkey AS id, CASE WHEN c < 0 THEN '($' ELSE '$' END || CASE WHEN a >= 1000 THEN floor(a / 1000)::BIGINT || ',' || lpad((floor(a)::BIGINT % 1000)::VARCHAR, 3, '0') ELSE floor(a)::BIGINT::VARCHAR END || '.' || lpad((round(a * 100)::BIGINT % 100)::VARCHAR, 2, '0') || CASE WHEN c < 0 THEN ')' ELSE '' END AS dollars,
  round(c / 10)::BIGINT || '%' AS percent FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(15,2)) AS c, abs(CAST(c_acctbal AS DECIMAL(15,2))) AS a FROM customer)""")
def formatted_amounts(spark, sf):
    """Amounts as dollars with separators, negative ones in parentheses; a rounded percentage."""
    c = F.col("c_acctbal").cast("decimal(15,2)")
    dollars = F.concat(F.lit("$"), F.format_number(F.abs(c), 2))
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(c < 0, F.concat(F.lit("("), dollars, F.lit(")"))).otherwise(dollars).alias("dollars"), F.concat(F.round(c / 10).cast("long").cast("string"), F.lit("%")).alias("percent"))


@query(f"""WITH {RAW_SQL}, t AS (SELECT id, trim(replace(replace(c, '$', ''), ',', '')) AS t FROM cells), u AS (SELECT id, t, CASE WHEN t LIKE '(%)' THEN substr(t, 2, length(t) - 2) ELSE t END AS i, trim(replace(replace(t, '(', '-'), ')', '')) AS d FROM t)
  SELECT id, CASE WHEN t LIKE '(%)' THEN -({NUM_SQL.format(t='i')}) ELSE {NUM_SQL.format(t='i')} END AS dollar, {NUM_SQL.format(t='d')} AS textual FROM u""")
def amounts_dollar(spark, sf):
    """Two further parsers: parentheses negate, or become a minus sign by text; null where nothing fits."""
    return raw_cells(spark, sf).select("id", S.amount_dollar(F.col("c")).alias("dollar"), S.amount_textual(F.col("c")).alias("textual"))


@query(f"""WITH {RAW_SQL}, t AS (SELECT id, regexp_replace(trim(c), '[$,]', '', 'g') AS t FROM cells), u AS (SELECT id, CASE WHEN t LIKE '(%)' THEN '-' || regexp_replace(t, '[()]', '', 'g') ELSE t END AS t FROM t), v AS (SELECT id, {NUM_SQL.format(t='t')} AS approval FROM u),
  w AS (SELECT id, regexp_replace(lower(regexp_replace(trim(c), '[$,+\\s]', '', 'g')), 'usd', '', 'g') AS t FROM cells), x AS (SELECT id, t, regexp_replace(t, '^\\(|\\)$', '', 'g') AS i FROM w)
  SELECT v.id, approval, CASE WHEN t IN ('', '-', '--', '—', 'n/a', 'na', 'none') THEN NULL WHEN t LIKE '(_%)' THEN -abs({NUM_SQL.format(t='i')}) ELSE {NUM_SQL.format(t='i')} END AS tolerant FROM v JOIN x ON v.id = x.id""")
def amounts_approval(spark, sf):
    return raw_cells(spark, sf).select("id", S.amount_approval(F.col("c")).alias("approval"), S.amount_tolerant(F.col("c")).alias("tolerant"))


@query("SELECT o_orderkey AS id, abs(a - b) <= greatest(abs(b) * 0.0075::DOUBLE, 0.01::DOUBLE) AS close, b <> 0 AND abs(a - b) / abs(b) * 100 <= 5 AS learned FROM (SELECT o_orderkey, o_totalprice AS b, o_totalprice * (1 + (o_orderkey % 13 - 6) * 0.0025::DOUBLE) AS a FROM orders)")
def within_tolerances(spark, sf):
    b = F.col("o_totalprice")
    a = b * (1 + (F.col("o_orderkey") % 13 - 6) * 0.0025)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.within_bps(a, b).alias("close"), ((b != 0) & (F.abs(a - b) / F.abs(b) * 100 <= 5)).alias("learned"))


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '\\d{1,2}/\\d{1,2}/\\d{2,4}' WHEN 1 THEN '^\\$?\\d{1,3}(,\\d{3})*(\\.\\d{2})?$' WHEN 2 THEN '^\\d+(\\.\\d+)?%$' WHEN 3 THEN '^\\d{3}-\\d{3}-\\d{4}$' WHEN 4 THEN '^\\d{3}-\\d{2}-\\d{4}$' END AS pattern FROM part")
def value_patterns(spark, sf):
    """The pattern a first value suggests for its column."""
    v = picked(F.col("id"), [F.lit("1/15/2025 on"), F.lit("$1,234.50"), F.concat(F.col("p_size").cast("string"), F.lit(".5%")), F.lit("555-010-1234"), F.lit("123-45-6789"), F.col("p_name")])
    return part(spark, sf).select("id", S.value_pattern(v).alias("pattern"))


@query("""WITH s AS (SELECT p_partkey AS id, p_size AS c1, p_partkey % 17 AS c2, p_size % 9 AS r1, p_partkey % 23 AS r2 FROM part), d AS (SELECT id, abs(c1 - c2) AS dc, greatest(c1, c2) AS mc, abs(r1 - r2) AS dr, greatest(r1, r2) AS mr, c1 % 2 = c2 % 2 AS same FROM s)
  SELECT id, round(((CASE WHEN mc > 0 THEN CASE WHEN dc <= 2 THEN 1.0 WHEN dc <= 4 THEN 0.7 ELSE greatest(0, 1 - dc::DOUBLE / mc) END ELSE 0 END) + (CASE WHEN mr > 0 THEN CASE WHEN dr <= 5 THEN 1.0 WHEN dr <= 10 THEN 0.8 ELSE greatest(0, 1 - dr::DOUBLE / mr) END ELSE 0 END) + CASE WHEN same THEN 1.0 ELSE 0.5 END)::DOUBLE / 3, 9) AS score FROM d""")
def structure_similarity(spark, sf):
    """Likeness of two table shapes by columns, rows and header row."""
    one, two = F.col("p_size"), (F.col("id") % 17).cast("int")
    step = lambda a, b, near, far, some: F.when(F.greatest(a, b) > 0, F.when(F.abs(a - b) <= near, 1.0).when(F.abs(a - b) <= far, some).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b)))).otherwise(0.0)
    score = step(one, two, 2, 4, 0.7) + step(F.col("p_size") % 9, (F.col("id") % 23).cast("int"), 5, 10, 0.8) + F.when(one % 2 == two % 2, 1.0).otherwise(0.5)
    return part(spark, sf).select("id", F.round(score / 3, 9).alias("score"))


@query("""WITH n AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || ' LLC' WHEN 1 THEN p_name || ' Inc' WHEN 2 THEN p_name || ' *!' WHEN 3 THEN 'ab' ELSE p_name || ' CO' END AS s FROM part)
  SELECT id, CASE WHEN length(trim(s)) < 3 THEN 0.0 ELSE round(CASE WHEN regexp_matches(upper(s), 'LLC') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN length(s) BETWEEN 3 AND 100 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_full_match(s, '[A-Za-z0-9\\s&.\\-]+') THEN 0.3::DOUBLE ELSE 0 END, 9) END AS confidence FROM n""")
def name_validity(spark, sf):
    """Confidence that a text is a company name; only the suffix in capitals counts, as names are compared in capitals."""
    s = picked(F.col("id"), [F.concat(F.upper("p_name"), F.lit(" LLC")), F.concat("p_name", F.lit(" Inc")), F.concat("p_name", F.lit(" *!")), F.lit("ab"), F.concat("p_name", F.lit(" CO"))])
    score = F.when(F.upper(s).contains("LLC"), 0.4).otherwise(0.0) + F.when(F.length(s).between(3, 100), 0.3).otherwise(0.0) + F.when(s.rlike(r"^[A-Za-z0-9\s&.\-]+$"), 0.3).otherwise(0.0)
    return part(spark, sf).select("id", F.when(F.length(F.trim(s)) < 3, 0.0).otherwise(F.round(score, 9)).alias("confidence"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'File uploaded, ready for processing' WHEN 1 THEN 'Tables extracted, ready for editing (' || o_orderkey % 7 || ' tables)' WHEN 2 THEN 'Tables edited, ready for field mapping (' || o_orderkey % 7 || ' fields mapped)' WHEN 3 THEN 'Field mapping completed, ready for review' ELSE 'At step: paused' END AS summary FROM orders")
def progress_summaries(spark, sf):
    step = picked(F.col("o_orderkey"), [F.lit(x) for x in ("upload", "table_editor", "field_mapper", "dashboard", "paused")])
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.progress_summary(step, F.col("o_orderkey") % 7).alias("summary"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN '2000-01' ELSE strftime(o_orderdate, '%Y-%m') END AS month FROM orders")
def statement_months(spark, sf):
    """The month of a date record: year and month, an ISO date, an ISO value, else that of the clock given."""
    d = F.col("o_orderdate")
    iso = F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")
    j = picked(F.col("o_orderkey"), [F.to_json(F.struct(F.year(d).alias("year"), F.month(d).alias("month"))), F.to_json(F.struct(iso.alias("date"))), F.to_json(F.struct(iso.alias("value"))), F.lit("{}")])
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.month_of_record(j, F.lit("2000-01-31").cast("date")).alias("month"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN day(o_orderdate) > 0 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS valid FROM orders")
def valid_dates(spark, sf):
    """Dates that exist, month or day first, two-digit years included."""
    d = F.col("o_orderdate")
    s = picked(F.col("o_orderkey"), [F.date_format(d, "MM/dd/yyyy"), F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "MM/dd/yy"), F.concat(F.lit("13/32/"), F.year(d).cast("string")), F.lit("02/30/2024"), F.date_format(d, "yyyy-MM-dd")])
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), S.is_date(s).alias("valid"))


@query("SELECT p_partkey AS id, md5(concat_ws('|', 2, p_size, format('{:.2f}', (p_size % 10)::DOUBLE / 4), p_brand, p_type)) AS signature FROM part")
def table_signatures(spark, sf):
    """A table's fingerprint: columns, rows, mean cells a row to two decimals, headers."""
    h = F.array("p_brand", "p_type")
    s = F.concat_ws("|", F.size(h).cast("string"), F.col("p_size").cast("string"), F.format_string("%.2f", dbl(F.col("p_size") % 10) / 4), F.array_join(h, "|"))
    return part(spark, sf).select("id", F.md5(s.cast("binary")).alias("signature"))


# Fixed values of the domain.
COMPANY_PATTERNS = [r"([A-Z][A-Za-z\s&\.]+(?:LLC|Inc|Corp|Co|Corporation|Company|Ltd|Limited))", r"([A-Z]{2,}\s[A-Z][A-Za-z\s]+(?:LLC|Inc|Corp))", r"([A-Z][A-Z\s]+(?:LOGISTICS|DELIVERY|SERVICES|SOLUTIONS))", r"([A-Z][A-Za-z\s&\.]+(?:PROTECTION|HEATING|COOLING))", r"([A-Z][A-Za-z\s&\.]+(?:GROUP|AGENCY|ASSOCIATES))"]
FOUND_SQL = "list_concat(" + ", ".join(f"regexp_extract_all(s, '(?i){p}', 1)" for p in COMPANY_PATTERNS) + ")"


@query(f"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Paid to ' || p_name || ' LLC, 12 Main' WHEN 1 THEN 'XY ' || p_name || ' Logistics; Acme & Sons Inc. 7' WHEN 2 THEN 'the ' || p_name || ' agency 5 heating' ELSE '12 nothing 34' END AS s FROM part)
  SELECT id, array_to_string(list_transform(list_filter({FOUND_SQL}, lambda x: length(trim(x)) > 3), lambda x: trim(x)), '|') AS companies FROM t""")
def company_mentions(spark, sf):
    """Company names found in text by legal and business words, whatever their case."""
    n = F.col("p_name")
    s = picked(F.col("id"), [F.concat(F.lit("Paid to "), n, F.lit(" LLC, 12 Main")), F.concat(F.lit("XY "), n, F.lit(" Logistics; Acme & Sons Inc. 7")), F.concat(F.lit("the "), n, F.lit(" agency 5 heating")), F.lit("12 nothing 34")])
    found = F.concat(*[F.regexp_extract_all(s, F.lit("(?i)" + p), F.lit(1)) for p in COMPANY_PATTERNS])
    return part(spark, sf).select("id", F.array_join(F.transform(F.filter(found, lambda x: F.length(F.trim(x)) > 3), lambda x: S.clean_client(x)), "|").alias("companies"))


@query("SELECT p_partkey AS id, list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), lambda w: length(w))::BIGINT[] AS sizes, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')))) AS jaccard FROM part")
def word_overlap(spark, sf):
    """Words as sets: sizes of the words and their Jaccard share with another column's."""
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return part(spark, sf).select("id", F.transform(F.filter(a, lambda w: w != ""), lambda w: F.length(w).cast("long")).alias("sizes"), (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).alias("jaccard"))
