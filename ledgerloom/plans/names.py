"""Company names over the whole table: their normal form, and groups without blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fuzzy
from ..sources.binding import read
from .catalogue import query

WORDS = ["Alco", "Borden", "Cinder", "Delmar", "Easton", "Falcon", "Garnet"]
TRADES = ["logistics", "trucking", "storage", "couriers", "systems"]

COMPANIES_SQL = f"""b AS (SELECT c_custkey AS id, c_custkey % 5 AS r, {WORDS}[1 + (c_custkey // 5) % 7] AS w, {TRADES}[1 + (c_custkey // 35) % 5] AS t, 'k' || (c_custkey // 175) % 1000 AS k FROM customer),
 c AS (SELECT id, CASE r WHEN 0 THEN w || ' ' || t || ' ' || k || ', Inc.' WHEN 1 THEN 'The ' || upper(w) || '-' || t || '   ' || k || ' LLC' WHEN 2 THEN w || t || ' & Sons ' || k WHEN 3 THEN w || ' ' || left(t, 4) || ' ' || k || ' incorporated' ELSE k || '+' || w || 'corp' END AS name FROM b)"""

NORMAL_SQL = f"""s1 AS (SELECT id, name, replace(replace(regexp_replace(regexp_replace(trim(name), '\\s+', ' ', 'g'), '[,._-]', ' ', 'g'), '&', ' and '), '+', ' and ') AS t FROM c),
 s2 AS (SELECT id, name, trim(lower(list_reduce({S.BUSINESS_WORDS}, lambda a, w: CASE WHEN regexp_matches(lower(t), '[a-z0-9]' || w) THEN regexp_replace(a, '(?is)^(.*?)([a-zA-Z0-9]+)(' || w || ')([a-zA-Z]*)', '\\1\\2 ' || w || ' \\4') ELSE a END, t))) AS m FROM s1),
 s3 AS (SELECT id, name, m, coalesce(list_filter({sorted(S.CANONICAL_SUFFIXES, key=lambda x: (-len(x), x))}, lambda x: ends_with(m, x) AND length(m) > length(x) AND m[length(m) - length(x)] <> ' ')[1], '') AS g FROM s2),
 s4 AS (SELECT id, name, g, CASE WHEN g <> '' THEN left(m, length(m) - length(g)) ELSE trim(regexp_replace(m, ' +', ' ', 'g')) END AS r FROM s3),
 s5 AS (SELECT id, name, g, r, CASE WHEN g = '' THEN coalesce(list_filter({sorted(S.CANONICAL_SUFFIXES, key=lambda x: (-len(x), x))}, lambda x: r = x OR ends_with(r, ' ' || x))[1], '') ELSE '' END AS e FROM s4),
 s6 AS (SELECT id, name, g || e AS x, list_filter(string_split(left(r, length(r) - length(e)), ' '), lambda p: p <> '' AND p NOT IN ({", ".join(f"'{w}'" for w in S.SMALL_WORDS)})) AS p FROM s5),
 normal AS (SELECT id, name, trim(array_to_string(list_transform(p, lambda z: CASE WHEN regexp_matches(z, '^[0-9]+[a-zA-Z]+$|^[a-zA-Z][0-9]+$') THEN upper(z) ELSE upper(z[1]) || z[2:] END), ' ') || ' ' || coalesce(MAP {S.CANONICAL_SUFFIXES}[x], '')) AS normal FROM s6)"""

CORES_SQL = f"""k1 AS (SELECT id, name, trim(regexp_replace(regexp_replace(lower(trim(name)), '[,._-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM c),
 k2 AS (SELECT id, t, coalesce(list_filter({sorted(S.NAME_SUFFIXES, key=lambda x: (-len(x), x))}, lambda x: ends_with(t, x) AND length(t) > length(x) AND (t[length(t) - length(x)] <> ' ' OR length(t) > length(x) + 1))[1], '') AS x FROM k1), cores AS (SELECT id, trim(left(t, length(t) - length(x))) AS core FROM k2)"""


def companies(spark, sf):
    """A company name for each customer: some trades and words in several spellings, glued, cut off, with legal suffixes."""
    k = F.col("c_custkey")
    of = lambda values, step: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / step) % len(values) + 1).cast("int"))
    w, t, n, r = of(WORDS, 5), of(TRADES, 35), F.concat(F.lit("k"), (F.floor(k / 175) % 1000).cast("string")), k % 5
    name = (
        F.when(r == 0, F.concat(w, F.lit(" "), t, F.lit(" "), n, F.lit(", Inc."))).when(r == 1, F.concat(F.lit("The "), F.upper(w), F.lit("-"), t, F.lit("   "), n, F.lit(" LLC")))
        .when(r == 2, F.concat(w, t, F.lit(" & Sons "), n)).when(r == 3, F.concat(w, F.lit(" "), F.left(t, F.lit(4)), F.lit(" "), n, F.lit(" incorporated"))).otherwise(F.concat(n, F.lit("+"), w, F.lit("corp")))
    )
    return read(spark, sf, "customer").select(k.alias("id"), name.alias("name")).repartition("id")


@query(f"WITH {COMPANIES_SQL}, {NORMAL_SQL} SELECT id, normal FROM normal")
def normal_names(spark, sf):
    """The normal form of every company name."""
    return companies(spark, sf).select("id", S.company_name(F.col("name")).alias("normal"))


@query(f"""WITH RECURSIVE {COMPANIES_SQL}, {NORMAL_SQL}, {CORES_SQL}, n AS MATERIALIZED (SELECT id, normal, lower(normal) AS norm, core, string_split(core, ' ') AS w, row_number() OVER (ORDER BY id) AS k FROM normal JOIN cores USING (id)),
 d AS (SELECT DISTINCT core, w FROM n), p AS (SELECT x.core AS a, y.core AS b, x.w AS u, y.w AS v, CASE WHEN length(x.core) > length(y.core) THEN x.core ELSE y.core END AS l, CASE WHEN length(x.core) > length(y.core) THEN y.core ELSE x.core END AS s, CASE WHEN len(x.w) > len(y.w) THEN x.w ELSE y.w END AS wl, CASE WHEN len(x.w) > len(y.w) THEN y.w ELSE x.w END AS ws FROM d AS x, d AS y),
 q AS MATERIALIZED (SELECT a, b FROM p WHERE a = b OR (starts_with(l, s) AND (length(l) - length(s) <= 3 OR (length(l) - length(s) <= 10 AND length(s) >= 10) OR (length(l) - length(s) <= 20 AND length(s) >= 15 AND len(ws) = len(wl) - 1))) OR replace(a, ' ', '') = replace(b, ' ', '') OR (len(ws) >= 2 AND len(list_filter(range(len(ws)), lambda i: starts_with(wl[i + 1], ws[i + 1]))) = len(ws))
  OR 0.4e0 * (1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b))) + 0.5e0 * len(list_intersect(u, v)) / len(list_distinct(list_concat(u, v))) + 0.1e0 * CASE WHEN starts_with(l, s) AND length(l) - length(s) <= 4 THEN 0.3e0 WHEN contains(l, s) THEN 0.2e0 ELSE 0 END >= 0.75e0),
 e AS MATERIALIZED (SELECT y.id, list(DISTINCT x.id) AS near FROM n AS y JOIN q ON q.b = y.core JOIN n AS x ON x.core = q.a WHERE x.id < y.id GROUP BY 1),
 f AS MATERIALIZED (SELECT y.id, list(x.id) AS near FROM n AS y JOIN n AS x ON x.norm = y.norm AND x.id < y.id GROUP BY 1),
 o AS MATERIALIZED (SELECT n.id, n.k, list_concat(coalesce(e.near, []), coalesce(f.near, [])) AS near FROM n LEFT JOIN e USING (id) LEFT JOIN f USING (id)),
 g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS leaders, NULL::BIGINT AS id, NULL::BIGINT AS leader UNION ALL SELECT o.k, CASE WHEN h.l IS NULL THEN list_append(h.leaders, o.id) ELSE h.leaders END, o.id, coalesce(h.l, o.id) FROM (SELECT g.k, g.leaders, list_filter(g.leaders, lambda x: list_contains(z.near, x))[1] AS l FROM g JOIN o AS z ON z.k = g.k + 1) AS h JOIN o ON o.k = h.k + 1)
 SELECT g.id, leader, arg_min(normal, (-length(normal), g.id)) OVER (PARTITION BY leader) AS canonical, count(*) OVER (PARTITION BY leader) AS size FROM g JOIN n ON n.id = g.id""")
def company_groups(spark, sf):
    """All company names grouped greedily at 0.75 in the order of their ids, without blocks, each group under its longest normal form."""
    return fuzzy.company_groups(companies(spark, sf)).select("id", "leader", "canonical", "size")


CODES = ["MNOO867", "LAO48", "MD005OO", "MN0O867", "MN0O67", "TX12345", "NYO1", "VA00598 OHOO12"]

CODES_SQL = f"""c AS (SELECT p_partkey AS id, p_name || ' ' || {CODES}[1 + p_partkey % 8] || CASE WHEN p_size % 3 = 0 THEN ' LLC' ELSE '' END AS x FROM part),
 f1 AS (SELECT id, regexp_extract(x, '([A-Z]{{2}})O+(\\d+)') AS seen, regexp_replace(x, '([A-Z]{{2}})O+(\\d+)', regexp_extract(x, '([A-Z]{{2}})O+(\\d+)', 1) || repeat('0', greatest(5 - length(regexp_extract(x, '([A-Z]{{2}})O+(\\d+)', 2)), 0)::INT) || regexp_extract(x, '([A-Z]{{2}})O+(\\d+)', 2), 'g') AS x FROM c),
 f2 AS (SELECT id, seen, CASE WHEN length(regexp_extract(x, '([A-Z]{{2}}\\d+)O+', 1)) BETWEEN 1 AND 6 THEN regexp_replace(x, '([A-Z]{{2}}\\d+)O+', rpad(regexp_extract(x, '([A-Z]{{2}}\\d+)O+', 1), 7, '0'), 'g') ELSE x END AS x FROM f1),
 f3 AS (SELECT id, CASE WHEN regexp_extract(x, '([A-Z]{{2}})[0O]+(\\d+)') NOT IN ('', seen) THEN regexp_replace(x, '([A-Z]{{2}})[0O]+(\\d+)', regexp_extract(x, '([A-Z]{{2}})[0O]+(\\d+)', 1) || repeat('0', greatest(5 - length(regexp_extract(x, '([A-Z]{{2}})[0O]+(\\d+)', 2)), 0)::INT) || regexp_extract(x, '([A-Z]{{2}})[0O]+(\\d+)', 2), 'g') ELSE x END AS x FROM f2),
 f4 AS (SELECT id, regexp_replace(x, '([A-Z]{{2}}\\d)O(\\d+)', regexp_extract(x, '([A-Z]{{2}}\\d)O(\\d+)', 1) || '0' || regexp_extract(x, '([A-Z]{{2}}\\d)O(\\d+)', 2), 'g') AS x FROM f3)"""


@query(f"""WITH {CODES_SQL} SELECT id, x AS repaired, CASE WHEN regexp_matches(x, '\\s+[A-Z]{{2}}\\d{{5}}') THEN trim(regexp_replace(x, '\\s+[A-Z]{{2}}\\d{{5}}\\s*', ' ', 'g')) WHEN regexp_matches(x, '\\s+[A-Z]{{2}}\\d{{4}}') THEN trim(regexp_replace(x, '\\s+[A-Z]{{2}}\\d{{4}}\\s*', ' ', 'g'))
  WHEN regexp_matches(x, '\\s+[A-Z]{{2}}\\d{{3}}') THEN trim(regexp_replace(x, '\\s+[A-Z]{{2}}\\d{{3}}\\s*', ' ', 'g')) WHEN regexp_matches(x, '\\s+[A-Z]{{2}}\\d{{2}}') THEN trim(regexp_replace(x, '\\s+[A-Z]{{2}}\\d{{2}}\\s*', ' ', 'g')) ELSE x END AS client FROM f4""")
def repaired_clients(spark, sf):
    """Client names whose state codes were misread: the codes repaired, then taken off."""
    k = F.col("p_partkey")
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (k % 8 + 1).cast("int"))
    name = F.concat(F.col("p_name"), F.lit(" "), code, F.when(F.col("p_size") % 3 == 0, " LLC").otherwise(""))
    fixed = read(spark, sf, "part").select(k.alias("id"), S.repair_state_codes(name).alias("repaired"))
    return fixed.select("id", "repaired", S.clean_client(F.col("repaired")).alias("client"))


CARRIERS = ["Allied", " ABSF llc ", "united HEALTHCARE Corporation", "UHC Inc", "Blue Cross, Inc.", "bcbs corp", "AETNA INC", "Cigna Health LLC", "humana", "Other Carrier Inc ", ""]
_carriers = "[" + ", ".join(f"'{x}'" for x in CARRIERS) + "]"
_known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CARRIER_NAMES.items()) + "}"


@query(f"""WITH c AS (SELECT s_suppkey AS id, {_carriers}[1 + s_suppkey % {len(CARRIERS)}] AS x FROM supplier), n AS (SELECT id, x, trim(list_reduce({S.CARRIER_SUFFIXES}, lambda a, w: replace(a, w, ''), trim(lower(x)))) AS k FROM c)
 SELECT id, coalesce({_known}[k], trim(x)) AS carrier FROM n""")
def canonical_carriers(spark, sf):
    """Carriers under their canonical names."""
    name = F.element_at(F.array(*[F.lit(x) for x in CARRIERS]), (F.col("s_suppkey") % len(CARRIERS) + 1).cast("int"))
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), S.carrier_name(name).alias("carrier"))
