"""Tables of one document that go on over pages: how alike two tables are, and the tables that are stitched into one.

Working form: (upload_id, table_idx, header ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>), a row for each table.

Tables with the same header (but for case and outer blanks) are one group. Groups are then merged greedily in
page order: a group joins the first leader before it that is alike enough, else it leads. That is a fold over the
documents' *distinct headers*, each with a small summary of its first table, so neither rows nor pairs of tables are
gathered; rows meet only in the table they end up in. Grand-total tables are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .tables import is_grand_total

# Fixed values of the domain.
WEIGHTS = {"header": 0.3, "columns": 0.2, "format": 0.25, "pattern": 0.15, "structure": 0.1}
NUMERIC = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"
DATES = r"\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4}|\d{4}-\d{1,2}-\d{1,2}"


def header_key(header: Column) -> Column:
    return F.transform(header, lambda h: F.lower(S.strip(F.coalesce(h, F.lit("")))))


def summary(header: Column, rows: Column, expected: Column) -> Column:
    """What the similarity needs of a table; ``expected`` is the width of the document's longest header."""
    fits = F.size(F.filter(rows, lambda r: F.abs(F.size(r) - expected) <= 1)) / F.greatest(F.size(rows), F.lit(1))
    plain = lambda v: S.strip(F.regexp_replace(v, "[,$%]", ""))

    def facts(cells: Column) -> Column:
        length = F.aggregate(cells, F.lit(0), lambda s, v: s + F.length(v)) / F.size(cells)
        return F.struct(F.exists(cells, lambda v: plain(v).rlike(NUMERIC)).alias("number"), F.exists(cells, lambda v: v.contains("$")).alias("currency"), F.exists(cells, lambda v: v.rlike(DATES)).alias("date"), F.exists(cells, lambda v: v.rlike(r"\p{L}")).alias("letter"), length.alias("length"))

    def patterns(first: Column) -> Column:
        width = F.coalesce(F.array_max(F.transform(first, lambda r: F.size(r))), F.lit(0))
        cells = lambda k: F.transform(F.filter(first, lambda r: F.size(r) > k), lambda r: S.strip(F.coalesce(F.get(r, k), F.lit(""))))
        return S.bound(width, lambda w: F.transform(F.filter(F.sequence(F.lit(0), w), lambda k: k < w), lambda k: S.bound(cells(k), facts)))

    def whole(x: Column) -> Column:
        words = F.filter(F.split(x["joined"], r"\s+"), lambda w: w != "")
        letters = F.array_distinct(F.filter(F.split(x["joined"], ""), lambda c: c != ""))
        return S.bound(words, lambda w: F.struct(x["h"].alias("h"), x["joined"].alias("joined"), F.array_distinct(w).alias("words"), F.size(w).alias("n_words"), letters.alias("letters")))

    named = S.bound(S.bound(header_key(header), lambda h: F.struct(h.alias("h"), F.array_join(h, " ").alias("joined"))), whole)
    rest = F.struct(F.size(rows).alias("n_rows"), fits.alias("fits"), S.bound(F.slice(rows, 1, 3), patterns).alias("patterns"))
    both = lambda x: F.struct(*[x["named"][k].alias(k) for k in ("h", "joined", "words", "n_words", "letters")], *[x["rest"][k].alias(k) for k in ("n_rows", "fits", "patterns")])
    return S.bound(F.struct(named.alias("named"), rest.alias("rest")), both)


def shared_letters(a: Column, b: Column) -> Column:
    """Share of the longer text's length that letters of ``a`` found in ``b`` make up; the order of the two matters."""
    found = F.size(F.filter(F.split(a, ""), lambda c: (c != "") & b.contains(c)))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(found / F.greatest(F.length(a), F.length(b)))


def overlap(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def is_split(a: Column, b: Column, wider: Column, phrase: Column, words: Column, common: Column) -> Column:
    """Whether one header looks like the other with columns split: many words in common that stand side by side, alike as
    phrases, or alike in words and letters, and of different widths."""
    beside = lambda x, y: F.concat(x, F.lit(" "), y)
    near = lambda text: a["joined"].contains(text) | b["joined"].contains(text)
    side = F.exists(common, lambda x: F.exists(common, lambda y: (x != y) & near(beside(x, y))))
    long = (phrase >= 0.7) & (F.abs(a["n_words"] - b["n_words"]) >= 2)
    content = words * 0.7 + overlap(a["letters"], b["letters"]) * 0.3
    return ((F.size(common) >= 3) & wider & side) | long | (wider & (content >= 0.6))


def similarity_parts(a: Column, b: Column) -> Column:
    """The five parts of the similarity of two summaries, each from 0 to 1, as a struct."""

    def parts(x: Column) -> Column:
        a, b, wide, narrow, columns = x["a"], x["b"], x["wide"], x["narrow"], x["columns"]
        at = lambda h, k: F.coalesce(F.get(h, k), F.lit(""))
        pair = lambda p: F.when(p["x"] == p["y"], 1.0).otherwise(shared_letters(p["x"], p["y"]))
        pairs = F.transform(F.sequence(F.lit(0), wide - 1), lambda k: S.bound(F.struct(at(a["h"], k).alias("x"), at(b["h"], k).alias("y")), pair))
        mean = F.aggregate(pairs, F.lit(0.0), lambda s, y: s + y) / wide
        heads = F.struct(shared_letters(a["joined"], b["joined"]).alias("phrase"), overlap(a["words"], b["words"]).alias("words"), F.array_intersect(a["words"], b["words"]).alias("common"))
        header = S.bound(heads, lambda h: F.when(is_split(a, b, wide > narrow, h["phrase"], h["words"], h["common"]), h["phrase"] * 0.7 + h["words"] * 0.3).otherwise(mean))
        same = lambda p, q: sum(((p[k] == q[k]).cast("int") for k in ("number", "currency", "date", "letter")), (F.abs(p["length"] - q["length"]) <= 5).cast("int")) >= 4
        hits = F.size(F.filter(F.sequence(F.lit(0), columns - 1), lambda k: same(F.get(a["patterns"], k), F.get(b["patterns"], k))))
        rows = (a["n_rows"] > 0) & (b["n_rows"] > 0)
        alike = ((F.size(a["h"]) > 0) == (F.size(b["h"]) > 0)).cast("int") + ((a["n_rows"] > 0) == (b["n_rows"] > 0)).cast("int")
        near = F.abs(a["n_rows"] - b["n_rows"]) / F.greatest(a["n_rows"], b["n_rows"]) <= 0.5
        return F.struct(
            F.when(narrow == 0, 0.0).otherwise(header).alias("header"),
            F.when(wide == narrow, 1.0).when(narrow == 0, 0.0).otherwise(1.0 - (wide - narrow) / wide).alias("columns"),
            F.when(rows, (a["fits"] + b["fits"]) / 2).otherwise(0.0).alias("format"),
            F.when(rows & (columns > 0), hits / columns).otherwise(0.0).alias("pattern"),
            F.when(rows, (alike + near.cast("int")) / 3).otherwise(alike / 2).alias("structure"),
        )

    sizes = F.greatest(F.size(a["h"]), F.size(b["h"])).alias("wide"), F.least(F.size(a["h"]), F.size(b["h"])).alias("narrow"), F.least(F.size(a["patterns"]), F.size(b["patterns"])).alias("columns")
    return S.bound(F.struct(a.alias("a"), b.alias("b"), *sizes), parts)


def weighted(parts: Column) -> Column:
    return sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """The weighted similarity of two tables, ``a`` the earlier one."""
    return S.bound(similarity_parts(a, b), weighted)


def with_summary(tables: DataFrame) -> DataFrame:
    """Adds ``is_total`` and ``summary``; the longest header of a document's other tables sets the expected width."""
    marked = tables.withColumn("is_total", is_grand_total(F.col("header"), F.size("rows"), F.lit(0)))
    widest = F.coalesce(F.max(F.when(~F.col("is_total"), F.size("header"))).over(Window.partitionBy("upload_id")), F.lit(0))
    return marked.withColumn("_wide", widest).withColumn("summary", summary(F.col("header"), F.col("rows"), F.col("_wide"))).drop("_wide")


def stitch_alike(tables: DataFrame, least: float = 0.8) -> DataFrame:
    """Adds ``leader``, the first table of the stitched table that each table belongs to, and ``place``, its group's first table: rows go in the order of (place, table_idx)."""
    t = with_summary(tables).withColumn("key", F.concat_ws("\u0001", F.size("header").cast("string"), header_key(F.col("header"))))
    t = t.withColumn("key", F.when(F.col("is_total"), F.concat(F.lit("\u0002"), F.col("table_idx").cast("string"))).otherwise(F.col("key")))
    groups = t.where("not is_total").groupBy("upload_id", "key").agg(F.min("table_idx").alias("place"), F.min_by("summary", "table_idx").alias("summary"))
    line = groups.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("place", "key", "summary"))).alias("line"))

    def step(held: Column, g: Column) -> Column:
        first = F.get(F.filter(held["leaders"], lambda x: similarity(x["summary"], g["summary"]) >= least), 0)["place"]
        return S.bound(first, lambda f: grown(held, g, f))

    def grown(held: Column, g: Column, first: Column) -> Column:
        leaders = F.when(first.isNull(), F.array_append(held["leaders"], F.struct(g["place"].alias("place"), g["summary"].alias("summary")))).otherwise(held["leaders"])
        found = F.array_append(held["found"], F.struct(g["key"].alias("key"), g["place"].alias("place"), F.coalesce(first, g["place"]).alias("leader")))
        return F.struct(leaders.alias("leaders"), found.alias("found"))

    none = F.slice("line", 1, 0)
    start = F.struct(F.transform(none, lambda g: F.struct(g["place"].alias("place"), g["summary"].alias("summary"))).alias("leaders"), F.transform(none, lambda g: F.struct(g["key"].alias("key"), g["place"].alias("place"), g["place"].alias("leader"))).alias("found"))
    found = line.select("upload_id", F.explode_outer(F.aggregate("line", start, step, lambda s: s["found"])).alias("f")).select("upload_id", "f.*")
    out = t.drop("summary").join(found, ["upload_id", "key"], "left").drop("key")
    return out.withColumn("place", F.coalesce("place", "table_idx")).withColumn("leader", F.coalesce("leader", "table_idx"))


def stitched(tables: DataFrame, least: float = 0.8) -> DataFrame:
    """(upload_id, first_table, is_total, header, rows, parts): the stitched tables, under the longest header of their parts, the first of equals, rows padded to it."""
    s = stitch_alike(tables, least)
    order = F.sort_array(F.collect_list(F.struct("place", "table_idx", "rows")))
    best = F.min_by("header", F.struct(-F.size("header"), F.col("place"), F.col("table_idx")))
    t = s.groupBy("upload_id", "leader", "is_total").agg(order.alias("line"), best.alias("header"))
    rows = F.flatten(F.transform("line", lambda x: x["rows"]))
    return t.select("upload_id", F.col("leader").alias("first_table"), "is_total", "header", F.transform(rows, lambda r: S.pad_row(r, F.size("header"))).alias("rows"), F.transform("line", lambda x: x["table_idx"]).alias("parts"))
