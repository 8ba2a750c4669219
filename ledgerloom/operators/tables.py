"""Table-values: extracted tables with changing headers, as rows of cells.

Working form: (upload_id, table_idx, row_idx, header ARRAY<STRING>, cells ARRAY<STRING>).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions import scalars as S

def explode_tables(uploads: DataFrame) -> DataFrame:
    """Uploads with ``tables`` (array of struct<header, rows, summaryRows>) to one row per cell row, summary rows marked."""
    t = uploads.select("upload_id", F.posexplode("tables").alias("table_idx", "t"))
    r = t.select("upload_id", "table_idx", F.transform("t.header", S.header).alias("header"), F.col("t.summaryRows").alias("s"), F.posexplode("t.rows").alias("row_idx", "cells"))
    marked = F.coalesce(F.array_contains("s", F.col("row_idx")), F.lit(False))
    return r.select("upload_id", "table_idx", "row_idx", "header", S.pad_row(F.col("cells"), F.size("header")).alias("cells"), marked.alias("is_summary"))


def cell(name: str | Column) -> Column:
    """The cell under a header, by exact name; null if the header lacks it."""
    at = F.array_position("header", F.lit(name) if isinstance(name, str) else name)
    return F.when(at > 0, F.element_at("cells", at.cast("int")))


def flatten(rows: DataFrame, client: str, commission: str, invoice: str) -> DataFrame:
    """Approved rows to ledger input: summaries skipped, amounts parsed, rows without any amount dropped."""
    out = rows.where(~F.col("is_summary")).select("upload_id", S.strip(cell(client)).alias("client_name"), S.amount_ledger(F.coalesce(cell(commission), F.lit(""))).alias("commission"), S.amount_ledger(F.coalesce(cell(invoice), F.lit(""))).alias("invoice"))
    return out.where((F.col("commission") != 0) | (F.col("invoice") != 0))


def is_grand_total(header: Column, n_rows: Column, n_summary: Column) -> Column:
    """A table that only repeats totals: no identifier column, and one row under amounts, or few rows that are all
    summaries, or few rows under amounts with a total among the headers."""
    low = F.transform(header, lambda x: F.lower(x))

    def only(h: Column) -> Column:
        nameless = ~F.exists(h, lambda x: _any(x, S.GRAND_TOTAL_IDENTIFIERS))
        amounts = F.size(F.filter(h, lambda x: _any(x, S.GRAND_TOTAL_AMOUNTS))) >= F.size(h) * 0.8
        few, total = n_rows <= 3, F.exists(h, lambda x: x.contains("total"))
        return nameless & (((n_rows == 1) & amounts) | ((n_summary == n_rows) & few) | (few & amounts & total))

    return (F.size(header) > 0) & (n_rows > 0) & S.bound(low, only)


def _any(x: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def promote_last_total(rows: DataFrame, value: str, document_total: str) -> DataFrame:
    """Marks a table's last row as summary if it is, to less than a unit, the sum of the other rows that are no
    summaries, or to less than a cent the document's total; documents without a total are left alone."""
    t = Window.partitionBy("upload_id", "table_idx")
    last = F.col("row_idx") == F.max("row_idx").over(t)
    others = F.coalesce(F.sum(F.when(~last & ~F.col("is_summary"), F.col(value))).over(t), F.lit(0))
    total = F.col(document_total)
    hit = (F.abs(F.col(value) - others) < 1) | (F.abs(F.col(value) - total) < F.lit("0.01").cast("decimal(3,2)"))
    return rows.withColumn("is_summary", F.col("is_summary") | F.coalesce(last & (F.count("*").over(t) > 1) & (total != 0) & hit, F.lit(False)))


def stitch(tables: DataFrame) -> DataFrame:
    """Tables of an upload with the same normalised header become one, rows in page and row order."""
    key = F.transform("header", lambda h: F.lower(S.header(h)))
    order = Window.partitionBy("upload_id", "header_key").orderBy("table_idx", "row_idx")
    t = tables.withColumn("header_key", F.array_join(key, "|"))
    first = F.min("table_idx").over(Window.partitionBy("upload_id", "header_key"))
    return t.withColumn("row_no", F.row_number().over(order) - 1).withColumn("first_table", first)


def running_summaries(tables: DataFrame, tolerance: float = 0.0075) -> DataFrame:
    """Adds ``summaries``: positions of the rows of ``rows`` (array of cells) that score as totals of the rows above.

    Amounts of every numeric column (``numeric``, positions) are summed until a row is confirmed, then the sums
    restart; the scan is a fold over the table's own array, so no table leaves its row.
    """
    numeric = F.col("numeric")

    def features(cells: Column) -> Column:
        known = F.transform(cells, lambda c: F.struct(S.filled(c).alias("filled"), S.amount_tolerant(c).alias("v")))
        return S.bound(F.struct(F.lower(F.array_join(F.filter(cells, S.filled), " ")).alias("blob"), known.alias("cells")), scored)

    def scored(x: Column) -> Column:
        blob, cells = x["blob"], x["cells"]
        phrase = F.lit(0.0)
        for pattern, weight in S.SUMMARY_PHRASES.items():
            phrase = F.greatest(phrase, F.when(blob.rlike(pattern), weight).otherwise(0.0))
        values = F.transform(numeric, lambda i: F.get(cells, i)["v"])
        share = F.size(F.filter(cells, lambda c: c["v"].isNotNull())) / F.greatest(F.size(F.filter(cells, lambda c: c["filled"])), F.lit(1))
        words = F.size(F.filter(cells, lambda c: c["filled"] & c["v"].isNull()))
        agent = blob.rlike(r"\bwriting\b") & blob.rlike(r"\bagent\b")
        blank = ~F.exists(F.filter(cells, lambda c, i: ~F.array_contains(numeric, i)), lambda c: c["filled"])
        return F.struct(values.alias("v"), _any(blob, S.SUMMARY_KEYWORDS).alias("word"), phrase.alias("phrase"), agent.alias("agent"), share.alias("share"), words.alias("words"), blank.alias("blank"))

    def step(state: Column, r: Column) -> Column:
        near = lambda v, s: v.isNotNull() & (s != 0) & (F.abs(v - s) <= F.greatest(F.abs(s) * tolerance, F.lit(0.01)))
        hits = F.size(F.filter(F.zip_with(r["v"], state["sums"], near), lambda x: x))
        return S.bound(S.bound(hits, lambda n: is_total(r, n)), lambda total: after(state, r, total))

    def is_total(r: Column, hits: Column) -> Column:
        cue = r["word"] | (r["phrase"] > 0) | r["agent"] | ((r["share"] >= 0.7) & (r["words"] <= 2) & r["blank"])
        score = F.when(r["word"], 0.2).otherwise(0.0) + r["phrase"] + F.when(r["agent"], 0.25).otherwise(0.0) + F.when(r["blank"], 0.1).otherwise(0.0) + F.when(r["share"] >= 0.8, 0.1).otherwise(0.0)
        score = score + F.when(hits > 0, F.lit(0.45) + F.least(hits - 1, F.lit(2)) * 0.05).otherwise(0.0)
        return (cue | (hits > 0)) & (F.round(score, 9) >= 0.55)

    def after(state: Column, r: Column, total: Column) -> Column:
        sums = F.when(total, F.transform(state["sums"], lambda x: F.lit(0.0))).otherwise(F.zip_with(state["sums"], r["v"], lambda s, v: s + F.coalesce(v, F.lit(0.0))))
        found = F.when(total, F.concat(state["found"], F.array(state["at"]))).otherwise(state["found"])
        return F.struct(sums.alias("sums"), found.alias("found"), (state["at"] + 1).alias("at"))

    start = F.struct(F.transform(F.col("numeric"), lambda x: F.lit(0.0)).alias("sums"), F.array().cast("array<int>").alias("found"), F.lit(0).alias("at"))
    return tables.withColumn("summaries", F.aggregate(F.transform("rows", features), start, step, lambda s: s["found"]))


def refined_summaries(tables: DataFrame) -> DataFrame:
    """Replaces ``summaries`` of (header, rows, summaries): rows found by density, keyword or bare numbers, and marks kept unless plainly wrong."""
    width = F.when(F.size("header") > 0, F.size("header")).otherwise(F.array_max(F.transform("rows", lambda r: F.size(r))))
    cells = lambda r: F.struct(F.size(F.filter(r, S.filled)).alias("n"), F.size(F.filter(r, S.is_numeric_cell)).alias("numeric"), F.exists(F.slice(r, 1, 2), lambda c: S.filled(c) & ~S.is_numeric_cell(c)).alias("named"), S.row_is_summary(r).alias("reads"))

    def limits(facts: Column) -> Column:
        counts = F.transform(facts, lambda x: x["n"])
        mean = F.aggregate(counts, F.lit(0.0), lambda s, n: s + n) / F.size("rows")
        middle = F.get(F.sort_array(counts), (F.size("rows") / 2).cast("int"))
        return F.struct(facts.alias("rows"), F.greatest(F.lit(2), F.ceil(F.least(mean, middle) * F.lit(0.4))).alias("limit"), width.alias("width"))

    def stays(x: Column, i: Column, limit: Column, width: Column) -> Column:
        n, numeric, named = x["n"], x["numeric"], x["named"]
        bare = (n <= F.greatest(F.lit(3.0), width * 0.5)) & (numeric >= 1) & ~named & (n == numeric)
        sparse = (n <= limit) & ~named & (numeric >= F.greatest(F.lit(1), F.ceil(width * F.lit(0.3))))
        return x["reads"] | sparse | bare | (F.array_contains("summaries", i) & ~(named & (n > limit * 1.5)))

    found = S.bound(S.bound(F.transform("rows", cells), limits), lambda t: F.transform(t["rows"], lambda x, i: F.when(stays(x, i, t["limit"], t["width"]), i)))
    everything = F.transform("rows", lambda r, i: i)
    whole = is_grand_total(F.col("header"), F.size("rows"), F.size("summaries"))
    return tables.withColumn("summaries", F.when(whole, everything).otherwise(F.filter(found, lambda i: i.isNotNull())))


def column_profile(rows: DataFrame) -> DataFrame:
    """Per column: filled cells, distinct values, lengths and the majority type."""
    long = rows.select("upload_id", "table_idx", "header", F.posexplode("cells").alias("col_idx", "value"))
    long = long.select("upload_id", "table_idx", "col_idx", F.element_at("header", F.col("col_idx") + 1).alias("name"), "value", S.value_type(F.col("value")).alias("kind"))
    return long.groupBy("upload_id", "table_idx", "col_idx", "name").agg(
        F.count_if(F.col("kind") != "empty").alias("filled"), F.countDistinct("value").alias("distinct"), F.min(F.length("value")).alias("shortest"), F.max(F.length("value")).alias("longest"),
        F.mode("kind", deterministic=True).alias("kind"), (F.count_if(F.col("kind").isin("number", "currency")) / F.greatest(F.count_if(F.col("kind") != "empty"), F.lit(1))).alias("numeric_share"),
    )


def header_match(rows: DataFrame, formats: DataFrame, least: float = 0.5) -> DataFrame:
    """The learned format nearest to each header, by the share of common names; formats arrive most recent first."""
    h = rows.select("upload_id", "table_idx", F.transform("header", lambda x: F.lower(x)).alias("h")).distinct()
    pairs = h.select("upload_id", "table_idx", "h", F.explode("h").alias("name")).join(formats.select("format_id", F.col("header").alias("f"), F.explode("header").alias("name")), "name")
    score = F.count("*") / F.greatest(F.size(F.first("h")), F.size(F.first("f")))
    return pairs.groupBy("upload_id", "table_idx", "format_id").agg(score.alias("score")).where(F.col("score") > least).groupBy("upload_id", "table_idx").agg(F.max(F.struct("score", (-F.col("format_id")).alias("f"))).alias("b")).select("upload_id", "table_idx", (-F.col("b.f")).alias("format_id"), "b.score")


def difflib_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``ratio``: matching-blocks similarity of two headers, which Spark has no function for."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y)])

    return pairs.withColumn("ratio", ratio(F.col(a), F.col(b)))


def flatten_mapped(uploads: DataFrame) -> DataFrame:
    """Uploads with their field configuration to ledger input: (carrier_id, upload_id, client_name, commission, invoice).

    ``uploads(upload_id, carrier_id, company_id, config, tables)``. Without a configuration the first row of the first table gives one. Columns
    are resolved for each table by itself; a table without the client or the commission column is left out, one without
    the invoice column has invoices of zero. Summary rows, rows without a client and rows without any amount go.
    """
    first = F.get("tables", 0)
    inferred = X.inferred_config(F.transform(first["header"], S.header), F.get(first["rows"], 0))
    config = F.when(F.coalesce(F.size("config"), F.lit(0)) > 0, F.col("config")).otherwise(inferred)
    once = lambda *columns: F.inline(F.array(F.struct(*columns)))  # noqa: E731  worked out before a filter, which would repeat it
    u = uploads.select("upload_id", F.coalesce("carrier_id", "company_id").alias("carrier_id"), "tables", once(X.field_mapping(config).alias("m"))).where("m.client is not null and m.commission is not null")
    t = u.select("carrier_id", "upload_id", "m", F.explode("tables").alias("t")).select("carrier_id", "upload_id", "m", "t.rows", "t.summaryRows", once(F.transform("t.header", S.header).alias("h")))
    exact = F.when(F.array_contains("h", F.col("m.invoice")), F.size("h") - F.array_position(F.reverse("h"), F.col("m.invoice")).cast("int"))
    t = t.select("carrier_id", "upload_id", "rows", "summaryRows", once(X.resolved(F.col("m.client"), F.col("h")).alias("a"), X.resolved(F.col("m.commission"), F.col("h")).alias("b"), exact.alias("c"))).where("a is not null and b is not null")
    r = t.select("carrier_id", "upload_id", "summaryRows", "a", "b", "c", F.posexplode("rows").alias("i", "row")).where(~F.coalesce(F.array_contains("summaryRows", F.col("i")), F.lit(False)))
    cell = lambda k: F.coalesce(F.get("row", F.col(k)), F.lit(""))
    out = r.select("carrier_id", "upload_id", once(X.client_of(cell("a")).alias("client_name"), S.amount_ledger(cell("b")).alias("commission"), F.coalesce(S.amount_ledger(cell("c")), F.lit(0.0)).alias("invoice")))
    return out.where((F.col("client_name") != "") & ((F.col("commission") != 0) | (F.col("invoice") != 0)))
