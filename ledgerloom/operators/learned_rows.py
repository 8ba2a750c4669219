"""Summary rows by learned patterns: what sets a company's marked rows apart in one table is looked for in its others.

Learning takes tables (company_id, upload_id, table_idx, header, rows, summaries); a pattern belongs to a company and a
table signature, the newest table's facts replace older ones, and each use adds to its confidence. Applying joins
*columns* with cue words, by company and column name: the cue words of all patterns of a name are one row, so
neither rows nor tables meet patterns one by one. A pattern's own signature is told apart by the least
and greatest signature that has a word: tables of the same signature take the pattern's sample rows instead.

Null cells and headers are empty texts; positions beyond the table are left out; of repeated column names the last
one's facts count; a table without rows has no signature match and no found rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the domain.
FIRST_CONFIDENCE, STEP, MOST, INEXACT, LEAST = 80, 5, 100, 0.8, 60
KEYWORDS = 10
FLAGS = ["total", "summary", "subtotal"]
ROW_PATTERNS = [
    r"^Total for Group:?\s*[A-Za-z\s]+$", r"^Total\s+for\s+Group:?\s*[A-Za-z\s]+$", r"^Group\s+Total:?\s*[A-Za-z\s]+$",
    r"^Total:?\s*[A-Za-z\s]*$", r"^Subtotal:?\s*[A-Za-z\s]*$", r"^Grand Total:?\s*[A-Za-z\s]*$", r"^Summary:?\s*[A-Za-z\s]*$",
    r"^[A-Za-z\s]+\s+Total$", r"^Total\s+[A-Za-z\s]+$", r"^(Total|Subtotal|Summary|Group|Grand)\s+", r"^.*\s+(Total|Subtotal|Summary)$",
    r"^.*\s+\d+\s+.*\s+\$\d+\.?\d*$",
]
FIRST_CELL_WORDS = ["total", "subtotal", "summary", "grand", "group", "sum", "count", "amount", "balance", "net", "final", "overall", "combined", "aggregate"]
NUMERIC, CURRENCY, DATE = r"^\d+(\.\d+)?$", r"^\$?\d+(,\d{3})*(\.\d{2})?$", r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"


def clean(tables: DataFrame) -> DataFrame:
    """Null cells and headers as empty texts."""
    blank = lambda x: F.coalesce(x, F.lit(""))
    return tables.withColumn("header", F.transform("header", blank)).withColumn("rows", F.transform("rows", lambda r: F.transform(r, blank)))


def signature(header: Column, rows: Column) -> Column:
    cells = F.aggregate(rows, F.lit(0), lambda s, r: s + F.size(r))
    mean = F.format_string("%.2f", cells / F.greatest(F.size(rows), F.lit(1)))
    return F.md5(F.concat_ws("|", F.size(header).cast("string"), F.size(rows).cast("string"), mean, F.array_join(header, "|")).cast("binary"))


def share(cells: Column, test) -> Column:
    return F.size(F.filter(cells, test)) / F.greatest(F.size(cells), F.lit(1))


def says(texts: Column, word: str) -> Column:
    return F.exists(texts, lambda c: F.lower(c).contains(word))


def is_number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).rlike(NUMERIC)


def column_facts(header: Column, rows: Column, marked: Column) -> Column:
    """(name, keywords, data_type, ...) of each column; ``marked`` are the positions of summary rows inside the table."""
    words = lambda cells: F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(r"\b[A-Za-z]+\b"), 0)))
    cell = lambda r, k: F.coalesce(F.get(r, k), F.lit(""))

    def facts(name: Column, k: Column) -> Column:
        inside = F.transform(marked, lambda i: cell(F.get(rows, i), k))
        outside = F.transform(F.filter(rows, lambda r, i: ~F.array_contains(marked, i)), lambda r: cell(r, k))
        keywords = F.slice(F.array_sort(F.array_distinct(F.array_except(words(inside), words(outside)))), 1, KEYWORDS)
        n = F.size(inside)
        numbers = F.size(F.filter(inside, is_number))
        kind = F.when(F.size(F.filter(inside, lambda c: c.rlike(DATE))) > n * 0.3, "date").when(F.size(F.filter(inside, lambda c: c.rlike(CURRENCY))) > n * 0.3, "currency").when(numbers > n * 0.5, "numeric").otherwise("string")
        length = F.aggregate(inside, F.lit(0), lambda s, c: s + F.length(c)) / F.greatest(n, F.lit(1))
        flags = [says(inside, w).alias(w) for w in FLAGS]
        return F.struct(name.alias("name"), keywords.alias("keywords"), kind.alias("data_type"), length.alias("avg_length"), share(inside, lambda c: F.trim(c) == "").alias("empty_ratio"), share(inside, is_number).alias("numeric_ratio"), *flags)

    each = F.transform(header, facts)
    return F.filter(each, lambda c, k: ~F.exists(F.slice(header, k + 2, F.size(header)), lambda h: h == c["name"]))


def row_facts(rows: Column, marked: Column) -> Column:
    """Position, content and structure of the summary rows."""
    text = lambda r: F.array_join(r, " ")
    inside, outside = F.transform(marked, lambda i: F.get(rows, i)), F.filter(rows, lambda r, i: ~F.array_contains(marked, i))
    both = (F.size(inside) > 0) & (F.size(outside) > 0)
    mean = lambda rs: F.aggregate(rs, F.lit(0), lambda s, r: s + F.length(text(r))) / F.size(rs)
    places = F.transform(marked, lambda i: i / F.size(rows))
    cells = F.flatten(inside)
    flags = [(both & says(F.transform(inside, text), w)).alias(w) for w in FLAGS]
    return F.struct(
        (F.aggregate(places, F.lit(0.0), lambda s, p: s + p) / F.nullif(F.size(places), F.lit(0))).alias("avg_position"), F.exists(places, lambda p: p > 0.8).alias("at_end"), F.exists(places, lambda p: p < 0.2).alias("at_start"),
        F.when(both, mean(inside) / F.greatest(mean(outside), F.lit(1.0))).alias("length_ratio"), F.when(both, share(cells, is_number)).alias("numeric_density"), share(cells, lambda c: F.trim(c) == "").alias("empty_cells"),
        F.exists(inside, lambda r: F.size(F.array_distinct(r)) < F.size(r) * 0.5).alias("repeated_values"), share(cells, lambda c: c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")).alias("all_caps"), *flags,
    )


def learn(tables: DataFrame) -> DataFrame:
    """(company_id, signature, columns, row, samples, usage, confidence): one pattern for a company and signature, by the newest upload's table."""
    t = clean(tables).withColumn("marked", F.array_sort(F.array_distinct(F.filter("summaries", lambda i: i.isNotNull() & (i >= 0) & (i < F.size("rows"))))))
    t = t.where(F.col("company_id").isNotNull() & (F.size("marked") > 0))
    facts = F.struct(column_facts(F.col("header"), F.col("rows"), F.col("marked")).alias("columns"), row_facts(F.col("rows"), F.col("marked")).alias("row"), F.transform("marked", lambda i: F.get("rows", i)).alias("samples"))
    g = t.groupBy("company_id", signature(F.col("header"), F.col("rows")).alias("signature")).agg(F.max_by(facts, F.struct("upload_id", "table_idx")).alias("f"), F.count("*").alias("usage"))
    return g.select("company_id", "signature", "f.*", "usage", F.least(F.lit(MOST), F.lit(FIRST_CONFIDENCE) + STEP * (F.col("usage") - 1)).cast("int").alias("confidence"))


def cues(patterns: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """Cue words by company and column name, and by company for whole rows, each as (word, lo, hi) with its least and greatest signature."""
    sure = patterns.where(F.col("confidence") * INEXACT >= least)
    flagged = lambda c, prefix="": F.filter(F.array(*[F.when(c[w] if not prefix else F.col(f"{prefix}.{w}"), w) for w in FLAGS]), lambda w: w.isNotNull())
    by_column = sure.select("company_id", "signature", F.explode("columns").alias("c")).select("company_id", "signature", F.col("c.name").alias("name"), F.explode(F.concat(F.transform("c.keywords", F.lower), flagged(F.col("c")))).alias("word"))
    by_row = sure.select("company_id", "signature", F.explode(flagged(None, "row")).alias("word"))
    held = lambda df, *key: df.groupBy(*key, "word").agg(F.min("signature").alias("lo"), F.max("signature").alias("hi")).groupBy(*key).agg(F.collect_list(F.struct("word", "lo", "hi")).alias("cues"))
    return held(by_column, "company_id", "name"), held(by_row, "company_id")


def apply(tables: DataFrame, patterns: DataFrame, least: float = LEAST) -> DataFrame:
    """Adds ``learned``, positions of the rows that patterns of the company find; patterns whose confidence is under ``least``, or eight tenths of it for other signatures, find none."""
    t = clean(tables).withColumn("_sig", signature(F.col("header"), F.col("rows")))
    columns, rows = cues(patterns, least)
    others = lambda c: F.transform(F.filter(c, lambda x: (x["lo"] != F.col("_sig")) | (x["hi"] != F.col("_sig"))), lambda x: x["word"])
    of = t.select("company_id", "upload_id", "table_idx", "_sig", F.posexplode("header").alias("k", "name")).join(columns, ["company_id", "name"])
    of = of.select("upload_id", "table_idx", F.struct("k", others(F.col("cues")).alias("words")).alias("c")).where(F.size("c.words") > 0)
    of = of.groupBy("upload_id", "table_idx").agg(F.collect_list("c").alias("_columns"))
    same = patterns.where(F.col("confidence") >= least).select("company_id", F.col("signature").alias("_sig"), F.col("samples").alias("_samples"))
    t = t.join(of, ["upload_id", "table_idx"], "left").join(rows.withColumnRenamed("cues", "_cues"), "company_id", "left").join(same, ["company_id", "_sig"], "left")
    t = t.withColumn("_row_words", F.when(F.col("_cues").isNotNull(), others(F.col("_cues"))))
    cell = lambda r, k: F.lower(F.coalesce(F.get(r, k), F.lit("")))

    def hit(r: Column) -> Column:
        by_column = F.exists("_columns", lambda c: F.exists(c["words"], lambda w: cell(r, c["k"]).contains(w)))
        by_row = F.exists("_row_words", lambda w: F.lower(F.array_join(r, " ")).contains(w))
        return F.coalesce(by_column, F.lit(False)) | F.coalesce(by_row, F.lit(False))

    found = F.filter(F.transform("rows", lambda r, i: F.when(hit(r), i)), lambda i: i.isNotNull())
    sampled = F.coalesce(F.filter(F.transform("_samples", lambda s: F.array_position("rows", s).cast("int") - 1), lambda i: i >= 0), F.array().cast("array<int>"))
    return t.withColumn("learned", F.array_sort(F.array_distinct(F.concat(found, sampled)))).drop("_sig", "_columns", "_cues", "_row_words", "_samples")


def looks_like_summary(cells: Column) -> Column:
    """The fixed test of a row: one of twelve patterns on its text, a word of its first cell, or "total for group"; never an empty row."""
    text = F.trim(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " "))
    pattern = text.rlike("(?i)" + "|".join(f"(?:{p})" for p in ROW_PATTERNS))
    word = F.lower(F.coalesce(F.get(cells, 0), F.lit(""))).rlike("|".join(FIRST_CELL_WORDS))
    return (F.size(cells) > 0) & (pattern | word | F.lower(text).contains("total for group"))
