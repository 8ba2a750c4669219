"""Dates in texts and what they are called: every line of a whole text is searched, with two lines around it as context.

Lines, contexts, matches and labels stay inside the document's own row; only the dates found are grouped, by document
and date. A line is searched by all patterns only if it can hold a date at all.

A null or empty text has no dates; a date of several lines counts once, under its surest label (of equals the type
that ranks first, then the first place); rows that repeat an id are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

# Fixed values of the domain.
DATE_LABELS = {
    "statement_date": ["statement date", "statement", "date", "as of", "for period ending", "period ending", "ending", "statement period", "report date"],
    "payment_date": ["payment date", "payment", "paid date", "settlement date", "eft settlement date", "payment week", "payment period", "transfer date"],
    "billing_date": ["billing date", "billing period", "billing", "invoice date", "premium due date", "due date"],
    "effective_date": ["effective date", "effective", "coverage date", "policy date", "start date", "beginning date", "group effective date", "group effective dat"],
    "report_date": ["report date", "report", "generated", "created", "issued", "document date", "print date", "report run date"],
    "archive_date": ["archive date", "archived", "filing date"],
    "coverage_period": ["coverage period", "coverage", "period", "billing period"],
}
TYPE_RANK = {"statement_date": 1, "payment_date": 2, "billing_date": 3, "effective_date": 4, "report_date": 5}
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
M, D, Y = "(0?[1-9]|1[0-2])", r"(0?[1-9]|[12]\d|3[01])", r"(19|20)\d{2}"
NAMES, SHORT = "(" + "|".join(MONTHS) + ")", "(" + "|".join(m[:3] for m in MONTHS) + ")"
DATE_PATTERNS = [
    rf"\b{M}[/-]{D}[/-]{Y}\b", rf"\b{M}[/-]{D}[/-]\d{{2}}\b", rf"\b{Y}-{M}-{D}\b",
    rf"\b{NAMES}\s+\d{{1,2}},?\s+{Y}\b", rf"\b{SHORT}\.?\s+\d{{1,2}},?\s+{Y}\b", rf"\b{D}[/-]{M}[/-]{Y}\b", rf"\b{M}\s*[/-]\s*{D}\s*[/-]\s*{Y}\b",
    rf"\b{NAMES}\s+\d{{1,2}}\s+{Y}\b", rf"\b{SHORT}\.?\s+\d{{1,2}}\s+{Y}\b", rf"\b{D}\s+{NAMES}\s+{Y}\b", rf"\b{D}\s+{SHORT}\.?\s+{Y}\b",
    rf"{M}[/-]{D}[/-]{Y}", rf"{NAMES}\d{{1,2}},?\d{{4}}", rf"{SHORT}\.?\d{{1,2}},?\d{{4}}",
    r"StatementDate\d{1,2}/\d{1,2}/\d{4}", r"StatementDate\d{1,2}-\d{1,2}-\d{4}", r"PaymentDate\d{1,2}/\d{1,2}/\d{4}", r"PaymentDate\d{1,2}-\d{1,2}-\d{4}",
]
PERMISSIVE = ["statement", "commission", "report", "date"] + [m.lower() for m in MONTHS]
IDENTIFIERS = ["policy", "id", "number", "code", "reference"]
SURE, NEAR, IN_CONTEXT, BY_WORD, UNKNOWN = 1.0, 0.8, 0.6, 0.5, 0.3

POSSIBLE = rf"(?i)\d\s*[/-]\s*\d|{SHORT}[a-z]*\.?\s*\d"


def type_of(label: str) -> str:
    """The first family with a label inside this one."""
    return next((family for family, labels in DATE_LABELS.items() if any(x in label for x in labels)), "unknown")


LABELS = [(label, type_of(label)) for labels in DATE_LABELS.values() for label in labels]


def is_day(year: Column, month: Column, day: Column) -> Column:
    """Whether the three numbers are a day of the calendar."""
    sound = month.between(1, 12) & (year >= 1) & (day >= 1)
    return sound & (day <= F.dayofmonth(F.last_day(F.make_date(F.when(sound, year).otherwise(2000), F.when(sound, month).otherwise(1), F.lit(1)))))


def is_valid(date: Column) -> Column:
    """Whether a found date is a day: numbers in either order, two-digit years from 50 on in the last century, names of months
    with or without blanks. The first form that fits decides."""
    number = lambda parts, k: F.coalesce(F.get(parts, k).try_cast("int"), F.lit(0))
    parts = F.split(date, F.when(date.contains("/"), "/").otherwise("-"))
    three = F.size(parts) == 3
    short = number(parts, 2)
    short = F.when(short < 50, short + 2000).otherwise(short + 1900)
    month = lambda low: F.coalesce(F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), F.substring(low, 1, 3)).cast("int"), F.lit(0))
    spaced = F.split(F.replace(date, F.lit(","), F.lit("")), r"\s+")
    glued = lambda k: F.regexp_extract(date, r"^[A-Za-z]+\.?(\d{1,2}),?(\d{4})$", k).try_cast("int")
    name = month(F.lower(date))
    return (
        F.when(date.rlike(rf"^{M}[/-]{D}[/-]{Y}\b"), three & is_day(number(parts, 2), number(parts, 0), number(parts, 1)))
        .when(date.rlike(rf"^{M}[/-]{D}[/-]\d{{2}}\b"), three & is_day(short, number(parts, 0), number(parts, 1)))
        .when(date.rlike(rf"^{Y}-{M}-{D}\b"), is_day(number(parts, 0), number(parts, 1), number(parts, 2)))
        .when(date.rlike(rf"(?i)^({NAMES}|{SHORT})\s+\d{{1,2}},?\s+{Y}\b"), is_day(number(spaced, 2), name, number(spaced, 1)))
        .when(date.rlike(rf"^{D}[/-]{M}[/-]{Y}\b"), three & is_day(number(parts, 2), number(parts, 1), number(parts, 0)))
        .when(date.rlike(rf"(?i)^({NAMES}|{SHORT}\.?)\d{{1,2}},?\d{{4}}"), F.coalesce(is_day(glued(2), name, glued(1)), F.lit(False)))
        .otherwise(False)
    )


def fits_context(date: Column, context: Column) -> Column:
    """Whether the text around a date lets it be one: not an identifier, not beside an amount, unless the text speaks of statements or months."""
    low = F.lower(context)
    number = low.rlike("|".join(IDENTIFIERS)) & date.rlike(r"\d{4,}")
    return low.rlike("|".join(PERMISSIVE)) | ~(number | context.rlike(r"\$.*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"))


def label_of(line: Column, date: Column, context: Column) -> Column:
    """(label, confidence, date_type): the first label of the line, surer the nearer it is, else of the context, else a word that hints at one."""
    low, around = F.lower(line), F.lower(context)
    labels = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(t).alias("date_type")) for x, t in LABELS])
    here, there = F.get(F.filter(labels, lambda x: low.contains(x["label"])), 0), F.get(F.filter(labels, lambda x: around.contains(x["label"])), 0)
    away = F.abs(F.position(F.lower(date), low) - F.position(here["label"], low))
    said = lambda label, confidence, kind: F.struct(label.alias("label"), confidence.cast("double").alias("confidence"), kind.alias("date_type"))
    sure = F.greatest(F.lit(NEAR), F.lit(SURE) - away / 100.0)
    return (
        F.when(here.isNotNull(), said(here["label"], sure, here["date_type"]))
        .when(there.isNotNull(), said(there["label"], F.lit(IN_CONTEXT), there["date_type"]))
        .when(around.contains("commission"), said(F.lit("commission date"), F.lit(BY_WORD), F.lit(type_of("commission date"))))
        .otherwise(said(F.lit("date"), F.lit(UNKNOWN), F.lit(type_of("date"))))
    )


def found_dates(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, date_value, label, confidence, date_type, line): each date of each text once, under its surest label."""
    t = texts.select(F.col(key), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    t = t.select(key, "lines", F.explode(F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(POSSIBLE), i)), lambda i: i.isNotNull())).alias("line"))
    start = F.greatest(F.col("line") - 2, F.lit(0))
    t = t.select(key, "line", S.strip(F.get("lines", F.col("line"))).alias("said"), F.array_join(F.slice("lines", start + 1, F.col("line") + 3 - start), " ").alias("context"))
    every = F.flatten(F.array(*[F.regexp_extract_all("said", F.lit(f"(?i){p}"), F.lit(0)) for p in DATE_PATTERNS]))
    d = t.select(key, "line", "said", "context", F.posexplode(every).alias("place", "date_value"))
    d = d.where(is_valid(F.col("date_value")) & fits_context(F.col("date_value"), F.col("context")))
    d = d.select(key, "line", "place", "date_value", label_of(F.col("said"), F.col("date_value"), F.col("context")).alias("l"))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_RANK.items() for x in pair]), F.col("l.date_type")), F.lit(99))
    best = F.max_by(F.struct("date_value", "l", "line"), F.struct(F.col("l.confidence"), -rank, -F.col("line"), -F.col("place")))
    g = d.groupBy(key, F.lower(S.strip(F.col("date_value"))).alias("_date")).agg(best.alias("b"))
    return g.select(key, "b.date_value", "b.l.label", "b.l.confidence", "b.l.date_type", "b.line")
