"""Cells that hold several values: taking them apart, and how well a value fits a column by a reference value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import strip

# Fixed values of the domain: what a cell is searched for, in this order; each find leaves the text before the next search.
COMPONENTS = {
    "alphanumeric_code": r"[A-Z]+[-]?[A-Z]*\d+[A-Z\d]*",
    "formatted_number": r"[\$£€¥]?[\(]?[\d,]+\.?\d*[\)]?[%]?",
    "date_pattern": r"\d{1,4}[/\-\.]\d{1,4}[/\-\.]\d{2,4}",
    "pure_number": r"(?<![A-Za-z])\b\d+\b(?![A-Za-z/\-\.])",
}
LONGEST_PHRASE = 25


def components(cell: Column) -> Column:
    """(value, kind) of a cell: codes, numbers, dates, what numbers are left, and phrases of the words that remain. Blank and null cells hold none."""
    bound = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # noqa: E731  a value named once
    state = F.struct(strip(F.coalesce(cell, F.lit(""))).alias("rest"), F.array().cast("array<struct<value:string,kind:string>>").alias("found"))
    for kind, pattern in COMPONENTS.items():
        state = _search(bound, state, kind, pattern)

    def phrase(s: Column, part: Column) -> Column:
        now = F.when(s["now"] == "", part).otherwise(F.concat(s["now"], F.lit(" "), part))
        ends = (F.length(now) > LONGEST_PHRASE) | part.endswith(".")
        return F.struct(F.when(ends, "").otherwise(now).alias("now"), F.when(ends, F.array_append(s["done"], now)).otherwise(s["done"]).alias("done"))

    def last(s: Column) -> Column:
        parts = F.filter(F.split(s["rest"], r"\s+"), lambda p: F.length(p) > 1)
        start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))
        phrases = F.aggregate(parts, start, phrase, lambda x: F.when(x["now"] == "", x["done"]).otherwise(F.array_append(x["done"], x["now"])))
        return F.concat(s["found"], F.transform(phrases, lambda p: F.struct(p.alias("value"), F.lit("text_phrase").alias("kind"))))

    return bound(state, last)


def _search(bound, state: Column, kind: str, pattern: str) -> Column:
    """One search: all finds of the text as it is, then each taken out of it, numbers without form only once each."""

    def out(text: Column, x: Column) -> Column:
        return F.regexp_replace(text, F.concat(F.lit(r"(?s)^(.*?)"), x), F.lit("$1 ")) if kind == "pure_number" else F.replace(text, x, F.lit(" "))

    def step(s: Column) -> Column:
        finds = F.regexp_extract_all(s["rest"], F.lit(pattern), F.lit(0))
        return F.struct(F.aggregate(finds, s["rest"], out).alias("rest"), F.concat(s["found"], F.transform(finds, lambda x: F.struct(x.alias("value"), F.lit(kind).alias("kind")))).alias("found"))

    return bound(state, step)


def _number(reference: Column) -> Column:
    return F.when(reference.rlike(r"^\d+$"), "pure_integer").when(reference.rlike(r"^\d+\.\d+$"), "decimal_number")


def _business(reference: Column) -> Column:
    return (
        F.when(reference.rlike(r"[A-Z]+\d+"), "alphanumeric_code").when(reference.rlike(r"\d+[/\-]\d+[/\-]\d+"), "date_pattern")
        .when(reference.rlike("[$£€¥]") & reference.rlike(r"\d"), "currency_pattern").when(reference.contains("%") & reference.rlike(r"\d"), "percentage_pattern")
    )


def reference_patterns(reference: Column) -> Column:
    """What a column's reference value says of its values: the pattern names it shows, in order."""
    words = F.filter(F.split(strip(reference), r"\s+"), lambda w: w != "")
    text = F.when(reference.rlike("[A-Za-z]"), F.when(reference.rlike(r"^[A-Z\s]+$"), "uppercase_text").when(F.size(words) > 1, "multi_word_text"))
    return F.filter(F.array(_number(reference), text, _business(reference)), lambda p: p.isNotNull())


def column_fit(value: Column, reference: Column) -> Column:
    """How well a value fits a column by its reference value, from 0 to 1: the same pattern, digits and letters where
    the reference has them, and a like length. An empty value fits an empty reference only."""
    value, reference = F.coalesce(value, F.lit("")), F.coalesce(reference, F.lit(""))
    number, business = _number(reference), _business(reference)  # no lambda, so a fixed reference is read once, when the query is planned
    same = (
        ((business == "alphanumeric_code") & value.rlike(r"[A-Z]+\d+")) | ((business == "date_pattern") & value.rlike(r"\d+[/\-]\d+[/\-]\d+"))
        | ((business == "currency_pattern") & (value.rlike("[$£€]") | (value.contains("(") & value.contains(")")))) | ((business == "percentage_pattern") & value.contains("%"))
        | ((number == "pure_integer") & value.rlike(r"^\d+$")) | ((number == "decimal_number") & value.rlike(r"^\d+\.\d+$"))
    )
    both = lambda pattern: reference.rlike(pattern) & value.rlike(pattern)
    longest = F.greatest(F.length(value), F.length(reference), F.lit(1))
    length = F.greatest(F.lit(0.0), 1 - F.abs(F.length(value) - F.length(reference)) / longest)
    score = F.when(same, 0.8).otherwise(0.0) + F.when(both(r"\d"), 0.3).otherwise(0.0) + F.when(both("[A-Za-z]"), 0.3).otherwise(0.0) + length * 0.2
    blank = strip(reference) == ""
    return F.when(strip(value) == "", F.when(blank, 1.0).otherwise(0.0)).when(blank, 0.0).otherwise(F.least(score, F.lit(1.0)))
