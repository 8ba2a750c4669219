"""Tables and fields inside text: pipe tables, JSON, quoted CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_field(c: Column, path: str) -> Column:
    """A field of a JSON text, code fences around it removed; null if it is no JSON."""
    return F.get_json_object(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), path)


def pipe_tables(docs: DataFrame) -> DataFrame:
    """(id, header, row_idx, cells) of the pipe table in each text; rule lines and other text are skipped."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x).startswith("|"))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^[\s|:\-]+$"))
    parts = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    t = docs.select("id", parts.alias("p")).where(F.size("p") > 1)
    return t.select("id", F.col("p")[0].alias("header"), F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("row_idx", "cells"))


def quoted_csv(name: Column, header: Column, rows: Column) -> Column:
    """A table as text: its name, then header and rows with every cell quoted; quotes inside are not escaped."""
    line = lambda cells: F.concat(F.lit('"'), F.array_join(cells, '","'), F.lit('"'))
    return F.concat(F.lit("Table: "), name, F.lit("\n"), line(header), F.lit("\n"), F.array_join(F.transform(rows, line), "\n"), F.lit("\n"))


def statement_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files with their format by suffix and content hash; other suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.withColumn("suffix", suffix).where(F.col("suffix").isin("pdf", "xlsx", "xls", "xlsm", "xlsb")).withColumn("file_hash", F.sha2("content", 256))
