"""The corpus pipeline: ranked cleaning stages over documents, each written and read again.

Cases, for all stages: a null or empty text is an empty document, and goes on as it is unless a stage
finds it to be a copy of another; documents without a doc_id are never a copy of another; rows that
share a doc_id are judged by their own texts; an empty table gives empty results; extra columns are
kept whatever their names, and come out of the last stage only as it defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import line_dedup, packing, simhash_dedup, suffix_dedup, toxicity
from ledgerloom.llm.common import Scratch, read

#: (name, function) in the order they run; a function takes (spark, docs, sf_dir).
STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("line_dedup", line_dedup.line_dedup_stage),
    ("simhash_dedup", simhash_dedup.near_dedup_stage),
    ("suffix_dedup", suffix_dedup.suffix_dedup_stage),
    ("packing", packing.packing_stage),
]

#: No SQL: the stages learn, hash and pack by rules SQL cannot express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to the documents; each stage's result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
