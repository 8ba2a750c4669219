"""Exact token-length histogram and what its suffix sums answer.

Documents are aggregated by encoded length. With the number and the tokens of all documents at least
as long, every context limit has its exact answers: documents that overflow, tokens after
truncation, tokens lost, and the share of documents that fit (so any quantile). Between two lengths
of the histogram these are linear in the limit, which ``at_limits`` uses for limits no document has.

Cases: a null or empty text has length zero; repeated rows count each time; an empty table gives no
rows; only ``text`` is read, so nulls and clashing names elsewhere do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read
from .tokens import RANKS, encoder, token_ids

BAND = 4096  # lengths summed in one group before the groups are summed


def lengths(docs: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    """``docs`` with a column n_tokens."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(vocabulary)
        for texts in parts:
            yield pd.Series([len(token_ids(coder, t)) for t in texts], dtype="int64")

    return docs.withColumn("n_tokens", F.pandas_udf(run, "long")(F.col("text").cast("string")))


def histogram(docs: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    """(n_tokens, n_docs), one row per length that occurs."""
    return lengths(docs.select("text"), vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length as a context limit.

    docs_at_least and tokens_at_least cover documents of that length or more; docs_over are strictly
    longer; tokens_kept is the total after truncating each document to the limit, tokens_lost the
    rest; share_fitting is the share of documents no longer than the limit.
    """
    rows = hist.withColumn("band", F.floor(F.col("n_tokens") / BAND)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    longest_first = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # a row per band only
    every = Window.partitionBy()
    bands = rows.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    bands = bands.select("band", F.coalesce(F.sum("d").over(longest_first), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(longest_first), F.lit(0)).alias("t_above"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"))
    inside = Window.partitionBy("band").orderBy(F.desc("n_tokens"))
    out = rows.join(bands, "band")
    out = out.withColumn("docs_at_least", F.col("d_above") + F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.col("t_above") + F.sum("tokens").over(inside))
    out = out.withColumn("tokens_kept", F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least"))
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("docs_at_least") - F.col("n_docs")).alias("docs_over"),
        "tokens_kept",
        (F.col("all_tokens") - F.col("tokens_kept")).alias("tokens_lost"),
        (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("all_docs")).alias("share_fitting"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_over, tokens_kept) of any context limits, from the suffix sums of the next longer length."""
    longer = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("n_tokens") > x, F.col("n_tokens"))) for x in limits]
    one = sums.agg(F.coalesce(F.max(F.col("tokens_kept") + F.col("tokens_lost")), F.lit(0)).alias("total"), *(c.alias(f"m{i}") for i, c in enumerate(longer)))
    answers = []
    for i, limit in enumerate(limits):
        docs, tokens = F.coalesce(F.col(f"m{i}.docs_at_least"), F.lit(0)), F.coalesce(F.col(f"m{i}.tokens_at_least"), F.lit(0))
        answers.append(F.struct(F.lit(int(limit)).cast("long").alias("limit"), docs.alias("docs_over"), (F.col("total") - tokens + F.lit(int(limit)) * docs).alias("tokens_kept")))
    return one.select(F.explode(F.array(*answers)).alias("a")).select("a.*")


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """(n_tokens) the shortest length that at least this share of the documents do not exceed."""
    return sums.where(F.col("share_fitting") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = Scratch(spark, "lengths").write(histogram(read(spark, sf_dir, "documents")))  # read twice, encoded once
    return suffix_sums(counted)
