"""Scoring of answers against a benchmark's cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import rules


def plain(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def score(cases: DataFrame) -> DataFrame:
    """Adds refused, answer_correct, citation_correct, passed and what is missing.

    Rows have answer, grounded, sources array<string>, required array<array<string>> (any of each), required_sources
    array<string> and expect_refusal.
    """
    said = plain(F.coalesce("answer", F.lit("")))
    starts = F.lit(False)
    for p in rules.REFUSAL_PREFIXES:
        starts = starts | F.startswith(said, plain(F.lit(p)))
    refused = F.coalesce(~F.col("grounded"), F.lit(False)) | starts
    missing = F.filter("required", lambda any_: ~F.exists(any_, lambda t: F.contains(said, plain(t))))
    expected = F.coalesce("expect_refusal", F.lit(False))
    out = cases.withColumn("refused", refused).withColumn("missing_requirements", missing).withColumn("missing_sources", F.array_except("required_sources", "sources"))
    out = out.withColumn("answer_correct", F.when(expected, F.col("refused")).otherwise(~F.col("refused") & (F.size("missing_requirements") == 0)))
    out = out.withColumn("citation_correct", expected | (F.size("missing_sources") == 0))
    return out.withColumn("passed", F.col("answer_correct") & F.col("citation_correct"))


def summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.count_if("answer_correct").alias("answers_correct"), F.count_if("citation_correct").alias("citations_correct")
    )


def pipeline_stats(log: DataFrame, time: str, ok: Column) -> DataFrame:
    """Totals and averages of a query log, one row."""
    return log.agg(
        F.count("*").alias("total_queries"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col(time))), 6).alias("avg_time")
    )
