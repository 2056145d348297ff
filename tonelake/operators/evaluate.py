"""Summaries of evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import scan


def summarize_groups(results: DataFrame, bucket: str = "bucket", content: str = "content_type", cer: str = "cer") -> DataFrame:
    """Mean by bucket, by content type and overall, in one pass."""
    got = results.groupingSets([[bucket], [content], []], bucket, content).agg(F.grouping_id().alias("level"), F.avg(cer).alias("cer"), F.count(cer).alias("n"))
    return got.select("level", F.coalesce(bucket, content, F.lit("all")).alias("name"), "cer", "n")


def suite_summary(results: DataFrame, suite: str = "suite", cer: str = "cer") -> DataFrame:
    """Mean of each suite, and over all samples of all suites. Cases without a transcript stay out of both."""
    return results.where(F.col(cer).isNotNull()).rollup(suite).agg(F.avg(cer).alias("cer"), F.count("*").alias("n")).select(F.coalesce(suite, F.lit("all")).alias("name"), "cer", "n")


def fold_summary(results: DataFrame, fold: str = "fold", cer: str = "cer", digits: int = 4) -> DataFrame:
    """Rounded mean of each fold, then the item-weighted mean of those."""
    folds = results.groupBy(fold).agg(F.round(F.avg(cer), digits).alias("cer"), F.count(cer).alias("n"))
    total = folds.agg(F.lit("all").alias(fold), (F.sum(F.col("cer") * F.col("n")) / F.sum("n")).alias("cer"), F.sum("n").alias("n"))
    return folds.unionByName(total)


def run_deltas(runs: DataFrame, suite: str = "suite", ts: str = "ts", metric: str = "cer", same_within: float = 0.001) -> DataFrame:
    """Difference to the run before it of the same suite, which may have any number of runs."""
    rows = scan(runs, suite, ts, {"__before": ("lag", F.col(metric))})
    delta = F.col(metric) - F.col("__before")
    sign = F.when(F.col("__before").isNull(), None).when(F.abs(delta) < same_within, "=").when(delta < 0, "better").otherwise("worse")
    return rows.withColumn("delta", delta).withColumn("change", sign).drop("__before")


def inventory(chunks: DataFrame, dataset: str, source: str) -> DataFrame:
    """Chunks by dataset and source, with totals."""
    return chunks.rollup(dataset, source).agg(F.count("*").alias("chunks")).select(F.coalesce(dataset, F.lit("all")).alias("dataset"), F.coalesce(source, F.lit("all")).alias("source_key"), "chunks")
