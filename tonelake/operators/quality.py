"""Auditing episodes of labelled chunks by the error rate of a sample, and pruning the bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import band
from ..sources.io import stored

#: Drawn ids that may be broadcast; above it both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def hash_order(seed: int, key: str) -> Column:
    """An order that looks random and is the same on every engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_per_episode(chunks: DataFrame, episode: str, chunk: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` chunks of each episode. They are drawn from ids alone, so neither text nor audio is sorted; chunk ids must be distinct."""
    rank = F.row_number().over(Window.partitionBy(episode).orderBy(hash_order(seed, chunk), chunk))
    drawn = stored(chunks.select(episode, chunk).withColumn("__rank", rank).where(F.col("__rank") <= n).select(chunk))
    return chunks.join(F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn, chunk, "left_semi").select(*chunks.columns)


def audible(chunks: DataFrame, wpm: str, above: float = 5.0) -> DataFrame:
    """Chunks that an audit can judge: very slow ones have stretched gaps, which no decoder reads well. An unknown speed stays."""
    return chunks.where(F.col(wpm).isNull() | (F.col(wpm) > above))


def audit_episodes(scored: DataFrame, episode: str, cer: str = "cer", bad_above: float = 0.5) -> DataFrame:
    """Mean, median and share of bad chunks; a chunk whose decoding failed (null) counts as wholly wrong."""
    c = F.coalesce(F.col(cer), F.lit(1.0))
    got = scored.groupBy(episode).agg(F.count("*").alias("n"), F.avg(c).alias("avg_cer"), F.median(c).alias("median_cer"), F.avg((c > bad_above).cast("double")).alias("bad_share"))
    return got.withColumn("rating", band(F.col("avg_cer"), "audit"))


def audit_categories(episodes: DataFrame, category: Column, bad_above: float = 0.5) -> DataFrame:
    """Mean of episode means and number of bad episodes for each category."""
    return episodes.groupBy(category.alias("category")).agg(F.count("*").alias("episodes"), F.avg("avg_cer").alias("avg_cer"), F.count_if(F.col("avg_cer") >= bad_above).alias("bad_episodes"))


def prune(chunks: DataFrame, episodes: DataFrame, episode: str, above: float = 0.6) -> DataFrame:
    """Chunks whose episode's mean is not above the limit; a new table, nothing is deleted in place."""
    return chunks.join(episodes.where(F.col("avg_cer") > above).select(episode), episode, "left_anti")
