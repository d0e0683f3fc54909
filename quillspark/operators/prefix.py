"""Prefix postings: the best tokens of every indexed prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildConfig
from ..functions.text import clamp16, quantise


def _blend(count: float, freq: float, entropy: float, specific: float):
    return count * F.log(F.col("unigram_count") + 1.0) + freq * F.log(F.col("segment_freq") + 1.0) + entropy * F.col("entropy") + specific * F.col("specificity")


def prefixes_of(token, longest: int):
    return F.transform(F.sequence(F.lit(1), F.least(F.length(token), F.lit(longest))), lambda n: F.substring(token, F.lit(1), n))


def prefix_postings(stats: DataFrame, cfg: BuildConfig) -> DataFrame:
    """(prefix, rank, token_id, token, score): the order and the stored score weigh the same features differently."""
    scored = stats.select("token_id", "token", quantise(_blend(0.45, 0.20, 0.20, 0.15)).alias("q"), clamp16(quantise(_blend(0.40, 0.20, 0.20, 0.20))).alias("score"))
    flat = scored.select("*", F.explode(prefixes_of(F.col("token"), cfg.max_indexed_prefix_chars)).alias("prefix"))
    best = Window.partitionBy("prefix").orderBy(F.col("q").desc(), "token_id")
    return flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.top_tokens_per_prefix).select("prefix", "rank", "token_id", "token", "score")
