"""Context graph: for each history of tokens the next tokens and phrases, most frequent first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BuildConfig
from ..functions.text import clamp16, quantise
from ..session import small
from .ngrams import bigram_p, continuation_p, log_p
from .phrases import quality


def pair_edges(pairs: DataFrame, cfg: BuildConfig) -> DataFrame:
    """(key, rank, target_id, c): the best next tokens after every single token; ``pairs`` with their first places."""
    best = Window.partitionBy("left").orderBy(F.col("c").desc(), F.col("first").asc())
    top = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.top_next_tokens)
    return top.select(F.array("left").alias("key"), "rank", F.col("right").alias("target_id"), "c")


def token_edges(edges: DataFrame, stats: DataFrame, n_vocab: int) -> DataFrame:
    """(key, rank, target_id, c, score)"""
    facts = small(stats.select(F.col("token_id").alias("target_id"), "unigram_count", "entropy", "specificity"), n_vocab)
    score = 0.55 * F.log(F.col("c") + 1.0) + 0.20 * F.log(F.col("unigram_count") + 1.0) + 0.15 * F.col("entropy") + 0.10 * F.col("specificity")
    return edges.join(facts, "target_id").select("key", "rank", "target_id", "c", clamp16(quantise(score)).alias("score"))


def phrase_edges(found: DataFrame, phrases: DataFrame, n_phrases: int, cfg: BuildConfig) -> DataFrame:
    """(key, rank, target_id, c, score); ``found``: (key, phrase_id, c, first, n); ``phrases`` with their branching."""
    best = Window.partitionBy("key").orderBy(F.col("c").desc(), F.col("first").asc(), F.col("n").asc())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cfg.top_next_phrases).drop("n")
    facts = small(phrases.select("phrase_id", quality(F.col("c"), F.col("n")).alias("support"), "branching"), n_phrases)
    score = 0.45 * F.log(F.col("c") + 1.0) + 0.30 * F.col("support") + 0.25 * F.col("branching")
    return top.join(facts, "phrase_id").select("key", "rank", F.col("phrase_id").alias("target_id"), "c", clamp16(quantise(score)).alias("score"))


def kn_model(stats: DataFrame) -> DataFrame:
    """(kid, kc, followers, continuations) by token id."""
    return stats.select(F.col("token_id").alias("kid"), F.col("unigram_count").alias("kc"), F.col("followers").alias("kf"), F.col("continuations").alias("kcont"))


def kn_of_pairs(pairs: DataFrame, stats: DataFrame, bigrams: DataFrame, n_vocab: int, totals: dict[str, int]) -> DataFrame:
    """``pairs`` (columns prev, next: token ids of the scorer, null if unknown, and others) with lp, ln P(next | prev)."""
    left = small(kn_model(stats).select(F.col("kid").alias("prev"), "kc", "kf"), n_vocab)
    right = small(kn_model(stats).select(F.col("kid").alias("next"), F.col("kcont")), n_vocab)
    both = bigrams.select(F.col("left").alias("prev"), F.col("right").alias("next"), F.col("c").alias("kpair"))
    p = bigram_p(F.col("kpair"), F.col("kc"), F.col("kf"), F.col("kcont"), totals)
    return pairs.join(left, "prev", "left").join(right, "next", "left").join(both, ["prev", "next"], "left").withColumn("lp", log_p(p)).drop("kc", "kf", "kcont", "kpair")


def edges_for_serving(tokens: DataFrame, phrases_edges: DataFrame, phrases: DataFrame, stats: DataFrame, bigrams: DataFrame, n_vocab: int, n_phrases: int, totals: dict[str, int]) -> DataFrame:
    """(key, tokens, phrases): one row for each history, its edges in stored order with words, noise and Kneser-Ney terms.

    ``lp``: ln P of the first word after the key's last token; ``lc``: after an unknown token; ``rest``: of the phrase's other words.
    """
    word = stats.select("token_id", "token", "noise", F.col("lid"), log_p(continuation_p(F.col("continuations"), totals)).alias("lc"))
    named = tokens.join(small(word.select(F.col("token_id").alias("target_id"), "token", "noise", F.col("lid").alias("next"), "lc"), n_vocab), "target_id")
    last = small(word.select(F.col("token_id").alias("last_id"), F.col("lid").alias("prev")), n_vocab)
    named = named.withColumn("last_id", F.element_at("key", -1)).join(last, "last_id")
    named = kn_of_pairs(named, stats, bigrams, n_vocab, totals)
    as_token = F.struct("rank", "target_id", "score", F.array("target_id").alias("ids"), F.array("token").alias("words"), F.array("noise").alias("noises"), "lp", "lc", F.array().cast("array<double>").alias("rest"))
    one = named.select("key", F.lit(0).alias("kind"), as_token.alias("e"))

    flat = phrases.select("phrase_id", F.posexplode("token_ids").alias("pos", "token_id")).join(small(word, n_vocab), "token_id")
    parts = flat.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id", "token", "noise", "lid", "lc"))).alias("x"))
    inner = parts.select("phrase_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.struct(F.element_at("x", i)["lid"].alias("prev"), F.element_at("x", i + 1)["lid"].alias("next")))).alias("pos", "y"))
    inner = kn_of_pairs(inner.select("phrase_id", "pos", "y.prev", "y.next"), stats, bigrams, n_vocab, totals)
    rest = inner.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lp"))).alias("r"))
    parts = parts.join(rest, "phrase_id").select(F.col("phrase_id").alias("target_id"), F.col("x.token_id").alias("ids"), F.col("x.token").alias("words"), F.col("x.noise").alias("noises"), F.col("x")[0]["lid"].alias("next"), F.col("x")[0]["lc"].alias("lc"), F.col("r.lp").alias("rest"))
    named = phrases_edges.join(small(parts, n_phrases), "target_id").withColumn("last_id", F.element_at("key", -1)).join(last, "last_id")
    named = kn_of_pairs(named, stats, bigrams, n_vocab, totals)
    two = named.select("key", F.lit(1).alias("kind"), F.struct("rank", "target_id", "score", "ids", "words", "noises", "lp", "lc", "rest").alias("e"))
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("e"))))
    return one.unionByName(two).groupBy("key").agg(pick(0).alias("tokens"), pick(1).alias("phrases"))
