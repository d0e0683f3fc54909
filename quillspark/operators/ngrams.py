"""N-gram counts, and the token statistics that follow from bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_FLOOR = 1e-12
DISCOUNT = 0.75


class Order:
    """Corpus positions (doc_ord, seg_no, pos) packed into one long that sorts alike, if their ranges fit into 63 bits (``windows.placed`` sees to that)."""

    def __init__(self, segments: DataFrame):
        r = segments.agg(F.min("doc_ord").alias("lo"), F.max("doc_ord").alias("hi"), F.max("seg_no").alias("s"), F.max(F.size("ids")).alias("p")).first()
        self.low = r["lo"] or 0
        self.bits = [max(1, int(x).bit_length()) for x in ((r["hi"] or 0) - self.low, r["s"] or 0, r["p"] or 0)]

    def unpacked(self, at: Column) -> list[Column]:
        _, b1, b2 = self.bits
        seg, pos = F.shiftright(at, b2).bitwiseAND((1 << b1) - 1), at.bitwiseAND((1 << b2) - 1)
        return [(F.shiftright(at, b1 + b2) + self.low).alias("doc_ord"), seg.cast("int").alias("seg_no"), pos.cast("int").alias("pos")]


def entropy(pairs: DataFrame) -> DataFrame:
    """(left, entropy, followers): entropy of the next token, and distinct next tokens."""
    p = F.col("c") / F.sum("c").over(Window.partitionBy("left"))
    return pairs.select("left", p.alias("p")).groupBy("left").agg(F.sum(-F.col("p") * F.log(F.col("p") + LOG_FLOOR)).alias("entropy"), F.count("*").alias("followers"))


def token_stats(vocab: DataFrame, pairs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """``vocab`` with entropy, followers, continuations and specificity; the totals of the Kneser-Ney model."""
    total = pairs.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"), F.count("*").alias("b")).first()
    words = vocab.agg(F.coalesce(F.sum("unigram_count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    before = pairs.groupBy("right").agg(F.count("*").alias("continuations"))
    out = (
        vocab.join(entropy(pairs).withColumnRenamed("left", "token_id"), "token_id", "left")
        .join(before.withColumnRenamed("right", "token_id"), "token_id", "left")
        .fillna(0, ["followers", "continuations"]).fillna(0.0, ["entropy"])
        .withColumn("specificity", -F.log((F.col("continuations") + 1.0) / (F.lit(max(1, total["t"])) + 1.0)))
    )
    return out, {"tokens": words["n"] or 1, "types": max(1, words["v"]), "pairs": max(1, total["b"])}


# Interpolated Kneser-Ney terms; counts of unknown tokens are null.


def unigram_p(count: Column, totals: dict[str, int]) -> Column:
    return F.when(count > 0, count / F.lit(float(totals["tokens"]))).otherwise(1.0 / (totals["tokens"] + totals["types"]))


def continuation_p(continuations: Column, totals: dict[str, int]) -> Column:
    return F.when(continuations > 0, continuations / F.lit(float(totals["pairs"]))).otherwise(1.0 / (totals["pairs"] + totals["types"]))


def bigram_p(pair: Column, left_count: Column, left_followers: Column, continuations: Column, totals: dict[str, int]) -> Column:
    """P(token | left); without a count of ``left`` the continuation probability alone."""
    cont = continuation_p(continuations, totals)
    seen = F.greatest(F.coalesce(pair, F.lit(0)) - DISCOUNT, F.lit(0.0)) / left_count + DISCOUNT * F.coalesce(left_followers, F.lit(0)) / left_count * cont
    return F.when(left_count > 0, seen).otherwise(cont)


def log_p(p: Column) -> Column:
    return F.log(p + LOG_FLOOR)
