"""The Kneser-Ney scorer as a model of its own: counts of tokens and of pairs, merged, saved and applied to any text."""

from __future__ import annotations

import json
from functools import cached_property
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import NormalizationConfig
from ..functions.text import WS, plain, slices, text_tokens, tokens
from .ngrams import bigram_p, log_p, unigram_p
from .rerank import merge_counts

KIND, VERSION = "kneser-ney", 1
#: Tokens whose pairs are counted at once.
PIECE = 1 << 20


class Scorer(Protocol):
    """What ranks suggestions: (prompt_id, score) for texts (prompt_id, text)."""

    def score(self, texts: DataFrame) -> DataFrame: ...


def rescored(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Ranked suggestions with the scores of another scorer in place of their own, ranked anew."""
    texts = rows.select((F.col("prompt_id") * 65536 + F.col("rank")).alias("prompt_id"), "text")
    new = scorer.score(texts).select((F.col("prompt_id") / 65536).cast("long").alias("prompt_id"), (F.col("prompt_id") % 65536).cast("int").alias("rank"), F.col("score").alias("_new"))
    out = rows.join(new, ["prompt_id", "rank"]).withColumn("score", F.col("score") - F.col("breakdown.scorer_score") + F.col("_new"))
    out = out.withColumn("breakdown", F.col("breakdown").withField("scorer_score", F.col("_new")).withField("final_score", F.col("score")))
    order = Window.partitionBy("prompt_id").orderBy(F.col("score").desc(), "text")
    return out.withColumn("rank", F.row_number().over(order)).select(*rows.columns)


class KneserNey:
    """``unigrams`` (token, c) and ``bigrams`` (left, right, c) of lines of lower-cased tokens."""

    def __init__(self, unigrams: DataFrame, bigrams: DataFrame):
        self.unigrams, self.bigrams = unigrams, bigrams

    @classmethod
    def from_lines(cls, lines: DataFrame) -> KneserNey:
        """``lines``: one column, tok, of arrays of tokens; both tables are counted with a map-side combine."""
        low = lines.select(F.transform("tok", F.lower).alias("t"))
        pair = lambda i: F.struct(F.element_at("t", i).alias("left"), F.element_at("t", i + 1).alias("right"))
        pairs = low.where(F.size("t") >= 2).select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - 1, F.lit(1))), pair)).alias("p"))
        count = F.count("*").alias("c")
        return cls(low.select(F.explode("t").alias("token")).groupBy("token").agg(count), pairs.groupBy("p.left", "p.right").agg(count))

    @classmethod
    def from_texts(cls, texts: DataFrame, cfg: NormalizationConfig) -> KneserNey:
        """``texts``: one column, text, each a line. Tokens are cut and their pairs counted, a piece at a time, in one pass over plain strings."""
        texts = texts.where("text IS NOT NULL")
        if not (plain(cfg) and cfg.lowercase):
            return cls.from_lines(texts.select(tokens(F.col("text"), cfg).alias("tok")))

        def pieces(batches):
            cut = text_tokens(cfg, False)
            held, n = [], 0
            for b in batches:
                for x in slices(b):
                    held.append(cut(x.column("text")))
                    n += len(held[-1].values)
                    if n >= PIECE:
                        yield held
                        held, n = [], 0
            if held:
                yield held

        def coded(held):
            c = pa.concat_arrays([t.values for t in held]).dictionary_encode()
            return c.dictionary.cast(pa.string()), c.indices.to_numpy().astype(np.int64)

        def ones(batches):
            for held in pieces(batches):
                names, code = coded(held)
                yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(code, minlength=len(names)))], names=["token", "c"])

        def twos(batches):
            for held in pieces(batches):
                names, code = coded(held)
                size = np.concatenate([np.diff(t.offsets) for t in held])
                last = np.zeros(len(code), bool)
                last[np.cumsum(size)[size > 0] - 1] = True
                i = np.flatnonzero(~last)
                key, c = np.unique((code[i] << 32) | code[np.minimum(i + 1, len(code) - 1)], return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(key >> 32)), names.take(pa.array(key & 0xFFFFFFFF)), pa.array(c)], names=["left", "right", "c"])

        count = F.sum("c").alias("c")
        return cls(texts.select("text").mapInArrow(ones, "token string, c long").groupBy("token").agg(count), texts.select("text").mapInArrow(twos, "left string, right string, c long").groupBy("left", "right").agg(count))

    def merge(self, other: KneserNey) -> KneserNey:
        """The model of both corpora, from their counts."""
        return KneserNey(merge_counts(self.unigrams, other.unigrams, ["token"]), merge_counts(self.bigrams, other.bigrams, ["left", "right"]))

    @cached_property
    def totals(self) -> dict[str, int]:
        n, v = self.unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        return {"tokens": n or 1, "types": max(1, v), "pairs": max(1, self.bigrams.count())}

    def score(self, texts: DataFrame) -> DataFrame:
        """(prompt_id, score): ln P of every text, lower-cased and split at white space; 0 for one without words. Whole texts count.

        Each word with the one before it is a pair; equal pairs of a text are one row, and each distinct pair is looked up once, so frequent
        pairs make no hot join keys.
        """
        flat = texts.select("prompt_id", F.filter(F.split(F.lower("text"), rf"[{WS}]+"), lambda w: w != "").alias("t")).where(F.size("t") > 0)
        step = lambda i: F.struct(F.when(i > 1, F.element_at("t", F.greatest(i - 1, F.lit(1)))).otherwise(F.lit("")).alias("left"), F.element_at("t", i).alias("right"))
        steps = flat.select("prompt_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), step)).alias("s")).groupBy("prompt_id", "s.left", "s.right").agg(F.count("*").alias("k"))
        before = self.unigrams.select(F.col("token").alias("left"), F.col("c").alias("lc"))
        after = self.unigrams.select(F.col("token").alias("right"), F.col("c").alias("rc"))
        followers = self.bigrams.groupBy("left").agg(F.count("*").alias("lf"))
        continuations = self.bigrams.groupBy("right").agg(F.count("*").alias("rcont"))
        kinds = steps.select("left", "right").distinct().join(before, "left", "left").join(followers, "left", "left").join(after, "right", "left").join(continuations, "right", "left")
        kinds = kinds.join(self.bigrams.withColumnRenamed("c", "pair"), ["left", "right"], "left")
        p = F.when(F.col("left") == "", unigram_p(F.col("rc"), self.totals)).otherwise(bigram_p(F.col("pair"), F.col("lc"), F.col("lf"), F.col("rcont"), self.totals))
        total = steps.join(kinds.select("left", "right", log_p(p).alias("lp")), ["left", "right"]).groupBy("prompt_id").agg(F.sum(F.col("k") * F.col("lp")).alias("score"))
        return texts.select("prompt_id").join(total, "prompt_id", "left").select("prompt_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def save(self, path: str) -> None:
        """Two Parquet tables, and a manifest that is written last."""
        from ..plans.index import remove, write_text

        remove(self.unigrams.sparkSession, f"{path}/manifest.json")
        for name in ("unigrams", "bigrams"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.unigrams.sparkSession
        rows = {n: spark.read.parquet(f"{path}/{n}").count() for n in ("unigrams", "bigrams")}
        write_text(spark, f"{path}/manifest.json", json.dumps({"kind": KIND, "version": VERSION, "rows": rows}))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KneserNey:
        """A missing model raises FileNotFoundError, one of another kind or damaged ValueError."""
        from ..plans.index import read_table, read_text

        text = read_text(spark, f"{path}/manifest.json")
        try:
            m = json.loads(text)
            kind, version, rows = m["kind"], m["version"], m["rows"]
        except (json.JSONDecodeError, KeyError, TypeError) as e:
            raise ValueError(f"the manifest of {path} is damaged: {e}") from e
        if (kind, version) != (KIND, VERSION):
            raise ValueError(f"{path} holds {kind} {version}, not {KIND} {VERSION}")
        tables = {n: read_table(spark, f"{path}/{n}", rows.get(n)) for n in ("unigrams", "bigrams")}
        for name, columns in (("unigrams", {"token", "c"}), ("bigrams", {"left", "right", "c"})):
            if set(tables[name].columns) != columns:
                raise ValueError(f"table {name} of {path} has the columns {tables[name].columns}")
        return cls(tables["unigrams"], tables["bigrams"])
