"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned from labelled documents: words whose presence goes with the label far beyond
chance. Each document then has dense features (densities of lexicon words, how near they stand to
the second person, capitals, punctuation, obfuscated spelling), boosted trees score them, and
isotonic regression on out-of-fold scores turns the score into a probability. Scoring is one
map over the documents, without a shuffle; the model that travels is a few kilobytes.

Defined results: a null, empty or wordless text has the features of an empty text and is never
toxic; rows with a null doc_id are scored like any other; repeated rows give repeated results;
whole texts are read, however long; an empty table gives an empty result; without labels of both
classes nothing is toxic; extra columns are ignored (``toxicity``) or kept (``drop_toxic``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import Words, counts, hash_words, member, sums, words
from .trees import Boosted, Isotonic, fit_boosted, fit_isotonic
from .work import labelled, scratch

SECOND_PERSON = "you your yours yourself u ur ya du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros".split()
SEEDS = "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown dumb retard bitch bastard asshole fuck fucking shit whore slut kill hate ugly filth vermin imbecile".split()
NEAR = 5
FEATURES = ("lexicon density", "lexicon hits", "strongest hit", "seed density", "hits near the second person", "second person density", "capital letters", "capital words", "exclamation", "question", "punctuation", "repeated punctuation", "obfuscated words", "obfuscated hits", "stretched letters", "log words")

_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$!", b"oieastasi"):
    _LEET[_a] = _b
_ODD = np.zeros(256, bool)
_ODD[[*b"0134579@$!*"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


@dataclass
class Lexicon:
    hash: np.ndarray
    weight: np.ndarray


@dataclass
class ToxicModel:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def probability(self, x: np.ndarray) -> np.ndarray:
        p = np.clip(self.calibration(self.trees.raw(x)), 0, 1)
        p[x[:, -1] == 0] = 0
        return p


def _obfuscated(w: Words) -> tuple[np.ndarray, list[str]]:
    """Documents and plain spellings of words that hold a digit or sign between letters."""
    raw = w.raw
    if len(raw) < 3:
        return np.zeros(0, np.int64), []
    at = np.flatnonzero(_ODD[raw[1:-1]] & _LETTER[raw[:-2]] & (_LETTER[raw[2:]] | _ODD[raw[2:]])) + 1
    if not len(at):
        return np.zeros(0, np.int64), []
    inside = _LETTER[raw] | _ODD[raw] | (raw >= 128)
    stop = np.flatnonzero(~inside)
    doc = np.searchsorted(w.at, at, "right") - 1
    k = np.searchsorted(stop, at)
    lo = np.where(k > 0, stop[np.maximum(k - 1, 0)] + 1, 0) if len(stop) else np.zeros(len(at), np.int64)
    hi = np.where(k < len(stop), stop[np.minimum(k, len(stop) - 1)], len(raw)) if len(stop) else np.full(len(at), len(raw))
    lo, hi = np.maximum(lo, w.at[doc]), np.minimum(hi, w.at[doc + 1])
    _, one = np.unique(lo, return_index=True)
    text = _LEET[w.low].tobytes()
    out = [text[lo[i] : hi[i]].rstrip(b"*!").replace(b"*", b"").decode("utf-8", "ignore") for i in one]
    return doc[one], out


def features(w: Words, lexicon: Lexicon, seeds: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each document of the chunk."""
    x = np.zeros((w.n, len(FEATURES)))
    size = np.maximum(np.diff(w.at), 1)
    n = np.diff(w.first)
    per = np.maximum(n, 1)
    k = member(w.hash, lexicon.hash)
    hit = k >= 0
    p = np.flatnonzero(hit)
    found = counts(hit, w.first)
    x[:, 0] = found / per
    x[:, 1] = np.log1p(found)
    if len(p):
        np.maximum.at(x[:, 2], w.doc[p], lexicon.weight[k[p]])
    x[:, 3] = counts(member(w.hash, seeds) >= 0, w.first) / per
    you = np.flatnonzero(member(w.hash, second) >= 0)
    if len(p) and len(you):
        j = np.searchsorted(you, p)
        a, b = you[np.maximum(j - 1, 0)], you[np.minimum(j, len(you) - 1)]
        near = ((np.abs(a - p) <= NEAR) & (w.doc[a] == w.doc[p])) | ((np.abs(b - p) <= NEAR) & (w.doc[b] == w.doc[p]))
        x[:, 4] = np.bincount(w.doc[p[near]], minlength=w.n) / np.maximum(found, 1)
    x[:, 5] = (np.searchsorted(you, w.first[1:]) - np.searchsorted(you, w.first[:-1])) / per
    upper = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(_UPPER[w.raw], out=upper[1:])
    x[:, 6] = (upper[w.at[1:]] - upper[w.at[:-1]]) / size
    long = w.end - w.start
    x[:, 7] = sums(((upper[w.end] - upper[w.start]) == long) & (long > 1), w.first) / per
    x[:, 8] = counts(w.raw == 33, w.at) / size
    x[:, 9] = counts(w.raw == 63, w.at) / size
    mark = _PUNCT[w.raw]
    x[:, 10] = counts(mark, w.at) / size
    if len(w.raw) > 2:
        same = w.raw[1:] == w.raw[:-1]
        twice = np.zeros(len(w.raw), bool)
        twice[1:] = same & mark[1:]
        x[:, 11] = counts(twice, w.at) / size
        thrice = np.zeros(len(w.raw), bool)
        thrice[2:] = same[1:] & same[:-1] & _LETTER[w.raw[2:]]
        x[:, 14] = counts(thrice, w.at) / per
    doc, plain = _obfuscated(w)
    if len(doc):
        x[:, 12] = np.bincount(doc, minlength=w.n) / per
        h = hash_words(plain)
        bad = (member(h, lexicon.hash) >= 0) | (member(h, seeds) >= 0)
        x[:, 13] = np.log1p(np.bincount(doc[bad], minlength=w.n))
    x[:, 15] = np.log1p(n)
    return x


def _word_sets() -> tuple[np.ndarray, np.ndarray]:
    return np.sort(hash_words(SEEDS)), np.sort(hash_words(SECOND_PERSON))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, toxic documents, clean documents) of each batch."""
    for b in batches:
        y = b.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        hs, ys = [], []
        for w in words(b.column("text")):
            key = np.unique(np.stack([w.doc.astype(np.uint64), w.hash], 1), axis=0) if len(w.hash) < 2 else _distinct(w)
            hs.append(key[:, 1])
            ys.append(y[w.lo + key[:, 0].astype(np.int64)])
        h, t = np.concatenate(hs or [np.zeros(0, np.uint64)]), np.concatenate(ys or [np.zeros(0, np.int64)])
        u, inv = np.unique(h, return_inverse=True)
        bad = np.bincount(inv, t, len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(bad), pa.array(np.bincount(inv, minlength=len(u)) - bad)], names=["h", "bad", "good"])


def _distinct(w: Words) -> np.ndarray:
    order = np.lexsort((w.hash, w.doc))
    d, h = w.doc[order], w.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.stack([d[new].astype(np.uint64), h[new]], 1)


def _learn_lexicon(sample: DataFrame, bad: int, good: int, least: float) -> Lexicon:
    """Words with a log-likelihood ratio of at least ``least`` for standing in toxic documents."""
    total, rate = bad + good, bad / max(1, bad + good)
    n = F.col("bad") + F.col("good")
    # Both terms of the ratio for presence; a null logarithm (no clean document) counts as nothing.
    ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (n * rate)) + F.coalesce(F.col("good") * F.log(F.col("good") / (n * (1 - rate))), F.lit(0.0)))
    rows = (
        sample.select("text", "toxic").mapInArrow(_presence, "h long, bad long, good long")
        .groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where((F.col("bad") >= 3) & (F.col("bad") / n > F.lit(max(0.5, min(0.9, 3 * rate)))) & (ratio >= least))
        .toPandas()
    ) if bad and good else None
    if rows is None or not len(rows):
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    h = rows["h"].to_numpy().view(np.uint64)
    b, g = rows["bad"].to_numpy(), rows["good"].to_numpy()
    weight = np.log((b + 0.5) / (bad + 1)) - np.log((g + 0.5) / (good + 1))
    order = np.argsort(h)
    return Lexicon(h[order], weight[order])


def fit_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 60, least: float = 20.0) -> ToxicModel:
    """Learns from at most ``sample`` labelled documents (the bound that keeps training on the driver)."""
    with scratch(spark):
        rows = labelled(spark, docs, labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), sample)
        got = {r["toxic"] > 0: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        lexicon = _learn_lexicon(rows.withColumn("toxic", (F.col("toxic") > 0).cast("int")), got.get(True, 0), got.get(False, 0), least)
        seeds, second = _word_sets()

        def measure(batches):
            for b in batches:
                parts = [features(w, lexicon, seeds, second) for w in words(b.column("text"))]
                x = np.concatenate(parts or [np.zeros((0, len(FEATURES)))])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "toxic", "h")), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "h", "x"])

        table = rows.withColumn("h", F.xxhash64("text")).mapInArrow(measure, "doc_id long, toxic int, h long, x array<double>").toPandas().sort_values(["doc_id", "h"], kind="stable")
    x = np.array(table["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = (table["toxic"].to_numpy() > 0).astype(float)
    model = fit_boosted(x, y, trees)
    out = np.zeros(len(y))
    folds = np.arange(len(y)) % 3
    for k in range(3):
        out[folds == k] = fit_boosted(x[folds != k], y[folds != k], trees).raw(x[folds == k])
    return ToxicModel(lexicon, model, fit_isotonic(out, y))


def _score(batch: pa.RecordBatch, model: ToxicModel, sets) -> np.ndarray:
    parts = [model.probability(features(w, model.lexicon, *sets)) for w in words(batch.column("text"))]
    return np.concatenate(parts or [np.zeros(0)])


def toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, toxicity (probability), toxic (probability of at least ``threshold``) of every row."""
    sets = _word_sets()

    def run(batches):
        for b in batches:
            p = _score(b, model, sets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(p, 6)), pa.array(p >= threshold)], names=["doc_id", "toxicity", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't toxic."""
    sets = _word_sets()

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_score(b, model, sets) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, fit_toxicity(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of ``documents`` (the stage's input may lack some) and drops toxic rows of ``docs``."""
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_toxic(docs, fit_toxicity(spark, source, spark.read.parquet(f"{sf_dir}/labels.parquet")))
