"""URL filter: unigram Viterbi word segmentation of hosts, then multinomial naive Bayes over host and path tokens.

Word counts come from the visible text of all pages. For every distinct host, the substrings of its labels are
joined to the counts (by hash, one shuffle; nothing of the corpus is broadcast), and a Viterbi search splits each label into
the most probable words; an unknown piece of length k has the probability 10 / (N * 10**k). The classifier is
multinomial naive Bayes with add-one smoothing, trained on a seed list of labelled names (a parameter) and, where given, on a table of labelled
URLs whose hosts are segmented like all others (``labelled``: url, unwanted; ``sample`` rows of it at most, the first by a hash). It scores the
words of the host and the tokens of the path: log-odds of unwanted against wanted.

Defined results: a null url has null host and score and is not blocked; a url without a scheme has no host and
is scored by its path; equal hosts are split once; of splits with equal probability the one with the
longer last word wins; labels and words may have any length (only substrings as long as some word of the corpus are looked
up); labelled rows with a null url or label are left out; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import hash_words, words
from .work import small, written

#: Seed names: words of unwanted and of ordinary sites, as their owners would write them apart.
#: Written by hand, without regard to the hosts of any table; words they don't have score 0.
SEEDS: list[tuple[str, bool]] = [(x, True) for x in (
    "online casino bonus", "poker slots jackpot", "best betting odds", "sports bet", "lucky spin win", "buy viagra pills", "discount pharmacy pills", "cheap meds", "diet pills", "hot adult cams", "xxx sex videos", "porn tube", "escort girls", "free crack download", "warez keygen", "click ads network", "ad track pixel", "banner ads popup", "spam mail farm", "link farm seo", "payday loans cash", "fast cash win", "make money", "win free phone", "replica watches cheap",
)] + [(x, False) for x in (
    "news today", "daily news", "personal blog", "science journal", "city library", "public school", "university research", "open source software", "code review", "weather report", "health care", "food recipes", "travel guide", "music review", "book store", "history museum", "local government", "sports news", "photo gallery", "web developer docs", "help forum", "garden club", "film archive", "art house", "data portal", "math notes", "wiki pages", "open encyclopedia", "train timetable", "bank branch", "family doctor", "town council", "job offers", "house plans", "recipe book", "language course",
)]
#: Names and paths of either kind hold these; they tell nothing.
NEUTRAL = "www m blog com net org info en fr de es html htm php index page utm source feed ref".split()


def host_of(url: Column) -> Column:
    h = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(h, r"^.*@", ""), r":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""))


def segment(label: str, log_p: dict[str, float], unknown: float) -> list[str]:
    """The most probable split of ``label``; ``unknown``: log-probability of an unknown piece without its length."""
    n = len(label)
    sizes = sorted({len(w) for w in log_p}, reverse=True)
    best = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    run, begin = -math.inf, 0  # the best split that ends in an unknown piece, and where that begins
    for end in range(1, n + 1):
        if best[end - 1] + unknown > run + 1e-12:
            run, begin = best[end - 1] + unknown, end - 1
        run -= math.log(10)
        best[end], back[end] = run, begin
        for size in sizes:
            if size <= end and (p := log_p.get(label[end - size : end])) is not None:
                p += best[end - size]
                if p > best[end] + 1e-12 or (p > best[end] - 1e-12 and end - size < back[end]):
                    best[end], back[end] = p, end - size
    out, end = [], n
    while end:
        out.append(label[back[end] : end])
        end = back[end]
    return out[::-1]


def pieces(host: str) -> list[str]:
    return re.findall(r"[^\W_]+", host)


def _word_counts(batches):
    """(hash, letters, occurrences) of the words of each batch."""
    for b in batches:
        h, size, c = [], [], []
        for w in words(b.column("text")):
            inner = np.concatenate([[0], np.cumsum((w.raw & 0xC0) == 0x80)])  # bytes that go on with a letter
            u, at, n = np.unique(w.hash, return_index=True, return_counts=True)
            h.append(u)
            size.append((w.end - w.start - inner[w.end] + inner[w.start])[at])
            c.append(n)
        h, size, c = (np.concatenate(x or [np.zeros(0, t)]) for x, t in ((h, np.uint64), (size, np.int64), (c, np.int64)))
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(size[at].astype(np.int32)), pa.array(np.bincount(inv, c, len(u)).astype(np.int64))], names=["h", "size", "c"])


def _substrings(batches, sizes: list[int]):
    """The substrings of each host that are as long as some word."""
    for b in batches:
        hosts, subs = [], []
        for host in b.column("host").to_pylist():
            mine = {p[i : i + k] for p in pieces(host) for k in sizes if k <= len(p) for i in range(len(p) - k + 1)}
            hosts += [host] * len(mine)
            subs += sorted(mine)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subs, pa.string()), pa.array(hash_words(subs).view(np.int64))], names=["host", "word", "h"])


class NaiveBayes:
    """Multinomial, add-one smoothing, equal priors: log-odds of unwanted against wanted."""

    def __init__(self, names: list[tuple[list[str], bool]]):
        bad, good = Counter(w for s, y in names if y for w in s), Counter(w for s, y in names if not y for w in s)
        for w in NEUTRAL:
            bad[w] = good[w] = max(bad[w], good[w], 1)
        vocabulary = set(bad) | set(good)
        nb, ng = sum(bad.values()) + len(vocabulary), sum(good.values()) + len(vocabulary)
        self.odds = {w: math.log((bad[w] + 1) / nb) - math.log((good[w] + 1) / ng) for w in vocabulary}
        self.odds |= dict.fromkeys(NEUTRAL, 0.0)

    def score(self, tokens: list[str]) -> float:
        """Tokens that the seeds don't have tell nothing."""
        return sum(self.odds.get(t, 0.0) for t in tokens)


def visible(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")


def segmented_hosts(hosts: DataFrame, texts: DataFrame, seeds: list[tuple[str, bool]]) -> DataFrame:
    """(host, words) of the distinct ``hosts`` (one column), by the word counts of ``texts`` (one column, text) and the seeds."""
    counts = written(texts.mapInArrow(_word_counts, "h long, size int, c long").groupBy("h", "size").agg(F.sum("c").alias("c")), "url-words")
    by_size = counts.groupBy("size").agg(F.sum("c").alias("c")).collect()  # one row for each length of a word
    total, sizes = sum(r["c"] for r in by_size), sorted(r["size"] for r in by_size)
    extra = Counter(w for s, _ in seeds for w in s.split())
    # Seed words count as if the corpus had them once in a hundred thousand words.
    boost = max(1.0, total / 1e5)
    total += boost * sum(extra.values())
    subs = hosts.mapInArrow(lambda it: _substrings(it, sizes), "host string, word string, h long")
    subs = subs.unionByName(hosts.select("host", F.lit("").alias("word"), F.lit(0).cast("long").alias("h")))  # hosts without a substring, too
    known = subs.join(counts.select("h", "c"), "h", "left").groupBy("host").agg(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("word", "c"))).alias("known"))

    own = sorted({len(w) for w in extra})

    def split(batches):
        for b in batches:
            out = []
            for host, known in zip(b.column("host").to_pylist(), b.column("known").to_pylist()):
                log_p = {k["word"]: k["c"] for k in known}
                for w in {p[i : i + k] for p in pieces(host) for k in own for i in range(len(p) - k + 1)} & extra.keys():
                    log_p[w] = log_p.get(w, 0) + boost * extra[w]
                log_p = {w: math.log(c / total) for w, c in log_p.items()}
                out.append([w for p in pieces(host) for w in segment(p, log_p, math.log(10 / max(total, 1)))])
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.list_(pa.string()))], names=["host", "words"])

    return known.mapInArrow(split, "host string, words array<string>")


def url_filter(pages: DataFrame, seeds: list[tuple[str, bool]] = SEEDS, threshold: float = 0.0, labelled: DataFrame | None = None, sample: int = 50_000) -> DataFrame:
    """(page_id, host, host_words, score, blocked) of every page."""
    rows = pages.select(F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = rows.where("host IS NOT NULL").select("host")
    if labelled is not None:
        labelled = labelled.where("url IS NOT NULL AND unwanted IS NOT NULL").orderBy(F.xxhash64("url"), "url").limit(sample)
        labelled = written(labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.col("unwanted").cast("int") > 0).alias("y")), "url-labels")
        hosts = hosts.unionByName(labelled.select("host"))
    split = written(segmented_hosts(hosts.distinct(), pages.where("html IS NOT NULL").select(visible(F.col("html")).alias("text")), seeds), "url-hosts")
    names = [(s.split(), y) for s, y in seeds]
    if labelled is not None:
        names += [(r["words"] + pieces(r["path"]), r["y"]) for r in labelled.join(split, "host").select("words", "path", "y").collect()]
    model = NaiveBayes(names)

    def run(batches):
        for b in batches:
            score = [None if host is None else round(model.score((w or []) + pieces(path)), 6) for host, w, path in zip(b.column("host").to_pylist(), b.column("words").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("words"), pa.array(score, pa.float64()), pa.array([s is not None and s > threshold for s in score])], names=["page_id", "host", "host_words", "score", "blocked"])

    joined = rows.join(small(split, split.count()), "host", "left").select("page_id", "host", "words", "path")
    return joined.mapInArrow(run, "page_id long, host string, host_words array<string>, score double, blocked boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))
