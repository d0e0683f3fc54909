"""The index: a set of tables compiled from documents, saved as Parquet with a manifest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BuildConfig, build_config, to_dict
from ..functions.text import segments as cut_segments
from ..operators import context, ngrams, phrases as mining, prefix, vocab as voc, windows
from ..session import bounded, dense_ids, kept, scratch, small, spread, tidy, written

FORMAT = 1
TABLES = ("vocab", "bigrams", "phrases", "postings", "context", "support")


@dataclass
class BuildStats:
    doc_count: int
    segment_count_pre_prune: int
    token_pos_pre_prune: int
    segment_count_post_prune: int
    token_pos_post_prune: int
    vocab_size: int
    pruned_type_count: int
    phrase_count: int | None = None


class Steps(dict):
    """Values that are made when they are first asked for."""

    def __init__(self, makers: dict[str, Callable[[], Any]]):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> Any:
        self[name] = value = self.makers[name]()
        return value

    def all(self) -> dict[str, Any]:
        return {name: self[name] for name in self.makers}


@dataclass
class Index:
    """Tables by name, the totals of the Kneser-Ney model, and row counts."""

    config: BuildConfig
    tables: dict[str, DataFrame]
    totals: dict[str, int]
    rows: dict[str, int]
    stats: BuildStats | None = None
    #: The steps that it came from; None for a loaded one.
    build: Any = field(default=None, repr=False)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @property
    def spark(self) -> SparkSession:
        return self.tables["vocab"].sparkSession

    @property
    def metadata(self) -> dict[str, int]:
        """Sizes of the vocabulary, the phrase lexicon, the prefix map and the context graph."""
        return {"vocab_size": self.rows["vocab"], "phrase_count": self.rows["phrases"], "prefix_count": self["postings"].select("prefix").distinct().count(), "context_count": self.rows["context"]}

    def prefix_blocks(self) -> DataFrame:
        """(block_id, prefix): prefixes in order."""
        from ..session import dense_ids

        return dense_ids(self["postings"].select("prefix").distinct(), [F.col("prefix").asc()], "block_id")


def with_scorer_ids(stats: DataFrame, lowercase: bool) -> DataFrame:
    """``stats`` with lid, the id that the scorer, which lower-cases its input, sees for a token."""
    if lowercase:
        return stats.withColumn("lid", F.col("token_id"))
    low = stats.select(F.col("token").alias("_low"), F.col("token_id").alias("lid"))
    return stats.withColumn("_low", F.lower("token")).join(low, "_low", "left").drop("_low")


class _Build:
    """The steps from documents to the tables of an index; each is taken once, when something needs it."""

    def __init__(self, docs: DataFrame, cfg: BuildConfig):
        self.cfg, self.spark = cfg, docs.sparkSession
        n_docs = docs.count()
        if not n_docs:
            raise ValueError("there are no documents to build from")
        with scratch(self.spark):
            seg = written(cut_segments(spread(docs, "doc_ord"), cfg.normalization), "segments")
            n_seg, n_tok = voc.corpus_totals(seg)
            if not n_tok:
                raise ValueError("the documents hold no usable tokens")
            counts = written(voc.token_counts(seg), "token-counts")
            types = counts.count()
            rule = voc.keep_token(cfg, n_seg, n_tok)
            self.vocab = kept(voc.vocabulary(counts if rule is None else counts.where(rule)), "vocab")
            self.n_vocab = self.vocab.count()
            if not self.n_vocab:
                raise ValueError("pruning leaves no tokens")
            # What decides between a broadcast and a shuffle of the vocabulary: its entries, and the bytes of its tokens.
            self.v = bounded(self.n_vocab, self.vocab.agg(F.sum(F.octet_length("token").cast("long"))).first()[0] or 0)
            self.ids = kept(voc.encode_segments(seg, self.vocab, self.n_vocab), "encoded")
        tidy(self.spark)
        seg_post, self.tokens = (n_seg, n_tok) if rule is None else voc.corpus_totals(self.ids, "ids")
        self.built = BuildStats(n_docs, n_seg, n_tok, seg_post, self.tokens, self.n_vocab, types - self.n_vocab)

    @cached_property
    def places(self) -> tuple[DataFrame, ngrams.Order]:
        return windows.placed(self.ids)

    @cached_property
    def first_pairs(self) -> DataFrame:
        made = kept(windows.pair_counts(*self.places), "bigrams")
        tidy(self.spark)
        return made

    @property
    def pairs(self) -> DataFrame:
        return self.first_pairs.select("left", "right", "c")

    @cached_property
    def counted(self) -> tuple[DataFrame, dict[str, int]]:
        stats, totals = ngrams.token_stats(self.vocab, self.pairs)
        return kept(with_scorer_ids(stats, self.cfg.normalization.lowercase), "token-stats"), totals

    @property
    def stats(self) -> DataFrame:
        return self.counted[0]

    def grams(self, longest: int, before: int, made: tuple, name: str, write: Callable | None, phrases: DataFrame | None = None) -> DataFrame:
        return windows.by_part(*self.places, self.tokens, longest, before, *made, name, phrases, write)

    @cached_property
    def likely(self) -> DataFrame:
        """N-grams that have the quality of a phrase, with what the other tests look at."""
        cfg, sc = self.cfg, self.spark.sparkContext
        facts = self.vocab.select("token_id", "unigram_count", mining.weak_boundary(F.col("token")).alias("weak")).toArrow()
        counts, weak = np.zeros(self.n_vocab, np.int64), np.zeros(self.n_vocab, bool)
        at = facts["token_id"].to_numpy()
        counts[at], weak[at] = facts["unigram_count"].to_numpy(), facts["weak"].to_numpy()
        # The driver's copies of the broadcasts stay as long as the tables are made.
        made = windows.likely_grams(cfg, self.tokens, sc.broadcast(counts), sc.broadcast(weak), self.places[1].bits[2], cfg.phrase_min_count)
        return self.grams(max(2, cfg.phrase_max_len) + 1, 1, made, "phrase-candidates", kept)

    @property
    def candidates(self) -> DataFrame:
        return self.likely.where((F.col("pmi") >= float(self.cfg.phrase_min_pmi)) & (~F.col("weak") | (F.col("c") >= self.cfg.phrase_boundary_generic_min_count)))

    @cached_property
    def phrases(self) -> DataFrame:
        cfg = self.cfg
        self.stats  # before the candidates, so that its shuffles are gone by then
        rows = self.candidates.where(F.col("segments") >= cfg.phrase_min_doc_freq)
        if cfg.phrase_max_dominant_extension_ratio < 1:
            rows = rows.where(F.col("most") / F.col("c") <= float(cfg.phrase_max_dominant_extension_ratio))
        with scratch(self.spark):
            rows = rows.select(F.col("gram").alias("token_ids"), "n", "c", "pmi", "next")
            ids = dense_ids(rows, [F.col("c").desc(), F.col("n").asc(), F.col("token_ids").asc()], "phrase_id").withColumn("phrase_id", F.col("phrase_id").cast("int"))
            names = self.stats.select("token_id", "token", "followers")
            flat = ids.select("phrase_id", F.posexplode("token_ids").alias("pos", "token_id")).join(small(names, self.v), "token_id")
            words = flat.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "followers"))).alias("x")).select("phrase_id", F.col("x.token").alias("words"), F.col("x")[0]["followers"].alias("followers"))
            branching = F.log(F.coalesce("next", "followers") + 1.0).alias("branching")  # a head of one token has its followers
            return kept(ids.join(words, "phrase_id").select("phrase_id", "token_ids", "n", "c", "pmi", branching, "words", F.length(F.array_join("words", " ")).alias("display_length_chars")), "phrases")

    @cached_property
    def n_phrases(self) -> tuple[int, int]:
        n, chars = self.phrases.agg(F.count("*"), F.coalesce(F.sum("display_length_chars"), F.lit(0))).first()
        self.built.phrase_count = n
        return n, bounded(n, 4 * chars)

    @cached_property
    def postings(self) -> DataFrame:
        return kept(prefix.prefix_postings(self.stats, self.cfg), "postings")

    def next_tokens(self, write: Callable | None = None) -> DataFrame:
        """Edges to tokens; unless they are to be written, they are made where they are read."""
        cfg, raw = self.cfg, context.pair_edges(self.first_pairs, self.cfg)
        longest = cfg.max_context_tokens + 1
        if longest > 2:
            raw = raw.unionByName(self.grams(longest, 0, windows.token_edges(longest, cfg.top_next_tokens), "token-edges", write))
        return context.token_edges(raw, self.stats, self.v)

    @cached_property
    def token_edges(self) -> DataFrame:
        return self.next_tokens(kept)

    @cached_property
    def phrase_edges(self) -> DataFrame:
        cfg = self.cfg
        with scratch(self.spark):
            longest = max(2, cfg.phrase_max_len) + 1
            found = self.grams(longest, max(1, cfg.max_context_tokens), windows.phrase_edges(cfg), "phrase-places", written, self.phrases)
            return kept(context.phrase_edges(found, self.phrases, self.n_phrases[1], cfg), "phrase-edges")

    @cached_property
    def context(self) -> DataFrame:
        return kept(context.edges_for_serving(self.token_edges, self.phrase_edges, self.phrases, self.stats, self.pairs, self.v, self.n_phrases[1], self.counted[1]), "context")

    @cached_property
    def support(self) -> DataFrame:
        return kept(context.pair_edges(self.first_pairs, self.cfg).select(F.col("key")[0].alias("left"), F.col("target_id").alias("right")), "support")

    def known(self, keys: DataFrame, most: int) -> DataFrame:
        """Those of the distinct ``keys`` that the context graph has, whose rows needn't be made for that: an edge is an n-gram."""
        if "context" in self.__dict__:
            return self.context.select("key").join(keys, "key", "left_semi")
        return windows.known_keys(*self.places, keys, self.cfg.max_context_tokens, most)

    def index(self) -> Index:
        tables = Steps({"vocab": lambda: self.stats, "bigrams": lambda: self.pairs, "phrases": lambda: self.phrases, "postings": lambda: self.postings, "context": lambda: self.context, "support": lambda: self.support})
        totals = Steps({n: lambda n=n: self.counted[1][n] for n in ("tokens", "types", "pairs")})
        rows = {"vocab": lambda: self.n_vocab, "phrases": lambda: self.n_phrases[0], "vocab_join": lambda: self.v} | {n: lambda n=n: tables[n].count() for n in ("bigrams", "postings", "context", "support")}
        return Index(self.cfg, tables, totals, Steps(rows), self.built, build=self)


def plan_index(docs: DataFrame, config: BuildConfig | None = None) -> Index:
    """The index of ``docs`` (doc_ord, text), whose tables are made when they are first asked for; every table is computed from all documents."""
    return _Build(docs, config or BuildConfig()).index()


def compile_index(docs: DataFrame, config: BuildConfig | None = None) -> Index:
    """``plan_index`` with all its tables made."""
    ix = plan_index(docs, config)
    return Index(ix.config, ix.tables.all(), ix.totals.all(), ix.rows.all(), ix.stats, build=ix.build)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs, jvm = _fs(spark, path)
    out = fs.create(p, True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs, jvm = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except Exception as e:  # a checksum that doesn't match, for one
        raise ValueError(f"{path} can't be read: {e}") from e


def index_bytes(index: Index) -> dict[str, int]:
    """Bytes of the files of each table."""
    out = {}
    for name in TABLES:
        out[name] = 0
        for uri in index[name].inputFiles():
            p, fs, _ = _fs(index.spark, uri)
            out[name] += fs.getFileStatus(p).getLen()
    return out


def remove(spark: SparkSession, path: str) -> None:
    p, fs, _ = _fs(spark, path)
    fs.delete(p, True)


def read_table(spark: SparkSession, path: str, rows: int | None) -> DataFrame:
    """A Parquet table of ``rows`` rows; a missing one raises FileNotFoundError, a damaged one ValueError. All columns of all rows are read for that."""
    p, fs, _ = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    try:
        table = spark.read.parquet(path)
        found = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*table.columns).bitwiseAND(1)).alias("h")).first()["n"]
    except Exception as e:
        raise ValueError(f"{path} can't be read: {e}") from e
    if found != rows:
        raise ValueError(f"{path} has {found} rows; the manifest says {rows}")
    return table


def save_index(index: Index, path: str, extra: dict | None = None) -> None:
    """Writes the tables below ``path``; the manifest comes last, so a folder without one was never finished."""
    path = path.rstrip("/")
    remove(index.spark, f"{path}/manifest.json")  # what it vouches for is about to change
    for name in TABLES:
        df = index[name]
        if name == "postings":
            df = df.repartitionByRange("prefix").sortWithinPartitions("prefix", "rank")
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"format": FORMAT, "build": to_dict(index.config), "totals": index.totals, "rows": index.rows, "metadata": index.metadata} | (extra or {})
    write_text(index.spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))


def load_index(spark: SparkSession, path: str) -> tuple[Index, dict]:
    """Reads a saved index; a missing one raises FileNotFoundError, a damaged one ValueError."""
    path = path.rstrip("/")
    try:
        manifest = json.loads(read_text(spark, f"{path}/manifest.json"))
        version, rows, totals = manifest["format"], manifest["rows"], manifest["totals"]
        config = build_config(manifest["build"])
    except (json.JSONDecodeError, KeyError, TypeError) as e:
        raise ValueError(f"the manifest of {path} is damaged: {e}") from e
    if version != FORMAT:
        raise ValueError(f"{path} has format {version}; this is format {FORMAT}")
    tables = {name: read_table(spark, f"{path}/{name}", rows.get(name)) for name in TABLES}
    return Index(config, tables, totals, rows), manifest
