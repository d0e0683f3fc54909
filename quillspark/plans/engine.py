"""The engine: build, serve, save and load, for a caller with a few prompts or a table of them."""

from __future__ import annotations

import dataclasses
import re
import secrets
import warnings
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BuildConfig, SuggestConfig, apply_quality_profile, to_dict
from ..operators import beam
from ..operators.local import FEW, SCHEMA, LocalServer, by_map, words_of
from ..operators.rerank import BaseReranker
from ..operators.scorer import KneserNey, Scorer, rescored
from ..sources.documents import from_items
from .index import BuildStats, Index, compile_index, load_index, save_index

ROOT = ".quillspark_indexes"


def index_path(name: str | Path) -> str:
    """A bare name is a folder below ``ROOT``; anything that looks like a path or a URI is one."""
    s = str(name)
    if isinstance(name, Path) or "/" in s or "\\" in s or s.startswith(("~", ".")) or re.match(r"^[A-Za-z]:", s):
        return s if re.match(r"^[a-z][a-z0-9+.\-]+://", s) else str(Path(s).expanduser().absolute())
    return str((Path(ROOT) / s).absolute())


def fresh_name(root: str | Path = ROOT) -> str:
    """A name not yet taken below ``root``."""
    base = name = f"index-{secrets.token_hex(4)}"
    k = 2
    while (Path(root) / name).exists():
        name, k = f"{base}-{k}", k + 1
    return name


def as_prompts(spark: SparkSession, prompts: DataFrame | str | Iterable[str]) -> DataFrame:
    if isinstance(prompts, DataFrame):
        return prompts
    texts = [prompts] if isinstance(prompts, str) else list(prompts)
    return spark.createDataFrame(list(enumerate(texts)), "prompt_id long, text string")


class Autocomplete:
    """An index with its settings. ``documents``: anything ``from_items`` takes, or a frame (doc_ord, text, ...)."""

    def __init__(self, index: Index, suggest_config: SuggestConfig | None = None, documents: DataFrame | None = None, loaded: bool = False):
        self.index, self.suggest_config, self._documents, self.loaded = index, suggest_config or SuggestConfig(), documents, loaded
        self._local: LocalServer | None = None
        self._asked = False

    @classmethod
    def create(cls, spark: SparkSession, documents: DataFrame | Iterable[Any], build_config: BuildConfig | None = None, suggest_config: SuggestConfig | None = None, quality_profile: str = "balanced", max_generated_words: int | None = None, phrase_min_count: int | None = None) -> Autocomplete:
        build, serve = apply_quality_profile(quality_profile, build_config, suggest_config)
        changes: dict[str, int] = {}
        if max_generated_words is not None:
            changes["max_generated_words"] = max(1, int(max_generated_words))
        if phrase_min_count is not None:
            changes["phrase_min_count"] = max(1, int(phrase_min_count))
        if changes:
            build = dataclasses.replace(build, **changes)
        docs = documents if isinstance(documents, DataFrame) else from_items(spark, documents)
        return cls(compile_index(docs.select("doc_ord", "text"), build), serve, docs)

    @classmethod
    def from_tables(cls, index: Index, suggest_config: SuggestConfig | None = None) -> Autocomplete:
        return cls(index, suggest_config)

    @classmethod
    def load(cls, spark: SparkSession, path: str | Path) -> Autocomplete:
        index, manifest = load_index(spark, index_path(path))
        return cls(index, SuggestConfig(**manifest["suggest"]) if "suggest" in manifest else None, loaded=True)

    def save(self, path: str | Path | None = None) -> str:
        where = index_path(fresh_name() if path is None else path)
        save_index(self.index, where, {"suggest": to_dict(self.suggest_config)})
        return where

    @property
    def build_config(self) -> BuildConfig:
        return self.index.config

    @property
    def stats(self) -> BuildStats | None:
        return self.index.stats

    @property
    def documents(self) -> DataFrame | None:
        """The source documents; None after ``load``."""
        return self._documents

    def local(self) -> LocalServer | None:
        """The index in the driver's memory, read at the first call; None where it is too large for that."""
        if not self._asked:
            self._local, self._asked = LocalServer.load(self.index), True
        return self._local

    def warm(self) -> Autocomplete:
        """Reads the index into the driver's memory, or, where it is too large, its serving tables into the executors'; answers one prompt."""
        server = self.local()
        if server is None:
            for name in ("postings", "context", "support"):
                self.index.tables[name] = self.index[name].persist()
                self.index[name].count()
        else:
            server.inspect([(0, next(iter(server.prefix), ""))], self.suggest_config)
        return self

    def release(self) -> None:
        """Gives back what ``warm`` holds."""
        self._local, self._asked = None, False
        for name in ("postings", "context", "support"):
            self.index[name].unpersist()

    def _settings(self, suggest_config: SuggestConfig | None, collapse: bool | None) -> SuggestConfig:
        cfg = suggest_config or self.suggest_config
        return cfg if collapse is None else dataclasses.replace(cfg, collapse_prefix_ladders=bool(collapse))

    def _warn(self, prompts: DataFrame | list[str], cfg: SuggestConfig, max_words: int | None) -> None:
        b = self.build_config
        words = max(1, cfg.max_suggestion_words if max_words is None else max_words)
        if words > b.max_generated_words:
            warnings.warn(f"max_words={words} is more than the {b.max_generated_words} words the index was built for", UserWarning, stacklevel=4)
        if cfg.token_branch_limit > b.top_next_tokens:
            warnings.warn(f"token_branch_limit={cfg.token_branch_limit} is more than the {b.top_next_tokens} next tokens that are stored", UserWarning, stacklevel=4)
        if cfg.phrase_branch_limit > b.top_next_phrases:
            warnings.warn(f"phrase_branch_limit={cfg.phrase_branch_limit} is more than the {b.top_next_phrases} next phrases that are stored", UserWarning, stacklevel=4)
        if isinstance(prompts, DataFrame):
            longest = beam.parse(prompts, b.normalization).agg(F.max(F.length("frag"))).first()[0] or 0
        else:
            longest = max((len(w[-1]) for t in prompts if t and not t[-1:].isspace() and (w := words_of(t, b.normalization))), default=0)
        if longest > b.max_indexed_prefix_chars:
            warnings.warn(f"a fragment has {longest} letters; prefixes are indexed up to {b.max_indexed_prefix_chars}", UserWarning, stacklevel=4)

    def inspect(self, prompts: DataFrame | str | Iterable[str], topk: int | None = None, max_words: int | None = None, length_bias: float | None = None, collapse_prefix_ladders: bool | None = None, suggest_config: SuggestConfig | None = None, reranker: BaseReranker | None = None, scorer: Scorer | None = None) -> DataFrame:
        """Ranked suggestions with diagnostics, one row each. A ``scorer`` scores the suggestions that the index's own one has found, in its place."""
        cfg = self._settings(suggest_config, collapse_prefix_ladders)
        if not isinstance(prompts, DataFrame):
            prompts = [prompts] if isinstance(prompts, str) else list(prompts)
        self._warn(prompts, cfg, max_words)
        frame = as_prompts(self.index.spark, prompts)
        if isinstance(prompts, list) and len(prompts) <= FEW and (server := self.local()):
            rows = self.index.spark.createDataFrame(server.inspect(list(enumerate(prompts)), cfg, topk, max_words, length_bias), SCHEMA)
        else:
            rows = by_map(frame, self.index, cfg, topk, max_words, length_bias)
            if rows is None:
                rows = beam.inspect(frame, self.index, cfg, topk, max_words, length_bias)
        if scorer is not None:
            rows = rescored(rows, scorer)
        if reranker is None or type(reranker) is BaseReranker:
            return rows
        order = reranker.apply(rows.select("prompt_id", "rank", "text").join(frame.select("prompt_id", F.col("text").alias("prefix")), "prompt_id"))
        return rows.drop("rank").join(order, ["prompt_id", "text"]).select(*rows.columns)

    def suggest_scored(self, prompts: DataFrame | str | Iterable[str], **options: Any) -> DataFrame:
        return self.inspect(prompts, **options).select("prompt_id", "rank", "text", "score")

    def suggest(self, prompts: DataFrame | str | Iterable[str], **options: Any) -> DataFrame:
        return self.inspect(prompts, **options).select("prompt_id", "rank", "text")

    def complete(self, text: str, topk: int | None = None, max_words: int | None = None, length_bias: float | None = None, collapse_prefix_ladders: bool | None = None, suggest_config: SuggestConfig | None = None, reranker: BaseReranker | None = None) -> list[str]:
        """The suggestions for one prompt, as a list."""
        server = self.local()
        if server is None:
            rows = self.suggest(text, topk=topk, max_words=max_words, length_bias=length_bias, collapse_prefix_ladders=collapse_prefix_ladders, suggest_config=suggest_config, reranker=reranker)
            return [r["text"] for r in rows.orderBy("rank").collect()]
        cfg = self._settings(suggest_config, collapse_prefix_ladders)
        self._warn([text], cfg, max_words)
        found = [r[2] for r in server.inspect([(0, text)], cfg, topk, max_words, length_bias)]
        return found if reranker is None else reranker.rerank(text, found)

    @property
    def scorer(self) -> KneserNey:
        """The index's Kneser-Ney model over lower-cased tokens."""
        vocab = self.index["vocab"].select("token_id", "token", F.col("unigram_count").alias("c"))
        one = lambda side: vocab.select(F.col("token_id").alias(f"{side}_id"), F.col("token").alias(side))
        pairs = self.index["bigrams"].select(F.col("left").alias("left_id"), F.col("right").alias("right_id"), "c").join(one("left"), "left_id").join(one("right"), "right_id")
        return KneserNey(vocab.select("token", "c"), pairs.select("left", "right", "c"))

    def score(self, texts: DataFrame | str | Iterable[str]) -> DataFrame:
        """(prompt_id, score): ln P of each text, whatever its length."""
        return self.scorer.score(as_prompts(self.index.spark, texts))
