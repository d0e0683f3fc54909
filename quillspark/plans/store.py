"""A mutable document store: versions of a document table, deduplication by id and content, and a lazily rebuilt index.

A change writes a new version beside the old one and then a pointer file with the next number; the highest that can be
read counts, so readers see one version or the other, and no moment is without one. There is one writer at a time: two
that commit the same number are an error. Classification of a batch is by joins and windows; a batch in which a new text
appears under several ids, or an id with several texts, is resolved in input order.
"""

from __future__ import annotations

import json
import secrets
from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BuildConfig, SuggestConfig, apply_quality_profile, build_config as config_from, to_dict
from ..operators.local import SCHEMA
from ..session import shared_dir, small
from ..sources.documents import Document, from_items
from .engine import Autocomplete
from .index import _fs, compile_index, index_bytes, load_index, read_text, remove, save_index, write_text

_SCHEMA = "doc_ord long, doc_id string, text string, content_sha256 string, ingested_at timestamp"
_ENGINES: OrderedDict[tuple[str, str], tuple[Autocomplete, int]] = OrderedDict()
#: Engines kept at most, and bytes of their index files.
ENGINES, ENGINE_BYTES = 8, 256 << 20


def _evict(gone: list[tuple[str, str]]) -> None:
    for key in gone:
        _ENGINES.pop(key)[0].release()


@dataclass(frozen=True)
class DuplicateDocument:
    doc_id: str
    text_preview: str


@dataclass(frozen=True)
class InsertResult:
    inserted_count: int
    duplicate_doc_ids: tuple[str, ...] = ()
    duplicate_texts: tuple[DuplicateDocument, ...] = ()


class DocumentStore:
    """Documents below one folder. ``path``: a folder or URI that all executors reach; ``sqlite:///`` forms name a folder too, ``:memory:`` a new one among the session's temporary tables."""

    def __init__(self, spark: SparkSession, path: str, state: dict[str, Any]):
        self.spark, self.path, self._state = spark, path, state

    @staticmethod
    def _resolve(url: str) -> str:
        if url.startswith("sqlite:///"):
            return url[len("sqlite:///") :]
        scheme = url.partition("://")[0] if "://" in url else ""
        if scheme and scheme not in ("file", "hdfs", "s3", "s3a", "gs", "abfss"):
            raise NotImplementedError(f"no store for {scheme}://")
        return url.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, url: str, build_config: BuildConfig | None = None, suggest_config: SuggestConfig | None = None, quality_profile: str | None = None) -> DocumentStore:
        """Opens or creates; explicit settings that differ from the stored ones are an error."""
        path = f"{shared_dir(spark)}/store-{secrets.token_hex(8)}" if url == ":memory:" else cls._resolve(url)
        state = cls._current(spark, path)
        if state is None:
            build, serve = apply_quality_profile(quality_profile or "balanced", build_config, suggest_config)
            state = {"version": 0, "documents": None, "index": None, "commit": 0, "build": to_dict(build), "suggest": to_dict(serve), "next_ord": 0}
            store = cls(spark, path, state)
            store._commit(state)
            return store
        for given, kind in ((build_config, "build"), (suggest_config, "suggest")):
            if given is not None and json.loads(json.dumps(to_dict(given))) != state[kind]:
                raise ValueError(f"the store at {path} was made with another {kind} config")
        return cls(spark, path, state)

    open_or_create = open

    @staticmethod
    def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
        p, fs, _ = _fs(spark, f"{path}/CURRENT")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        return sorted((int(n.removesuffix(".json")), f"{path}/CURRENT/{n}") for n in names if n.removesuffix(".json").isdigit())

    @classmethod
    def _current(cls, spark: SparkSession, path: str) -> dict[str, Any] | None:
        """The state of the highest pointer that can be read; None where no store was ever made."""
        found = cls._pointers(spark, path)
        for _, name in reversed(found):
            try:
                return json.loads(read_text(spark, name))
            except (ValueError, FileNotFoundError):  # damaged, or an older one just cleared away
                continue
        p, fs, _ = _fs(spark, f"{path}/documents")
        if found or fs.exists(p):
            raise ValueError(f"the store at {path} has lost its pointers")
        return None

    def _commit(self, state: dict[str, Any]) -> None:
        state = state | {"commit": state["commit"] + 1}
        target = f"{self.path}/CURRENT/{state['commit']}.json"
        new = f"{self.path}/CURRENT/{state['commit']}-{secrets.token_hex(4)}.new"
        write_text(self.spark, new, json.dumps(state, sort_keys=True))
        src, fs, jvm = _fs(self.spark, new)
        dst = jvm.org.apache.hadoop.fs.Path(target)
        if fs.exists(dst) or not fs.rename(src, dst):
            fs.delete(src, False)
            raise OSError(f"another writer has changed the store at {self.path}; open it again")
        self._state = state
        for number, name in self._pointers(self.spark, self.path):
            if number < state["commit"] - 2:
                remove(self.spark, name)

    def _log(self, name: str, **values: Any) -> None:
        row = json.dumps(values | {"at": datetime.now(timezone.utc).isoformat()})
        self.spark.createDataFrame([(row,)], "entry string").write.mode("append").parquet(f"{self.path}/{name}")

    def history(self, name: str) -> list[dict[str, Any]]:
        """Entries of ``ingest_log`` or ``build_history``."""
        _, fs, jvm = _fs(self.spark, self.path)
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")):
            return []
        return sorted((json.loads(r["entry"]) for r in self.spark.read.parquet(f"{self.path}/{name}").collect()), key=lambda e: e["at"])

    @property
    def build_config(self) -> BuildConfig:
        return config_from(self._state["build"])

    @property
    def suggest_config(self) -> SuggestConfig:
        return SuggestConfig(**self._state["suggest"])

    def documents(self) -> DataFrame:
        """All documents in the order of insertion (doc_ord)."""
        if not self._state["documents"]:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/{p}" for p in self._state["documents"]])

    def list_documents(self) -> list[Document]:
        return [Document(r["text"], r["doc_id"]) for r in self.documents().orderBy("doc_ord").collect()]

    def _next(self, parts: list[str] | None, next_ord: int | None = None) -> None:
        old = self._state
        self._commit(old | {"version": old["version"] + 1, "documents": parts or None, "index": None, "next_ord": old["next_ord"] if next_ord is None else next_ord})
        _evict([k for k in _ENGINES if k[0] == self.path])

    def add_documents(self, items: DataFrame | Iterable[Any]) -> InsertResult:
        """Adds documents; empty texts are skipped, rows without an id get one.

        An id that exists with the same text, and a text that exists under another id, are reported and not added; an
        id that exists with another text is an error and nothing is added. Within a batch the first row counts.
        """
        rows = items if isinstance(items, DataFrame) else from_items(self.spark, items)
        name = f"documents/v{self._state['version'] + 1}-{secrets.token_hex(4)}"
        salt = secrets.token_urlsafe(6)
        batch = rows.where("text IS NOT NULL AND text <> ''").select("doc_ord", F.coalesce("doc_id", F.concat(F.lit(salt + "-"), F.col("doc_ord").cast("string"))).alias("doc_id"), "text", F.sha2("text", 256).alias("h"))
        staged = f"{self.path}/staging/{secrets.token_hex(4)}"
        batch.write.parquet(staged)
        batch = self.spark.read.schema(batch.schema).parquet(staged)
        # Stored rows that share an id or a text with the batch; the others take no part in any window.
        have = self.documents().select("doc_id", F.col("content_sha256").alias("h"), F.col("doc_ord").alias("o"))
        n = batch.count()
        ids, texts = (small(batch.select(c).distinct(), n) for c in ("doc_id", "h"))
        have = have.join(ids, "doc_id", "left_semi").unionByName(have.join(texts, "h", "left_semi")).distinct().select("doc_id", "h", "o")
        # Of all rows, stored before new ones, the first of an id and the first of a text.
        every = have.select("doc_id", "h", F.lit(0).alias("new"), F.col("o")).unionByName(batch.select("doc_id", "h", F.lit(1).alias("new"), F.col("doc_ord").alias("o")))
        order = F.struct("new", "o")
        by_id = every.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(order))).withColumn("id_h", F.first("h").over(Window.partitionBy("doc_id").orderBy(order)))
        one = by_id.where("r = 1")
        named = one.withColumn("t", F.row_number().over(Window.partitionBy("h").orderBy(order))).withColumn("owner", F.first("doc_id").over(Window.partitionBy("h").orderBy(order)))
        clash = by_id.where("new = 1 AND r > 1 AND h <> id_h").limit(1).collect()
        try:
            if clash:
                raise ValueError(f"document {clash[0]['doc_id']!r} exists with another text")
            again = [r["doc_id"] for r in by_id.where("new = 1 AND r > 1").orderBy("o").select("doc_id").collect()]
            twins = named.where("new = 1 AND t > 1").orderBy("o").join(batch.select(F.col("doc_ord").alias("o"), F.substring("text", 1, 100).alias("p")), "o").orderBy("o").collect()
            fresh = named.where("new = 1 AND t = 1").select(F.col("o").alias("doc_ord"))
            base = self._state["next_ord"]
            out = batch.join(fresh, "doc_ord").select((F.lit(base) + F.col("doc_ord")).cast("long").alias("doc_ord"), "doc_id", "text", F.col("h").alias("content_sha256"), F.current_timestamp().alias("ingested_at"))
            out.write.parquet(f"{self.path}/{name}")
            added = self.spark.read.parquet(f"{self.path}/{name}")
            r = added.agg(F.count("*").alias("n"), F.max("doc_ord").alias("m")).first()
        finally:
            p, fs, _ = _fs(self.spark, staged)
            fs.delete(p, True)
        if r["n"]:
            self._next([*(self._state["documents"] or []), name], r["m"] + 1)
        self._log("ingest_log", inserted=r["n"], duplicates=len(again) + len(twins))
        return InsertResult(r["n"], tuple(again), tuple(DuplicateDocument(t["owner"], t["p"]) for t in twins))

    def remove_document(self, doc_id: str) -> int:
        """Removes one document; the number removed."""
        docs = self.documents()
        if docs.where(F.col("doc_id") == doc_id).isEmpty():
            return 0
        left = docs.where(F.col("doc_id") != doc_id)
        if left.isEmpty():
            self._next(None)
            return 1
        name = f"documents/v{self._state['version'] + 1}-{secrets.token_hex(4)}"
        left.write.parquet(f"{self.path}/{name}")
        self._next([name])
        return 1

    def clear(self) -> None:
        """Removes all documents; the settings stay."""
        self._next(None, 0)

    delete = clear

    def migrate(self, url: str) -> DocumentStore:
        """Copies documents and settings to another, empty store."""
        other = DocumentStore.open(self.spark, url, self.build_config, self.suggest_config)
        other.add_documents(self.documents().select("doc_ord", "doc_id", "text"))
        return other

    def import_autocomplete(self, engine: Autocomplete) -> InsertResult:
        """Adds the documents of an engine built in this session."""
        if engine.loaded or engine.documents is None:
            raise ValueError("a loaded index has no documents to import")
        return self.add_documents(engine.documents)

    def engine(self) -> Autocomplete:
        """The index over all documents, rebuilt if they changed since the last one."""
        state = self._state
        key = (self.path, state["index"] or "")
        if state["index"] and key in _ENGINES:
            _ENGINES.move_to_end(key)
            return _ENGINES[key][0]
        if not state["index"]:
            docs = self.documents()
            index = compile_index(docs.select("doc_ord", "text"), self.build_config)
            name = f"index/v{state['version']}-{secrets.token_hex(4)}"
            save_index(index, f"{self.path}/{name}")
            self._commit(state | {"index": name})
            self._log("build_history", index=name, **{k: int(v) for k, v in index.metadata.items()})
            key = (self.path, name)
        index, _ = load_index(self.spark, f"{self.path}/{key[1]}")
        _ENGINES[key] = Autocomplete(index, self.suggest_config, loaded=True), sum(index_bytes(index).values())
        while len(_ENGINES) > 1 and (len(_ENGINES) > ENGINES or sum(n for _, n in _ENGINES.values()) > ENGINE_BYTES):
            _evict([next(iter(_ENGINES))])
        return _ENGINES[key][0]

    def with_suggest_config(self, cfg: SuggestConfig) -> Autocomplete:
        return Autocomplete(self.engine().index, cfg)

    def suggest(self, prompts, **options: Any) -> DataFrame:
        """Suggestions for the prompts; none from a store without documents."""
        return self.inspect(prompts, **options).select("prompt_id", "rank", "text")

    def suggest_scored(self, prompts, **options: Any) -> DataFrame:
        return self.inspect(prompts, **options).select("prompt_id", "rank", "text", "score")

    def inspect(self, prompts, **options: Any) -> DataFrame:
        if self.documents().isEmpty():
            return self.spark.createDataFrame([], SCHEMA)
        return self.engine().inspect(prompts, **options)

    def warm(self) -> None:
        """Builds the index if need be and reads it; nothing to do without documents."""
        if not self.documents().isEmpty():
            self.engine().warm()


class BaseStore(Protocol):
    """What a document store offers."""

    def documents(self) -> DataFrame: ...
    def list_documents(self) -> list[Document]: ...
    def add_documents(self, items: DataFrame | Iterable[Any]) -> InsertResult: ...
    def remove_document(self, doc_id: str) -> int: ...
    def clear(self) -> None: ...
    def migrate(self, url: str) -> BaseStore: ...
    def import_autocomplete(self, engine: Autocomplete) -> InsertResult: ...
    def history(self, name: str) -> list[dict[str, Any]]: ...
    def engine(self) -> Autocomplete: ...
    def with_suggest_config(self, cfg: SuggestConfig) -> Autocomplete: ...
    def suggest(self, prompts: Any, **options: Any) -> DataFrame: ...
    def suggest_scored(self, prompts: Any, **options: Any) -> DataFrame: ...
    def inspect(self, prompts: Any, **options: Any) -> DataFrame: ...
    def warm(self) -> None: ...
