"""Document sources: rows, frames and files as (doc_ord, doc_id, text, metadata)."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_ord long, doc_id string, text string, metadata map<string,string>"
SUFFIXES = (".txt", ".pdf", ".docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@dataclass(frozen=True)
class Document:
    text: str
    doc_id: str | None = None
    metadata: dict[str, Any] = field(default_factory=dict)


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))
    return "\n".join(s.strip() for s in lines if s.strip())


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading .pdf files needs the optional package pypdf") from e
    pages = (page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages)
    return "\n".join(s.strip() for s in pages if s.strip())


def read_bytes(name: str, data: bytes) -> str:
    """Text of a file by the suffix of its name; ValueError for other kinds and for files without text."""
    suffix = Path(name).suffix.lower()
    if suffix == ".txt":
        return data.decode("utf-8-sig", errors="replace")
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type {suffix or name!r}; these are read: {', '.join(SUFFIXES)}")
    text = _pdf(data) if suffix == ".pdf" else _docx(data)
    if not text.strip():
        raise ValueError(f"no text could be extracted from {name}")
    return text


def from_items(spark: SparkSession, items: Iterable[Document | str | Path]) -> DataFrame:
    """Documents, strings and paths, in order; a path is read at once and its name is the id."""
    rows = []
    for item in items:
        if isinstance(item, Document):
            meta = {str(k): v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in (item.metadata or {}).items()}
            rows.append((len(rows), item.doc_id, item.text, meta))
        elif isinstance(item, str):
            rows.append((len(rows), None, item, {}))
        elif isinstance(item, Path):
            rows.append((len(rows), item.name, read_bytes(item.name, item.read_bytes()), {}))
        else:
            raise TypeError(f"a document is a Document, str or Path, not {type(item).__name__}")
    return spark.createDataFrame(rows, SCHEMA)


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder or glob, read by the executors; doc_ord follows the paths."""
    from ..session import dense_ids

    def read(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "doc_id": [p.rsplit("/", 1)[-1] for p in b["path"]], "text": [read_bytes(p, c) for p, c in zip(b["path"], b["content"])]})

    files = spark.read.format("binaryFile").load(path)
    bad = [r["path"] for r in files.select("path").where(~F.lower("path").rlike(r"\.(txt|pdf|docx)$")).limit(1).collect()]
    if bad:
        read_bytes(bad[0], b"")
    rows = files.select("path", "content").mapInPandas(read, "path string, doc_id string, text string")
    return dense_ids(rows, [F.col("path").asc()], "doc_ord").select("doc_ord", "doc_id", "text", F.create_map().cast("map<string,string>").alias("metadata"))


def from_frame(df: DataFrame, text: str = "text", order: Column | str = "doc_id", doc_id: Column | str | None = None) -> DataFrame:
    """Any table with a text column; ``order``: a unique whole number by which the documents are ordered."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    ident = col(order if doc_id is None else doc_id)
    return df.select(col(order).cast("long").alias("doc_ord"), ident.cast("string").alias("doc_id"), F.col(text).alias("text"), F.create_map().cast("map<string,string>").alias("metadata"))


_SAMPLE = {
    "building": "Build the image before you push it\nBuild only what changed since the last release\nCache the layers that rarely change\nPin the base image to a digest\nSign the image after the build",
    "testing": "Write a failing test before the fix\nRun the slow tests on every merge\nKeep the fixtures small and readable\nTest the error paths as well\nMeasure coverage but do not chase it",
    "databases": "Add an index before the table grows\nMeasure a query before you tune it\nKeep migrations small and reversible\nBack up the database before a migration\nLimit the number of open connections",
    "services": "Set a timeout on every remote call\nRetry only calls that can be repeated\nLog the request id with every error\nShed load before the queue is full\nVersion the interface from the first day",
    "review": "Review the design before the code\nAsk questions before you ask for changes\nKeep each change small enough to review\nExplain why and not only what\nMerge when the checks are green",
}


def sample_documents(spark: SparkSession) -> DataFrame:
    """A small corpus about software work."""
    return from_items(spark, [Document(text, name, {"topic": name}) for name, text in _SAMPLE.items()])
